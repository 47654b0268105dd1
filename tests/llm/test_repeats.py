import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from vigil.llm import repeats

from .cases import documents, texts, words


def plain(rows, length):
    raws = [(t or "").encode() for t in rows]
    seen = Counter(r[i : i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for r in raws:
        gone = np.zeros(len(r), bool)
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(b for b, g in zip(r, gone, strict=True) if not g)
        runs = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(r), int(gone.sum()), int(runs), hashlib.sha256(kept).hexdigest()))
    return out


def cases(seed, n=40):
    """Texts that share passages of about 400 bytes at any place, with edits near their ends."""
    r = random.Random(seed)
    pool = [words(r.randint(60, 130), seed * 100 + k) for k in range(8)]
    out = []
    for i in range(n):
        parts = []
        for _ in range(r.randint(1, 4)):
            p = r.choice(pool)
            a = r.randrange(len(p) // 2)
            p = p[a : a + r.randint(380, 430)] if r.random() < 0.7 else p
            if r.random() < 0.5:
                k = r.randrange(len(p))
                p = p[:k] + r.choice("#é") + p[k + 1 :]
            parts.append(p)
            parts.append(words(r.randint(0, 20), 10_000 + i * 7))
        out.append(" ".join(parts))
    return out


def compare(spark, rows, **options):
    docs = documents(spark, rows)
    at = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    got = repeats.without_repeats(docs, **options).collect()
    want = dict(zip(at, plain([*at.values()], options.get("length", 400)), strict=True))
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in got} == want
    assert len(got) == len(rows)
    return sum(w[1] for w in want.values())


@pytest.mark.parametrize("seed", range(3))
def test_shared_passages(spark, seed):
    assert compare(spark, cases(seed)) > 1000


@pytest.mark.parametrize("group_rows", [1, 3])
def test_large_groups_are_halved(spark, group_rows):
    assert compare(spark, cases(9), group_rows=group_rows) > 1000


def test_names_that_meet_are_made_anew(spark):
    rows = repeats.keyed(documents(spark, cases(10)), "doc_id", "text")
    assert not repeats.all_apart(repeats.dictionary(rows, 0, 4)) and repeats.all_apart(repeats.dictionary(rows, 4, 4))
    assert compare(spark, cases(10, 15), bits=8) > 1000


def test_triggers_depend_on_their_bytes_alone():
    r = random.Random(3)
    raw = "".join(words(3000, 77)).encode()
    data, one = np.frombuffer(raw, np.uint8), np.array([0])
    at = repeats.triggers(data, repeats.rolling_hashes(data, 16), one, np.array([len(raw)]))
    assert 0.5 < len(raw) / 128 / len(at) < 2
    strings = {raw[a : a + 32] for a in at}
    for _ in range(20):
        a, b = sorted(r.sample(range(len(raw)), 2))
        part = np.frombuffer(raw[a:b], np.uint8)
        if len(part) > 100:
            own = repeats.triggers(part, repeats.rolling_hashes(part, 16), one, np.array([len(part)]))
            assert own.tolist() == [x - a for x in at if a <= x and x + 32 <= b]
    phrases = repeats.phrases_of(raw, [0, *at.tolist()])
    assert all(p[-32:] in strings and not any(p[k : k + 32] in strings for k in range(1, len(p) - 32)) for p in phrases[:-1])
    assert phrases[0] + b"".join(p[32:] for p in phrases[1:]) == raw
    for period in (b"a", b"ab", b"abcdefghijklmno"):
        run = np.frombuffer((period * 5000)[:5000], np.uint8)
        assert not len(repeats.triggers(run, repeats.rolling_hashes(run, 16), one, np.array([5000])))


def test_awkward_documents(spark):
    run = "a" * 1500
    period = "abc" * 500
    assert compare(spark, [*texts(), run, period, period[1:], "a" * 400, "a" * 1700 + "z", "abc" * 170 + "q", "b" * 400, "b" * 399, "é" * 300, "é" * 200, "xé" * 150]) > 1000


def test_repeated_rows_and_empty_table(spark):
    docs = documents(spark, [words(300, 1), words(300, 2), "short"])
    twice = repeats.repeat_digests(docs.union(docs)).collect()
    assert len(twice) == 6 and all(r.n_removed == (r.n_bytes if r.n_bytes >= 400 else 0) for r in twice)
    assert repeats.repeat_digests(docs.limit(0)).count() == 0


def test_orders_against_counting():
    r = random.Random(4)
    length = 400
    for _ in range(4):
        trigger = bytes(r.choices(b"ab", k=64))
        rows, groups = [], []
        for g in range(3):
            tails = [bytes(r.choices(b"ab", k=336)) for _ in range(2)]
            heads = [bytes(r.choices(b"ab", k=200)) for _ in range(2)]
            for _ in range(12):
                n, before = r.randint(1, 150), r.randint(150, 200)
                after = bytearray(r.choice(tails))
                after[r.randrange(150, 336)] ^= 1
                head = bytearray(r.choice(heads))
                head[r.randrange(0, 199)] ^= 1
                raw = bytes(head[200 - before :]) + trigger + bytes(after)
                rows.append((n, before, raw[: n + length - 1]))
                groups.append(g)
        masks = repeats.repeated_windows(rows, np.array(groups), length)
        seen = Counter((g, raw[i : i + length], before - i) for g, (n, before, raw) in zip(groups, rows, strict=True) for i in range(n))
        for g, (n, before, raw), m in zip(groups, rows, masks, strict=True):
            assert m.tolist() == [seen[g, raw[i : i + length], before - i] > 1 for i in range(n)]
