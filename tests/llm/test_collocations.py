import random
import re
from collections import Counter, defaultdict

import pytest

from vigil.llm import collocations

from .cases import documents, texts

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least=30, top=2000):
    """rows of (lang, text)."""
    n, f = Counter(), defaultdict(Counter)
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = [w for w in re.split(r"[\x20\x09]+", piece) if w]
            n[lang] += len(words)
            for size in range(1, 5):
                f[lang].update(tuple(words[i : i + size]) for i in range(len(words) - size + 1))
    out = []
    for lang, counts in f.items():
        candidates = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        rows = []
        for p, a in candidates.items():
            inside = [q for q in candidates if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))]
            if any(100 * candidates[q] >= 80 * a for q in inside):
                continue
            score, k = min((2_000_000 * a // (counts[p[:k]] + counts[p[k:]]), k) for k in range(1, len(p)))
            rows.append((" ".join(p), a, counts[p[:k]], counts[p[k:]], n[lang], score))
        rows.sort(key=lambda r: (-r[5], -r[1], r[0].encode()))
        out += [(lang, i, *r) for i, r in enumerate(rows[:top], 1)]
    return sorted(out)


def awkward():
    r = random.Random(4)
    pool = ["the", "of", "The", "État", "漢字", "x\x1cy", "a\x01", "a", "b", "c", "d-e", "\x00", "new", "york"]
    line = lambda n: " ".join(r.choice(pool) for _ in range(n))
    rows = [(r.choice(["en", "de", None]), line(r.randint(0, 60)).replace("b c", "b, c") + r.choice(["", ".", " \t", "\n\r"])) for _ in range(60)]
    rows += [("en", "of the of the of the")] * 70 + [("fr", "one two three four five")] * 31 + [("de", None), ("de", ""), (None, ".,;"), ("", "empty lang " * 30)]
    return rows + [("en", line(3000)), ("en", "the " * 2500), ("zz", "w" * 9000 + " " + "v" * 9000)]


SCHEMA = "lang string, text string, phrase string, f long"


def rows_of(df):
    assert df.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize(("trie", "ranges"), [(6 << 20, 8 << 20), (700, 900), (5000, 40)])
def test_against_plain_counts(spark, trie, ranges):
    rows = awkward()
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(3)
    assert rows_of(collocations.collocations(df, trie_bytes=trie, range_bytes=ranges)) == brute(rows)


def test_shared_counts_by_shuffle_and_few_first_rows(spark, monkeypatch):
    monkeypatch.setattr(collocations, "MAX_BROADCAST_SHARED", 1)
    monkeypatch.setattr(collocations, "ROWS_A_PART", 20)
    rows = awkward()
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    assert rows_of(collocations.collocations(df, least=5, top=7, trie_bytes=900, range_bytes=700)) == brute(rows, 5, 7)


def test_awkward_documents_and_none(spark):
    docs = documents(spark)
    assert rows_of(collocations.collocations(docs)) == brute([(None, t) for t in texts()])
    assert collocations.collocations(docs.limit(0)).collect() == []


def test_segments_share_words_but_no_starts():
    r = random.Random(2)
    text = b" ".join(bytes(r.choices(b"abc", k=r.randint(1, 9))) for _ in range(4000))
    parts = list(collocations.segments(text, 500))
    assert len(parts) > 5 and b"".join(p[:own] for p, own in parts) == text
    whole, cut = collocations.Trie([(b"en", text, len(text))]), collocations.Trie([(b"en", p, own) for p, own in parts])
    assert whole.words == cut.words and (whole.paths == cut.paths).all() and (whole.counts == cut.counts).all()


def test_packed_ranges_merge_to_the_whole():
    rows = [((lang or "und").encode(), (text or "").encode()) for lang, text in awkward()]
    whole = collocations.Trie([(lang, t, len(t)) for lang, t in rows])
    half = [collocations.Trie([(lang, t, len(t)) for lang, t in rows[i::3]]) for i in range(3)]
    bounds = [(b"de", b"a", b"", b"", b""), (b"en", b"of", b"the", b"of", b"the"), (b"en", b"the", b"nowhere", b"", b""), (b"zzz", b"", b"", b"", b"")]
    ends = [[0, *t.cuts(bounds), len(t.counts)] for t in half]
    found = []
    for i in range(len(bounds) + 1):
        langs, words, paths, counts = collocations.merged([(names, *collocations.unpacked(data)) for t, e in zip(half, ends, strict=True) for names, data in [t.packed(e[i], e[i + 1])]])
        found += [(langs[p[0]], *(words[w] for w in p[1:]), n) for p, n in zip(paths.T.tolist(), counts.tolist(), strict=True)]
    assert found == [(whole.langs[p[0]], *(whole.words[w] for w in p[1:]), n) for p, n in zip(whole.paths.T.tolist(), whole.counts.tolist(), strict=True)]
    assert all(found[i][:-1] < found[i + 1][:-1] for i in range(len(found) - 1))


def test_counts_beyond_64_bits_in_products(spark):
    big = 6_000_000_000_000
    lefts = ", ".join(f"cast({big if k == 1 else 'null'} as long) l{k}" for k in range(1, 4))
    counts = spark.sql(f"select 'en' lang, 'a b' phrase, 2 size, {big - 1}L f, {lefts} union all select 'en', 'a', 1, {big}L, null, null, null union all select 'en', 'b', 1, {3 * big}L, null, null, null union all select 'en', '', 0, {5 * big}L, null, null, null")
    assert [tuple(r) for r in collocations.scored_phrases(counts, 10).collect()] == [("en", 1, "a b", big - 1, big, 3 * big, 5 * big, 2_000_000 * (big - 1) // (4 * big))]
