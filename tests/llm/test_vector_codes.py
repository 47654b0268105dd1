import hashlib
import math
import random

import numpy as np
import pytest

from vigil.llm import vector_codes


def brute(rows, parts=16, n_entries=64, rounds=2):
    """Full scans of Python integers."""
    kept = [(i, v, label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    kept = [(i, [math.floor(256 * x) for x in v], label) for i, v, label in kept if len(v) == len(kept[0][1])]
    width = len(kept[0][1]) // parts
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(v, p) for _, v, _ in kept[:n_entries]] for p in range(parts)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            members = [[] for _ in books[p]]
            for _, v, _ in kept:
                members[near(cut(v, p), books[p])[1]].append(cut(v, p))
            books[p] = [[sum(c) // len(m) for c in zip(*m, strict=True)] if m else e for m, e in zip(members, books[p], strict=True)]
    out, by_label = [], {}
    for i, v, label in kept:
        found = [near(cut(v, p), books[p]) for p in range(parts)]
        out.append((i, label, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found)))
        by_label[label] = by_label.get(label, 0) + out[-1][3]
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return [(i, code, e, by_label[label], sha) for i, label, code, e in out]


def awkward(n=300, size=32):
    r = random.Random(5)
    rows = [(i * 7 % 1009, [float(np.float32(r.gauss(i % 5, 0.3))) for _ in range(size)], i % 4 or None) for i in range(n)]
    hot = [0.125] * size
    rows += [(2000 + i, hot, 9) for i in range(n // 2)]
    rows += [(5, [float("nan")] * size, 1), (6, None, 1), (7, [None] * size, 1), (8, [float("inf")] + [0.0] * (size - 1), 2), (1, [-0.001] * size, None), (1, [-0.001] * size, None), (9, [1.0] * 3, 1), (None, [0.5] * size, 3)]
    return rows


SCHEMA = "vec_id long, embedding array<float>, label int, code string"


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("blocks", [1 << 14, 37])
def test_against_full_scans(spark, monkeypatch, blocks):
    monkeypatch.setattr(vector_codes, "BLOCK_ROWS", blocks)
    rows = awkward()
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA).repartition(3)
    out = vector_codes.compressed(df)
    assert out.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert rows_of(out) == sorted(brute(rows), key=str)


def test_many_labels_join_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(vector_codes, "MAX_BROADCAST_LABELS", 1)
    rows = awkward(80)
    assert rows_of(vector_codes.compressed(spark.createDataFrame([(*r, "x") for r in rows], SCHEMA))) == sorted(brute(rows), key=str)


def test_few_rows_and_none(spark):
    rows = awkward()[:3]
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)
    assert rows_of(vector_codes.compressed(df)) == sorted(brute(rows), key=str)
    assert vector_codes.compressed(df.limit(0)).collect() == []
    assert vector_codes.compressed(df.limit(0)).columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    odd = spark.createDataFrame([(1, [0.5] * 5, 1, "x"), (2, [1.5] * 5, 1, "x")], SCHEMA)
    assert {r.code for r in vector_codes.compressed(odd).collect()} == {"00" * 16, "01" * 5 + "00" * 11}
    none = spark.createDataFrame([(1, [], 1, "x")], SCHEMA)
    assert [r.error for r in vector_codes.compressed(none).collect()] == [0]


def test_huge_components_stay_exact(spark):
    r = random.Random(8)
    rows = [(i, [float(np.float32(r.gauss(0, 10.0 ** (i % 30)))) for _ in range(16)], 1) for i in range(90)]
    want = [(i, c, e if e < 2**63 else None, None, s) for i, c, e, _, s in brute(rows)]
    out = vector_codes.compressed(spark.createDataFrame([(*x, "x") for x in rows], SCHEMA))
    assert sorted((x[0], x[1], x[2], None, x[4]) for x in out.collect()) == sorted(want)


def test_only_violated_parts_are_scanned_again(monkeypatch):
    r = np.random.default_rng(1)
    x = np.concatenate([r.normal(c, 3, (200, 4)) for c in (0, 500, 1000, 1500)]).astype(np.int64)
    books = vector_codes.Codebooks(x[::200].copy(), 1)
    codes, keys = vector_codes.scan(x, books.entries[0])
    seen = []
    whole = vector_codes.scan
    monkeypatch.setattr(vector_codes, "scan", lambda a, e: seen.append(len(a)) or whole(a, e))
    books.entries[0] = books.entries[0] + 2
    books.drift += 2 * 4.0 + 0.1
    all_codes, all_keys = codes[:, None].copy(), keys[:, None].copy()
    assert vector_codes.rescanned(x, all_codes, all_keys, books) == [] and not seen  # clusters are far apart
    books.drift += float(vector_codes.np.median(keys)) - 8.1
    vector_codes.rescanned(x, all_codes, all_keys, books)
    assert 0 < sum(seen) < len(x)
    assert (all_codes[:, 0] == whole(x, books.entries[0])[0]).all()
