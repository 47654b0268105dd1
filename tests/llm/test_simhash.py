import random
from collections import Counter

import numpy as np
import pytest
import xxhash

from vigil.llm import simhash
from vigil.llm.components import connected_components

from .cases import documents, texts, words


def plain(text):
    w = (text or "").encode().lower().split()
    s = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    votes = Counter()
    for x in s:
        h = xxhash.xxh64_intdigest(x, 42)
        votes.update(k for k in range(64) if h >> k & 1)
    return sum(1 << k for k in range(64) if 2 * votes[k] > len(s))


def roots(n, pairs):
    up = [*range(n)]

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_fingerprints():
    for t in texts():
        assert simhash.fingerprint(t) & (1 << 64) - 1 == plain(t)


def test_spark_hash_is_the_same(spark):
    r = spark.sql("SELECT xxhash64('one two three') AS h").first()
    assert r.h & (1 << 64) - 1 == xxhash.xxh64_intdigest(b"one two three", 42)


@pytest.mark.parametrize("n", [3, 40, 500])
def test_tile_links_join_what_all_pairs_join(n):
    r = np.random.default_rng(n)
    x = r.integers(0, 1 << 62, 3)[r.integers(0, 3, n)] ^ (np.int64(1) << r.integers(0, 62, n)) ^ (np.int64(1) << r.integers(0, 62, n))
    x = np.unique(x)
    y = np.unique(x[::2] ^ 8)
    for other in (None, y):
        names = sorted({*x.tolist(), *(() if other is None else y.tolist())})
        at = {v: i for i, v in enumerate(names)}
        z = x if other is None else y
        want = roots(len(names), [(at[a], at[b]) for a in x.tolist() for b in z.tolist() if (a ^ b).bit_count() <= 2])
        i, j = simhash.tile_links(x, other)
        assert len(i) <= 4 * (len(x) + len(z))
        assert all(True for _ in zip(i, j, strict=True))
        assert roots(len(names), [(at[a], at[b]) for a, b in zip(i.tolist(), j.tolist(), strict=True)]) == want


@pytest.mark.parametrize("tile", [7, 1024])
def test_components_against_all_pairs(spark, tile):
    r = random.Random(7)
    seeds = [r.getrandbits(64) for _ in range(40)] + [0, (1 << 64) - 1]
    bits = set()
    for s in seeds:
        x = s
        for _ in range(12):  # chains that wander further than the radius
            bits.add(x)
            for _ in range(r.randint(1, 3)):
                x ^= 1 << r.randrange(64)
    bits = sorted(b - (1 << 64) if b >> 63 else b for b in bits)
    made = connected_components(simhash.near_pairs(spark.createDataFrame([(b,) for b in bits], "bits long"), tile=tile)).collect()
    got = {x.id: x.root for x in made}
    assert len(got) == len(made)
    want = roots(len(bits), [(i, j) for i in range(len(bits)) for j in range(i) if ((bits[i] ^ bits[j]) & (1 << 64) - 1).bit_count() <= 2])
    assert [got.get(b, b) for b in bits] == [bits[k] for k in want]


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(500, 501 + i) for i in range(50)] + [(900, 900), (3, 3), (700, 600), (600, 800)]
    got = {x.id: x.root for x in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{500 + i: 500 for i in range(51)}, 600: 600, 700: 600, 800: 600}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_documents_against_all_pairs(spark):
    base = [words(150, s) for s in range(6)]
    rows = texts() + [b.replace(f"w{k}", f"u{k}") for b in base for k in range(25)] + base
    docs = documents(spark, rows)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    held = [(r.doc_id, plain(r.text)) for r in docs.select("doc_id", "text").collect()]
    held.sort()
    want = roots(len(held), [(i, j) for i in range(len(held)) for j in range(i) if (held[i][1] ^ held[j][1]).bit_count() <= 2])
    assert got == {d: (f"{f:016x}", held[k][0]) for (d, f), k in zip(held, want, strict=True)}
    kept = simhash.first_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, c in got.values()})
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
    assert simhash.first_of_each(docs.union(docs)).count() == kept.count()
