import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from vigil.llm import sharding

from .cases import documents, texts, words


def check(docs, out, shards=8):
    text = {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}
    slots = defaultdict(list)
    for r in out:
        raw = text[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "rows", None)
        slots[r.shard].append(r.slot)
    counts = [len(slots[k]) for k in range(shards)]
    assert max(counts) - min(counts) <= 1
    for k, s in slots.items():
        assert 0 <= k < shards and sorted(s) == [*range(len(s))]
    groups = defaultdict(Counter)
    for r in out:
        groups[text[r.doc_id]][r.shard] += 1
    return groups, counts


@pytest.mark.parametrize("hot", [0, 400])
def test_groups_stay_together(spark, hot):
    rows = [f"text {i}" for i in range(600)] + [f"pair {i}" for i in range(60) for _ in range(2 + i % 4)] + ["the hot one"] * hot
    docs = documents(spark, rows)
    groups, counts = check(docs, sharding.sharded_documents(docs).collect())
    assert not [t for t, g in groups.items() if len(g) > 1 and t != "the hot one"]
    if hot:
        assert len(groups["the hot one"]) <= -(-hot // min(counts)) + 2


def test_awkward_documents(spark):
    docs = documents(spark)
    check(docs, sharding.sharded_documents(docs).collect())
    twice = docs.union(docs)
    out = sharding.sharded_documents(twice).collect()
    assert len(out) == 2 * len(texts())
    check(twice, out)
    assert sharding.sharded_documents(docs.limit(0)).count() == 0
    assert sorted(sharding.sharded_documents(docs.repartition(5)).collect()) == sorted(sharding.sharded_documents(docs).collect())


def test_null_ids(spark):
    docs = spark.createDataFrame([(None, "a b c"), (None, "a b c"), (1, "a b c"), (None, None), (2, "")], "doc_id long, text string")
    out = sharding.sharded_documents(docs, shards=2).collect()
    assert sorted(Counter(r.shard for r in out).values()) == [2, 3] and sum(r.doc_id is None for r in out) == 3


def bucket(n, *cols):
    return int(hashlib.md5("|".join(cols).encode()).hexdigest()[:8], 16) % n


def plain(nodes, links, quota, shards, rounds):
    """The same rounds, node by node on one machine."""
    hubs = defaultdict(list)
    for v, h in links:
        hubs[h].append(v)
    at = {v: bucket(shards, v) for v in nodes}
    for number in range(rounds):
        load = np.zeros(shards)
        for v, n in nodes.items():
            load[at[v]] += n
        asked = []
        for v in nodes:
            if bucket(2, str(number), v):
                continue
            votes = Counter()
            for h in {h for w, h in links if w == v}:
                whole = sum(nodes[w] for w in hubs[h])
                by = Counter()
                for w in hubs[h]:
                    by[at[w]] += nodes[w] * (w != v)
                for k, n in by.items():
                    votes[k] += n * 1_000_000 // whole
            if votes:
                n, to = max((n, -k) for k, n in votes.items())
                if (gain := n - votes[at[v]]) > 0:
                    asked.append((max(0, min(15, 24 - gain.bit_length())) * 16 + bucket(16, "in", v), v, -to))
        counts = np.zeros((shards, shards, 256))
        for r, v, to in asked:
            counts[at[v], to, r] += nodes[v]
        limits, _ = sharding.grants(counts, load, quota)
        new = {v: to for r, v, to in asked if r < limits[at[v], to]}
        at |= new
    return at


def clusters(seed, n=400):
    """Nodes of one to three rows in chained clusters, and a hub that many share."""
    r = random.Random(seed)
    nodes = {f"n{i}": r.choice([1, 1, 1, 2, 3]) for i in range(n)}
    links = {(f"n{i}", i // 9) for i in range(n)} | {(f"n{i}", (i + 2) // 9) for i in range(n)} | {(f"n{i}", 1000) for i in range(n) if r.random() < 0.3}
    return nodes, links


@pytest.mark.parametrize("rounds", [0, 1, 5])
def test_propagation_against_a_plain_version(spark, rounds):
    nodes, links = clusters(rounds)
    quota = -(-sum(nodes.values()) // 4)
    made = sharding.propagate(spark.createDataFrame([*nodes.items()], "node string, rows long"), spark.createDataFrame([*links], "node string, hub long"), quota, 4, rounds)
    assert {r.node: r.shard for r in made.collect()} == plain(nodes, links, quota, 4, rounds)


def test_rounds_cut_fewer_links(spark):
    nodes, links = clusters(3)
    quota = -(-sum(nodes.values()) // 4)
    v, e = spark.createDataFrame([*nodes.items()], "node string, rows long"), spark.createDataFrame([*links], "node string, hub long")
    cuts = []
    for rounds in (0, 4, 8):
        at = sharding.propagate(v, e, quota, 4, rounds)
        load = {r.shard: r.n for r in at.groupBy("shard").agg({"rows": "sum"}).toDF("shard", "n").collect()}
        first = load if not rounds else first
        assert all(n <= max(quota, first.get(k, 0)) for k, n in load.items())
        links_, cut = sharding.cut_links(e, at).first()
        where = {r.node: r.shard for r in at.collect()}
        by = defaultdict(Counter)
        for w, h in links:
            by[h][where[w]] += 1
        assert (links_, cut) == (len(links), sum(sum(c.values()) - max(c.values()) for c in by.values()))
        cuts.append(cut)
    assert cuts[1] < 0.8 * cuts[0] and cuts[2] <= cuts[1]


def test_near_copies_move_together(spark):
    base = [words(120, 900 + i) for i in range(30)]
    docs = documents(spark, [f"{b} {words(2, 10 * i + k)}" for i, b in enumerate(base) for k in range(6)] + [words(40, 5000 + i) for i in range(200)])
    group = {(i * 7919) % 100003: i // 6 for i in range(180)}

    def apart(rounds):
        out = sharding.sharded_documents(docs, rounds=rounds).collect()
        check(docs, out)
        by = defaultdict(Counter)
        for r in out:
            if r.doc_id in group:
                by[group[r.doc_id]][r.shard] += 1
        return sum(6 - max(c.values()) for c in by.values())

    before, after = apart(0), apart(6)
    assert before > 90 and after < 0.4 * before


def test_grants_keep_quotas():
    r = np.random.default_rng(1)
    for _ in range(200):
        n = r.integers(2, 9)
        counts, load = r.integers(0, 20, (n, n, 16)) * (1 - np.eye(n))[:, :, None], r.integers(0, 300, n).astype(float)
        quota = load.mean() * r.uniform(1, 1.2)
        taken, real = sharding.grants(counts, load, quota)
        assert all(real[a, b] == counts[a, b, : taken[a, b]].sum() for a in range(n) for b in range(n))
        assert (load + real.sum(0) - real.sum(1) <= np.maximum(load, quota) + 1e-3).all()
