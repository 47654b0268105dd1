"""Shards by balanced label propagation over links between documents."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, hash_bucket, ranked

SHARDS = 8
ROUNDS = 6
ROWS_A_BUCKET = 4000
#: Words of a shingle, and how many of a text's shingles (those of least hash) link it to others.
SHINGLE, SKETCH = 5, 4
#: Votes of a hub are parts of this, so that sums do not depend on their order.
UNIT = 1_000_000
GAINS, SPREAD = 16, 16


def sketch(raw: bytes, shingle: int = SHINGLE, size: int = SKETCH) -> list[int]:
    """The least hashes of the shingles of a text; texts that share most shingles share most of them."""
    words = raw.split()  # of bytes: ASCII white space only
    if not words:
        return []
    h = np.fromiter(map(zlib.crc32, words), np.uint64, len(words))
    n, width = max(1, len(words) - shingle + 1), min(shingle, len(words))
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out = (out ^ h[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return np.unique(out)[:size].view(np.int64).tolist()


def described(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, same (names equal texts) and hubs (shingles that link texts) of every row."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, crc, same, hubs = [], [], [], []
            for x in batch.column(1):
                raw = x.as_buffer().to_pybytes() if x.is_valid else b""
                size.append(len(raw) + 1), crc.append(zlib.crc32(raw)), hubs.append(sketch(raw))
                same.append(hashlib.md5(raw, usedforsecurity=False).hexdigest())
            columns = [batch.column(0), pa.array(size, pa.int64()), pa.array(crc, pa.int64()), pa.array(same, pa.string()), pa.array(hubs, pa.list_(pa.int64()))]
            yield pa.record_batch(columns, ["doc_id", "size", "text_crc32", "same", "hubs"])

    kind = docs.schema[id].dataType.simpleString()
    schema = f"doc_id {kind}, size long, text_crc32 long, same string, hubs array<long>"
    return docs.select(F.col(id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(rows, schema)


def grants(counts: np.ndarray, load: np.ndarray, quota: float) -> tuple[np.ndarray, np.ndarray]:
    """How many ranks of requests each pair of shards may grant, and the rows that move with them.

    counts[a, b, rank] rows want to go from a to b. Everything is granted at first; what flows into a shard is reduced,
    by whole ranks, until none holds more than quota. A shard that is beyond it already takes nothing in until enough
    has left.
    """
    sums = np.concatenate([np.zeros((*counts.shape[:2], 1)), np.cumsum(counts, axis=2)], axis=2)
    flow = sums[:, :, -1]
    while True:
        taken = (sums <= flow[:, :, None] + 1e-6).sum(2) - 1
        real = np.take_along_axis(sums, taken[:, :, None], axis=2)[:, :, 0]
        over, into = load + real.sum(0) - real.sum(1) - quota, real.sum(0)
        full = (over > 1e-6) & (into > 0)
        if not full.any():
            return taken, real
        flow = real * np.where(full, np.maximum(0.0, 1 - over / np.maximum(into, 1e-9)), 1.0)


def propagate(nodes: DataFrame, links: DataFrame, quota: float, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """node, rows, shard of nodes (node, rows, start if given) after rounds of label propagation over links (node, hub).

    Nodes that share a hub are neighbours; a hub's counts by shard stand for its nodes, so a hub of any size is as many
    rows as there are shards. Nodes begin in shard start, else where their hash puts them. In a round each node (one half of them, by hash,
    so that neighbours do not swap places for ever) sums its neighbours' rows by shard, each hub's in parts of the
    hub's rows, and asks for the shard with most if that is more than its own has. Requests are granted by gain and
    then by hash while no shard holds more than quota rows. The driver sees the loads and, for each pair of shards,
    GAINS * SPREAD counts.
    """
    start = F.col("start") if "start" in nodes.columns else hash_bucket(shards, "node")
    labels = cut(nodes.select("node", "rows", start.cast("int").alias("shard")))
    for number in range(rounds):
        load = np.zeros(shards)
        for r in labels.groupBy("shard").agg(F.sum("rows").alias("n")).collect():
            load[r.shard] = r.n
        at = links.join(labels, "node")
        held = at.groupBy("hub", "shard").agg(F.sum("rows").alias("n"))
        hubs = held.groupBy("hub").agg(F.sum("n").alias("all"), F.collect_list(F.struct("shard", "n")).alias("held"))  # a row for each shard at most
        mine = at.where(hash_bucket(2, F.lit(str(number)), "node") == 0).select("hub", "node", "rows", F.col("shard").alias("own"))
        near = mine.join(hubs, "hub").select("node", "rows", "own", "all", F.explode("held").alias("h"))
        others = F.col("h.n") - F.when(F.col("h.shard") == F.col("own"), F.col("rows")).otherwise(0)
        votes = near.groupBy("node", "rows", "own", F.col("h.shard").alias("to")).agg(F.sum(F.floor(others * UNIT / F.col("all"))).alias("n"))
        best = F.max(F.struct("n", (-F.col("to")).alias("to")))
        own = F.coalesce(F.max(F.when(F.col("to") == F.col("own"), F.col("n"))), F.lit(0))
        asked = votes.groupBy("node", "rows", "own").agg(best.alias("best"), own.alias("stay"))
        gain = F.col("best.n") - F.col("stay")
        rank = F.greatest(F.lit(0), F.least(F.lit(GAINS - 1), 24 - F.length(F.bin(gain)))) * SPREAD + hash_bucket(SPREAD, F.lit("in"), "node")
        asked = asked.where(gain > 0).select("node", "rows", "own", (-F.col("best.to")).alias("to"), rank.cast("int").alias("rank"))
        asked = cut(asked)
        counts = np.zeros((shards, shards, GAINS * SPREAD))
        for r in asked.groupBy("own", "to", "rank").agg(F.sum("rows").alias("n")).collect():
            counts[r.own, r.to, r["rank"]] = r.n
        limits, moved = grants(counts, load, quota)
        if not moved.any():
            if number % 2:
                break
            continue
        limit = F.get(F.lit(limits.ravel().tolist()), F.col("own") * shards + F.col("to"))
        moves = asked.where(F.col("rank") < limit).select("node", F.col("to").alias("new"))
        labels = cut(labels.join(moves, "node", "left").select("node", "rows", F.coalesce("new", "shard").cast("int").alias("shard")))
    return labels


def cut_links(links: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: links, and how many of them are cut: of each hub's, those to nodes outside the shard with most of them."""
    held = links.join(labels, "node").groupBy("hub", "shard").agg(F.count(F.lit(1)).alias("n"))
    hubs = held.groupBy("hub").agg(F.sum("n").alias("all"), F.max("n").alias("most"))
    return hubs.agg(F.coalesce(F.sum("all"), F.lit(0)).alias("links"), F.coalesce(F.sum(F.col("all") - F.col("most")), F.lit(0)).alias("cut"))


def level_rows(rows: DataFrame, total: int, shards: int, bucket: Column, order: list[Column]) -> DataFrame:
    """rows (with shard, null where any will do) with shard and slot such that shards' counts differ by one at most and
    slots have no gaps. What lies beyond a shard's quota, last in the order of bucket and order, takes free slots of
    the others, as rows without a shard do."""
    settled = rows.where("shard IS NOT NULL")
    counts = {r.shard: r.n for r in settled.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()}
    quota = [total // shards + (k < total % shards) for k in range(shards)]
    have = [min(counts.get(k, 0), quota[k]) for k in range(shards)]
    edge = F.get(F.lit(quota), F.col("shard"))
    placed = cut(ranked(settled, ["shard"], bucket, order, "slot"))
    stay = placed.where(F.col("slot") < edge)
    free = placed.where(F.col("slot") >= edge).drop("slot").unionByName(rows.where("shard IS NULL"))
    n = max(1, -(-total // ROWS_A_BUCKET))
    free = ranked(free.withColumn("_all", F.lit(0)), ["_all"], F.pmod(F.xxhash64("same", "doc_id"), F.lit(n)), order, "_at")
    edges, at = [], 0
    for k in range(shards):
        if have[k] < quota[k]:
            edges.append((k, at, at + quota[k] - have[k], have[k]))
            at += quota[k] - have[k]
    gaps = rows.sparkSession.createDataFrame(edges, "_to int, _lo long, _hi long, _first long")  # shards rows at most
    moved = free.join(F.broadcast(gaps), (F.col("_at") >= F.col("_lo")) & (F.col("_at") < F.col("_hi")))
    moved = moved.withColumns({"shard": F.col("_to"), "slot": F.col("_first") + F.col("_at") - F.col("_lo")})
    return stay.unionByName(moved.select(*stay.columns))


def graph(rows: DataFrame, total: int, shards: int = SHARDS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """rows (see described) with node; nodes (node, rows, start); links (node, hub) through hubs that two nodes share.

    Equal texts are one node, so that they stay together; only a text that fills over half a shard is dealt into nodes
    of a sixteenth, twelve of which start in a shard, then twelve in the next. There are at most 2 * shards such texts.
    """
    quota = max(1, -(-total // shards))
    part = max(1, quota // 16)
    large = rows.groupBy("same").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > quota / 2).select("same", F.ceil(F.col("n") / part).alias("_parts"))
    named = rows.join(F.broadcast(large), "same", "left")
    named = named.withColumn("_part", hash_bucket(F.coalesce("_parts", F.lit(1)), F.lit("part"), "doc_id"))
    node = F.when(F.col("_parts").isNull(), F.col("same")).otherwise(F.concat_ws(":", "same", F.col("_part").cast("string")))
    start = F.pmod(hash_bucket(shards, "same") + F.floor(F.col("_part") / 12), F.lit(shards)).cast("int")
    named = cut(named.withColumns({"node": node, "start": start}).drop("_parts", "_part"))
    nodes = cut(named.groupBy("node", "start").agg(F.count(F.lit(1)).alias("rows"), F.any_value("hubs").alias("hubs")))
    ends = nodes.select("node", F.explode("hubs").alias("hub"))
    shared = ends.groupBy("hub").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("hub")
    return named.drop("hubs", "start"), nodes.drop("hubs"), cut(ends.join(shared, "hub").select("node", "hub"))


def sharded_documents(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS, id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law ('rows'), shard, slot, grown_shard (null) of every row.

    Equal texts (null counts as empty) are one node; nodes are linked where they share one of the least SKETCH hashes of
    their five-word shingles. Shards' counts of rows differ by one at most; rows without links or copies level them.
    Repeated rows are rows of their own and stay together, rows with null ids too. An empty table gives no rows.
    """
    rows = cut(described(docs, id, text))
    total = rows.count()
    named, nodes, links = graph(rows, total, shards)
    tied = nodes.join(links.select("node").distinct(), "node", "left_semi")
    alone = nodes.where("rows > 1").join(links.select("node").distinct(), "node", "left_anti")
    labels = propagate(tied.unionByName(alone), links, max(1, -(-total // shards)), shards, rounds)
    placed = named.join(labels.withColumnRenamed("rows", "_rows"), "node", "left")
    n = max(1, -(-total // ROWS_A_BUCKET))
    # a node's rows follow each other, in several buckets where they are many; nodes of one row come last
    parts = F.greatest(F.lit(1), F.ceil(F.col("_rows") / ROWS_A_BUCKET))
    bucket = (hash_bucket(n, "node") + F.when(F.col("_rows") > 1, 0).otherwise(n)) * (n + 1) + hash_bucket(parts, F.lit("at"), "doc_id")
    out = level_rows(placed, total, shards, bucket, [F.col("node"), F.col("doc_id")])
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
