"""SimHash near-duplicates by exact comparison of tiles of fingerprints."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .components import connected_components

SHINGLE = 3
RADIUS = 2
SEED = 42
TILE = 1024
#: Parts of a fingerprint whose population counts place it in a tile.
PARTS, PART_BITS = 4, 16
BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The signed 64 bits of a whole text; 0 where it has no words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes: A-Z and ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - shingle + 1)
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[:n].tolist(), ends[min(shingle, len(words)) - 1 :].tolist(), strict=True)
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in spans), np.dtype("<u8"), n).view(np.uint8).reshape(n, 8)
    votes = np.stack([np.bincount(hashes[:, k], minlength=256) for k in range(8)]) @ BYTE_BITS
    return int(np.packbits((2 * votes > n).ravel(), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, bits (long) for every row."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [fingerprint(x.as_py()) for x in batch.column(1)]
            yield pa.record_batch([batch.column(0), pa.array(made, pa.int64())], ["doc_id", "bits"])

    kind = docs.schema[id].dataType.simpleString()
    return docs.select(F.col(id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(rows, f"doc_id {kind}, bits long")


def tile_links(x: np.ndarray, y: np.ndarray | None, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Links between x and y (or within x) that join all that lie within radius: at most four for each fingerprint."""
    own = y is None
    y = x if own else y
    near = np.bitwise_count((x[:, None] ^ y[None, :]).view(np.uint64)) <= radius
    if own:
        near = np.triu(near, 1)
    i, j = np.nonzero(near)
    if len(i) <= 4 * (len(x) + len(y)):
        return x[i], y[j]
    j = j if own else j + len(x)
    names = x if own else np.concatenate([x, y])
    root = np.arange(len(names))
    while True:  # to the least of the neighbours, then of their roots
        least = root.copy()
        np.minimum.at(least, i, root[j])
        np.minimum.at(least, j, root[i])
        least = least[least]
        if (least == root).all():
            break
        root = least
    hooked = np.flatnonzero(root != np.arange(len(names)))
    return names[hooked], names[root[hooked]]


def part_counts(bits):
    mask = (1 << PART_BITS) - 1
    return [F.bit_count(F.shiftright(bits, PART_BITS * k).bitwiseAND(F.lit(mask))) for k in range(PARTS)]


def near_pairs(distinct: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """Links (a, b) between the distinct fingerprints (column bits) that join all within radius of each other.

    A tile holds up to some tile fingerprints with the same population counts in each of four parts. Two fingerprints
    within radius differ by at most radius in the sum of these counts' differences, so only tiles that near are
    paired: all others are skipped unseen, and nothing within radius is. Compared by numpy's exclusive-or and bit count.
    """
    base = PART_BITS + 1
    code = sum((c * base**k for k, c in enumerate(part_counts(F.col("bits")))), F.lit(0))
    coded = distinct.select("bits", code.cast("long").alias("code"))
    # at most 17^4 codes, whatever the input
    sizes = coded.groupBy("code").agg(F.ceil(F.count(F.lit(1)) / tile).alias("tiles"))
    tiles = coded.join(F.broadcast(sizes), "code").groupBy("code", F.pmod(F.xxhash64("bits"), F.col("tiles")).alias("no")).agg(F.collect_list("bits").alias("held"))
    tiles = cut(tiles)
    steps = [d for d in product(range(-radius, radius + 1), repeat=PARTS) if sum(map(abs, d)) <= radius and d >= (0,) * PARTS]
    counts = [F.floor(F.col("code") / base**k) % base for k in range(PARTS)]
    reach = F.filter(
        F.array(*[F.struct(*[(counts[k] + d[k]).alias(f"c{k}") for k in range(PARTS)]) for d in steps]),
        lambda s: F.forall(F.array(*[s[f"c{k}"] for k in range(PARTS)]), lambda c: (c >= 0) & (c < base)),
    )
    # each tile goes to every tile of each code in reach, by code and number, so that a common code is many keys
    left = tiles.select(F.col("code").alias("own"), F.col("no").alias("own_no"), F.col("held").alias("x"), F.explode(reach).alias("s"))
    left = left.select("own", "own_no", "x", sum((F.col(f"s.c{k}") * base**k for k in range(PARTS)), F.lit(0)).cast("long").alias("code"))
    first = F.when(F.col("code") == F.col("own"), F.col("own_no")).otherwise(0)
    left = left.join(F.broadcast(sizes), "code").withColumn("no", F.explode(F.sequence(first, F.col("tiles") - 1))).drop("tiles")
    pairs = left.join(tiles, ["code", "no"])
    pairs = pairs.select("x", "held", ((F.col("code") == F.col("own")) & (F.col("no") == F.col("own_no"))).alias("same"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            for x, y, same in zip(*batch.columns, strict=True):
                i, j = tile_links(x.values.to_numpy(), None if same.as_py() else y.values.to_numpy(), radius)
                a.append(i), b.append(j)
            yield pa.record_batch([pa.array(np.concatenate(z) if z else np.array([], np.int64), pa.int64()) for z in (a, b)], ["a", "b"])

    return pairs.mapInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fingerprint (hex), component_id of every row; component_id is the least id reachable over links.

    Equal fingerprints are one node; documents without words have fingerprint 0 and are linked like any other. Ids
    should be unique; rows that repeat an id keep their rows. A null id never names a component unless all its ids
    are null. Other columns are left out.
    """
    made = cut(fingerprints(docs, id, text))
    nodes = cut(made.groupBy("bits").agg(F.min("doc_id").alias("least")))
    roots = connected_components(near_pairs(nodes, radius))
    rooted = nodes.join(roots, nodes.bits == roots.id, "left").select("bits", "least", F.coalesce("root", "bits").alias("root"))
    names = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(names, "root").select("bits", "component_id")
    return made.join(named, "bits").select("doc_id", F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), "component_id")


def first_of_each(docs: DataFrame, radius: int = RADIUS, id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one row for each group of near duplicates: that of the least id. Rows without an id are kept."""
    kept = near_duplicates(docs, radius, id, text).where(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias(id)).distinct()
    named = docs.where(F.col(id).isNotNull()).join(kept, id, "left_semi").dropDuplicates([id])
    return named.select(*docs.columns).unionByName(docs.where(F.col(id).isNull()))
