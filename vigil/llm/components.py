"""Connected components by iterated joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def connected_components(edges: DataFrame) -> DataFrame:
    """id, root (the least id that can be reached) of every id of edges (a, b).

    Large-star and small-star steps in turn: neighbours are hooked to the least of them, so a chain halves each time
    and a star stays as it is; each step's edges are cut off their lineage. Minima are pre-aggregated; nothing of a
    component is gathered in a task or on the driver.
    """
    pairs = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    sign = _sign(pairs)
    while True:
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = cut(large)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        pairs = cut(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct())
        now = _sign(pairs)
        if now == sign:
            break
        sign = now
    # stars now: each id's only neighbour is its root
    return pairs.select(F.col("a").alias("id"), F.col("b").alias("root")).unionByName(pairs.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct())


def _sign(pairs: DataFrame) -> tuple:
    return tuple(pairs.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("b", "a").cast("decimal(38,0)"))).first())
