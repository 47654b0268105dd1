"""Frequent items: counts that merge, cut to a bounded number of items with a bound on what they may lack."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# fixed values: how many templates a summary of quality keeps
LIMIT = 10_000
#: Summaries that were merged in one task when tasks merged them in Python; nothing reads it now.
FAN = 16


def frequent_items(rows: DataFrame, item: str, n: str | None = None, limit: int = LIMIT) -> DataFrame:
    """item, n, error of at most limit items of a column: each occurs n times at least and n + error at most.

    Items that are not listed occur error times at most, and error is at most all counts divided by limit + 1; with no
    more than limit different items all are listed and error is 0. n names a column of counts, such as those of an
    earlier summary. Null and empty items do not count. One aggregation by item, which spills where it must, counts
    them; the count that ranks behind limit is taken off all counts, and those away that have none left. It is found
    from the numbers of items of each count: with equal counts in one row, these are few, whatever the items.
    """
    held = rows.where(F.coalesce(F.col(item), F.lit("")) != "").select(F.col(item).cast("string").alias("item"), (F.lit(1) if n is None else F.col(n)).cast("long").alias("n"))
    counts = held.groupBy("item").agg(F.sum("n").alias("n"))
    ranks = counts.groupBy("n").agg(F.count(F.lit(1)).alias("_k")).withColumn("_to", F.sum("_k").over(Window.orderBy(F.col("n").desc())))
    cut = F.broadcast(ranks.agg(F.coalesce(F.max(F.when(F.col("_to") > limit, F.col("n"))), F.lit(0).cast("long")).alias("error")))  # one row
    return counts.crossJoin(cut).where(F.col("n") > F.col("error")).select("item", (F.col("n") - F.col("error")).alias("n"), "error")
