"""Quantiles and empirical percentiles of keys of any size, without sorting a key in one task.

Values fall into classes of a few thousand at most by their logarithm. Counts of classes, a small table, say where
each class begins; values are ordered only within their class.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def class_of(value: Column, an_octave: int = 256) -> Column:
    return F.floor(F.log2(value + 1) * an_octave).cast("int")


def _starts(values: DataFrame, keys: list[str]) -> DataFrame:
    """keys, _c, _n, _first (rows of lower classes), _total of values (keys, _c, n)."""
    classes = values.groupBy(*keys, "_c").agg(F.sum("n").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    return classes.withColumns({"_first": F.coalesce(F.sum("_n").over(before), F.lit(0)), "_total": F.sum("_n").over(Window.partitionBy(*keys))})


def _counted(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, value, n: how many rows have each value; rows may bring a column n, and count so often."""
    return rows.groupBy(*keys, value).agg((F.sum("n") if "n" in rows.columns else F.count(F.lit(1))).alias("n"))


def quantiles(rows: DataFrame, keys: list[str], fractions: Callable[[Column], Column]) -> DataFrame:
    """keys, total, q: the exact, linearly interpolated quantiles of rows (keys, value >= 0, and n where a row stands for more).

    fractions(total) is the array of fractions asked for, up to a few dozen; q has their quantiles in the same order.
    Keys without rows are absent.
    """
    values = _counted(rows, keys, "value").withColumn("_c", class_of(F.col("value")))
    classes = _starts(values, keys).where(F.exists(fractions(F.col("_total")), lambda p: _reaches(F.col("_first"), F.col("_n"), p)))
    return picked(values.join(classes, [*keys, "_c"]), keys, fractions).drop("below")


def _rank(p: Column) -> Column:
    return p * (F.col("_total") - 1)


def _reaches(first: Column, n: Column, p: Column) -> Column:
    """Whether n rows behind so many hold one of the two that a quantile lies between."""
    return (F.floor(_rank(p)) < first + n) & (F.least(F.floor(_rank(p)) + 1, F.col("_total") - 1) >= first)


def picked(held: DataFrame, keys: list[str], fractions: Callable[[Column], Column]) -> DataFrame:
    """keys, total, q, below of held, the values (keys, value, n) of those classes (_c, with _first and _total) in which the
    quantiles lie; below has how many rows of the key are less than each quantile."""
    within = Window.partitionBy(*keys, "_c").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    held = held.withColumn("_at", F.col("_first") + F.coalesce(F.sum("n").over(within), F.lit(0)))
    asked = F.transform(fractions(F.col("_total")), lambda p, i: F.struct(i.alias("i"), p.alias("p")))
    hits = held.select(*keys, "_total", "value", "_at", "n", F.explode(F.filter(asked, lambda x: _reaches(F.col("_at"), F.col("n"), x["p"]))).alias("x"))
    at = lambda r: (F.col("_at") <= r) & (r < F.col("_at") + F.col("n"))
    place = _rank(F.col("x.p"))
    here = F.struct("value", "_at", (F.col("_at") + F.col("n")).alias("to"))
    low, high = F.max(F.when(at(F.floor(place)), here)), F.max(F.when(at(F.least(F.floor(place) + 1, F.col("_total") - 1)), here))
    found = hits.groupBy(*keys, F.col("_total").alias("total"), F.col("x.i").alias("i")).agg(low.alias("low"), high.alias("high"), F.max(place - F.floor(place)).alias("_part"))
    found = found.withColumn("v", F.col("low.value") + (F.col("high.value") - F.col("low.value")) * F.col("_part"))
    less = F.when(F.col("v") <= F.col("low.value"), F.col("low._at")).when(F.col("v") <= F.col("high.value"), F.col("high._at")).otherwise(F.col("high.to"))
    out = found.groupBy(*keys, "total").agg(F.array_sort(F.collect_list(F.struct("i", "v", less.alias("less")))).alias("_q"))  # a fraction each
    return out.select(*keys, "total", F.transform("_q", lambda x: x["v"]).alias("q"), F.transform("_q", lambda x: x["less"]).alias("below"))


def empirical(rows: DataFrame, known: DataFrame, keys: list[str], value: str) -> DataFrame:
    """rows with percentile: the share of their key's known values (each n times, where known has n) that are at most their
    own. Keys that known lacks are left out."""
    own = [c for c in rows.columns if c not in (*keys, value)]
    both = rows.select(*keys, value, F.struct(*own).alias("_row"), F.lit(0).cast("long").alias("n")).unionByName(known.select(*keys, value, (F.col("n") if "n" in known.columns else F.lit(1)).cast("long").alias("n")), allowMissingColumns=True)
    both = both.withColumn("_c", class_of(F.col(value)))
    upto = Window.partitionBy(*keys, "_c").orderBy(value).rangeBetween(Window.unboundedPreceding, 0)
    ranked = both.withColumn("_at", F.sum("n").over(upto)).where("_row IS NOT NULL").join(_starts(both, keys).where("_total > 0"), [*keys, "_c"])
    return ranked.select(*keys, value, "_row.*", ((F.col("_first") + F.col("_at")) / F.col("_total")).alias("percentile"))
