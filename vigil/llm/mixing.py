"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut, hash_bucket, ranked, table

CAP = 3
ROWS_A_BUCKET = 4000
#: Up to so many sources (of some 100 bytes) are broadcast; more are joined by shuffle.
MAX_BROADCAST_SOURCES = 10_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, cap: int = CAP) -> DataFrame:
    """One row for each source of sized (source, size): source_no, source_size, target.

    Sources by code point, null last, weigh 1, 2, 3, repeating. The shares of all sizes stop at cap times the source's
    own size, the excess going to the others by weight: sorted by the share at which they fill, sources fill one after
    another until the level that the rest would reach stays below the next one's.
    """
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    no = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    rows = sources.withColumn("source_no", no).withColumn("w", ((F.col("source_no") - 1) % 3 + 1).cast("long"))
    rows = rows.withColumn("full", cap * F.col("source_size"))
    order = Window.orderBy(F.col("full") / F.col("w"), "source_no")
    before, every = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(every) - F.coalesce(F.sum("full").over(before), F.lit(0))
    weight = F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0))
    rows = rows.withColumn("level", left / weight)
    open_ = F.col("level") * F.col("w") < F.col("full")
    level = F.first(F.when(open_, F.col("level")), ignorenulls=True).over(every)
    target = F.when(open_, level * F.col("w")).otherwise(F.col("full")).cast("double")
    return rows.select("source", F.col("source_no").cast("long").alias("source_no"), "source_size", target.alias("target"))


def mix(sized: DataFrame, seed: int = 0, source: str = "source", id: str = "doc_id", cap: int = CAP) -> DataFrame:
    """sized (rows with _size, which stay the same when read again) with _source_size, _target and _copies: how often the
    mix takes each document (0 to cap).

    A source's documents all expect target / source_size copies. Ordered by size class, hash and size, their expected
    copies are prefix-sumed from one random offset of the source; a document is emitted once for each integer that its
    stretch crosses, so a source's copies are within one of what is expected in every run of similar sizes. A null
    text has size 0 and null is a source of its own. Rows keep their columns; repeated rows count each.
    """
    narrow = cut(sized.select(F.col(source).alias("source"), F.col("_size").alias("size")).groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")))
    targets = cut(source_targets(narrow.select("source", (F.col("size") * F.col("n")).alias("size")), cap))
    n_sources, (rows,) = targets.count(), narrow.agg(F.coalesce(F.sum("n"), F.lit(0))).first()
    own = targets.select(F.col("source").alias("_source"), F.col("source_no").alias("_no"), F.col("source_size").alias("_source_size"), F.col("target").alias("_target"))
    own = F.broadcast(own) if n_sources <= MAX_BROADCAST_SOURCES else own
    named = sized.join(own, F.col(source).eqNullSafe(F.col("_source"))).drop("_source")
    bits = F.length(F.bin("_size")).cast("long")
    size_class = 8 * bits + F.expr("_size div cast(pow(2, greatest(length(bin(_size)) - 3, 0)) as bigint)")
    n = max(1, -(-rows // ROWS_A_BUCKET))
    placed = ranked(named, ["_no"], size_class * F.lit(n) + hash_bucket(n, id), [F.col("_size"), F.col(id)], "_at")
    rate = F.when(F.col("_source_size") > 0, F.col("_target") / F.col("_source_size")).otherwise(0.0)
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col(source), F.lit("")))), 1, 8), 16, 10).cast("double") / float(1 << 32)
    copies = F.least(F.floor(rate * (F.col("_at") + 1) + offset) - F.floor(rate * F.col("_at") + offset), F.lit(cap))
    return placed.withColumn("_copies", copies.cast("long")).drop("_no", "_at")


def mixed_documents(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """The rows of docs, each as often as the mix takes it. Words are counted once, beside the rows."""
    times = mix(table(docs.withColumn("_size", word_count(F.col(text))), "sized"), **options).where("_copies > 0")
    return times.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int")))).select(*docs.columns)


def mixed_words(docs: DataFrame, seed: int = 0) -> DataFrame:
    """doc_id, size, source_size, target, taken for every row of documents."""
    rows = mix(table(docs.select("doc_id", "source", word_count(F.col("text")).alias("_size")), "sized"), seed)
    return rows.select("doc_id", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), (F.col("_copies") * F.col("_size")).alias("taken"))


ORACLE = rf"""
WITH RECURSIVE d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '{WORD}')), 0) AS BIGINT) AS size FROM documents),
src AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS no FROM d GROUP BY source),
w AS (SELECT *, (no - 1) % 3 + 1 AS w FROM src),
-- the rule as stated: share, stop at three times, share the excess again
fill(k, capped, level) AS (
  SELECT 0, CAST([] AS BIGINT[]), (SELECT sum(source_size) / sum(w) FROM w)
  UNION ALL
  SELECT k + 1, c, (SELECT (SELECT sum(source_size) FROM w) - coalesce(sum(3 * source_size) FILTER (list_contains(c, no)), 0) FROM w) / (SELECT sum(w) FROM w WHERE NOT list_contains(c, no))
  FROM (SELECT k, (SELECT list(no ORDER BY no) FROM w WHERE level * w > 3 * source_size OR list_contains(capped, no)) AS c, capped FROM fill)
  WHERE len(c) > len(capped) AND len(c) < (SELECT count(*) FROM w)),
last AS (SELECT capped, level FROM fill ORDER BY k DESC LIMIT 1),
t AS (SELECT w.*, CAST(CASE WHEN list_contains(capped, no) THEN 3 * source_size ELSE level * w END AS DOUBLE) AS target FROM w, last),
b AS (SELECT greatest(1, CAST(ceil(count(*) / {ROWS_A_BUCKET}.0) AS BIGINT)) AS n FROM d),
o AS (SELECT d.*, t.source_size, t.target, row_number() OVER (PARTITION BY t.no ORDER BY
    8 * length(bin(size)) + size // CAST(pow(2, greatest(length(bin(size)) - 3, 0)) AS BIGINT), CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) % n, size, doc_id) - 1 AS i,
    CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS r, CAST('0x' || substr(md5('0|' || coalesce(d.source, '')), 1, 8) AS BIGINT) / 4294967296.0 AS u
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source, b)
SELECT doc_id, size, source_size, target, CAST(least(floor(r * (i + 1) + u) - floor(r * i + u), 3) AS BIGINT) * size AS taken FROM o
"""
