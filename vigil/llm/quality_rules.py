"""Quality rules of a document, failure rates of its host, and the host's verdict joined back. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, cut, let, table

WINDOW = 5
#: Up to so many rejected hosts (a name each) are broadcast; more are joined by shuffle.
MAX_BROADCAST_HOSTS = 10_000


def repeated_words(words: Column, n: int = WINDOW) -> Column:
    """Words covered by windows of n words that occur at least twice in the array, first occurrences included."""

    def covered(at: Column) -> Column:
        ends = F.concat(F.slice(at, 2, F.size(at)), F.array(F.element_at(at, -1) + n))
        return F.aggregate(F.zip_with(at, ends, lambda a, b: F.least(b - a, F.lit(n))), F.lit(0), lambda s, x: s + x)

    def twice(s: Column) -> Column:
        same = lambda i, j: s[i]["w"] == s[j]["w"]
        last = F.size(s) - 1
        at = F.filter(F.sequence(F.lit(0), last), lambda i: F.when(i > 0, same(i, i - 1)).otherwise(False) | F.when(i < last, same(i, i + 1)).otherwise(False))
        return let(F.sort_array(F.transform(at, lambda i: s[i]["i"])), covered)

    def among(grams: Column) -> Column:
        pairs = F.transform(grams, lambda w, i: F.struct(w.alias("w"), i.alias("i")))
        return F.when(F.size(F.array_distinct(grams)) == F.size(grams), F.lit(0)).otherwise(let(F.sort_array(pairs), twice))

    def of(w: Column) -> Column:
        grams = F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.concat_ws(" ", *[w[i + k] for k in range(n)]))
        return F.when(F.size(w) < n, F.lit(0)).otherwise(let(grams, among))

    return let(words, of).cast("long")


def rule_columns(text: Column) -> dict[str, Column]:
    """The base counts of a whole text; null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    # lambdas see each array once computed: without let, every element would split the text anew
    stats = let(
        F.filter(F.split(text, SPACE), lambda w: w != ""),
        lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"), repeated_words(w).alias("n_repeat_words")),
    )
    lines = let(F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")), lambda x: F.size(x) - F.size(F.array_distinct(x)))
    return {"stats": stats, "n_symbols": F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long"), "n_dup_lines": lines.cast("long")}


def rule_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed and soft_failed.

    base_failed: under 10 words, or over 20 % of the words in repeated windows. soft_failed: base_failed, or over
    10 % as many symbols as word characters, or 3 repeated lines and more. An empty or null text has no words and fails.
    """
    made = rule_columns(F.col(text))
    out = docs.withColumn("_stats", made.pop("stats"))
    out = out.withColumns({**{k: F.col(f"_stats.{k}") for k in ("n_words", "word_chars", "n_repeat_words")}, **made}).drop("_stats")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    soft = failed | (10 * F.col("n_symbols") > F.col("word_chars")) | (F.col("n_dup_lines") >= 3)
    return out.withColumns({"base_failed": failed, "soft_failed": soft})


def host_verdicts(counted: DataFrame, host: str = "source", limit: float = 0.5) -> DataFrame:
    """One row for each host (null is a host of its own): documents, failures, shrunk rate, host_rejected.

    The rate is shrunk by a beta prior fitted to all hosts' rates by moments; with fewer than two hosts, or rates
    that vary no more than one host's, the prior is the pooled rate with a weight of one document.
    """
    hosts = counted.groupBy(F.col(host).alias("host")).agg(F.count(F.lit(1)).alias("host_docs"), F.sum(F.col("soft_failed").cast("long")).alias("host_failures"))
    rates = hosts.withColumn("rate", F.col("host_failures") / F.col("host_docs"))
    m, v, fails, n = rates.agg(F.avg("rate"), F.var_samp("rate"), F.sum("host_failures"), F.sum("host_docs")).first()  # one row, whatever the number of hosts
    if m is None:
        mean, weight = 0.0, 1.0
    elif not v or m * (1 - m) / v <= 1:
        mean, weight = fails / n, 1.0
    else:
        mean, weight = m, m * (1 - m) / v - 1
    shrunk = (F.col("host_failures") + F.lit(mean * weight)) / (F.col("host_docs") + F.lit(weight))
    return rates.select("host", "host_docs", "host_failures", shrunk.alias("host_rate"), (shrunk > limit).alias("host_rejected"))


def quality_verdicts(docs: DataFrame, id: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """doc_id, the five base counts, base_failed, kept, and the host's rate.

    kept: the document passes the base rules and its host is not rejected. Every row of docs gives one row, repeated
    ids too; an empty table gives none. Only the three named columns are read.
    """
    counted = cut(rule_counts(docs.select(F.col(id).alias("doc_id"), F.col(text).alias("text"), F.col(host).alias("host"))).drop("text"))
    hosts = host_verdicts(counted, "host").withColumnRenamed("host", "_host")
    joined = counted.join(hosts, F.col("host").eqNullSafe(F.col("_host")), "left")
    kept = ~F.col("base_failed") & ~F.col("host_rejected")
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "host_rate")


def keep_good(docs: DataFrame, id: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """The rows of docs that quality_verdicts keeps, with docs' own columns. The counts are made once and written beside
    the rows, of which the hosts' rates read two columns; texts are not shuffled."""
    counted = rule_counts(docs.select(F.struct(*docs.columns).alias("_row"), F.col(text).alias("text"), F.col(host).alias("_at")))
    counted = table(counted.select("_row", "_at", "base_failed", "soft_failed"), "counted")
    # a shuffle by host would send all texts of a host to one task
    hosts = cut(host_verdicts(counted, "_at").where("host_rejected").select(F.col("host").alias("_host")))
    hosts = F.broadcast(hosts) if hosts.count() <= MAX_BROADCAST_HOSTS else hosts
    return counted.where(~F.col("base_failed")).join(hosts, F.col("_at").eqNullSafe(F.col("_host")), "left_anti").select("_row.*")


#: The same rows by DuckDB; host_rate is rounded there and here.
ORACLE = r"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text FROM documents),
words AS (SELECT rid, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM docs),
pos AS (SELECT rid, w, unnest(range(1, len(w) - 3)) AS i FROM words WHERE len(w) >= 5),
grams AS (SELECT rid, i, array_to_string(w[i:i + 4], ' ') AS g FROM pos),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM grams) WHERE n > 1),
rep AS (SELECT rid, count(DISTINCT i + k) AS n FROM twice, range(0, 5) AS r(k) GROUP BY rid),
lines AS (SELECT rid, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM docs),
counts AS (
  SELECT d.rid, d.doc_id, d.source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words
  FROM docs d JOIN words USING (rid) JOIN lines USING (rid) LEFT JOIN rep USING (rid)),
failed AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM counts),
soft AS (SELECT *, base_failed OR 10 * n_symbols > word_chars OR n_dup_lines >= 3 AS soft_failed FROM failed),
hosts AS (SELECT source, count(*) AS n, count(*) FILTER (soft_failed) AS f FROM soft GROUP BY source),
prior AS (SELECT avg(f / n) AS m, var_samp(f / n) AS v, sum(f) / sum(n) AS pooled FROM hosts),
fitted AS (SELECT CASE WHEN v IS NULL OR v = 0 OR m * (1 - m) / v <= 1 THEN pooled ELSE m END AS mean,
  CASE WHEN v IS NULL OR v = 0 OR m * (1 - m) / v <= 1 THEN 1 ELSE m * (1 - m) / v - 1 END AS weight FROM prior),
rates AS (SELECT source, (f + mean * weight) / (n + weight) AS rate FROM hosts, fitted)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT rate > 0.5 AS kept,
  round(rate, 9) AS host_rate
FROM soft JOIN rates ON soft.source IS NOT DISTINCT FROM rates.source
"""
