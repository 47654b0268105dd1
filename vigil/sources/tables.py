"""Tables of a data folder, and the canonical view of its event stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ACTIONS = {"view": "repo_read", "click": "repo_clone", "purchase": "repo_write", "signup": "user_login", "error": "repo_status"}
OUTCOMES = {"error": "failure", "signup": "unknown"}
SOURCES = {"signup": "sso", "error": "waf", "purchase": "gitlab"}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def spread(df: DataFrame, *keys: str, rows_a_task: int | None = None) -> DataFrame:
    """df over all cores where it comes in fewer parts than there are, as a small file does; a large one as it is.

    A file's rows come in its row groups, a million in each by some writers, however many parts it is read in. Where rows
    take long, rows_a_task says how many a task is to have at most, and they are dealt however they come; they are counted
    from the files' footers.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if rows_a_task is not None:
        return df.repartition(max(cores, -(-df.count() // rows_a_task)), *keys)
    return df.repartition(cores, *keys) if df.rdd.getNumPartitions() < cores else df


def _case(names: dict[str, str], default: str | None):
    out = None
    for k, v in names.items():
        out = F.when(F.col("event_type") == k, v) if out is None else out.when(F.col("event_type") == k, v)
    return out if default is None else out.otherwise(default)


def canonical_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as accepted events of the analytics."""
    events = spread(read(spark, sf_dir, "events"), "event_id")
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("int")
    micros = F.unix_micros(F.convert_timezone(F.lit("UTC"), F.current_timezone(), F.col("ts")).cast("timestamp"))
    shown = F.concat(F.lit("res-"), k)
    return events.select(
        F.concat(F.lit("evt-"), F.col("event_id")).alias("event_id"), ((micros - F.pmod(micros, F.lit(1000))) / 1000).cast("long").alias("event_time_ms"), F.concat(F.lit("user-"), F.col("user_id")).alias("user_name"),
        _case(SOURCES, "svn").alias("source_type"), F.concat(_case(SOURCES, "svn"), F.lit("-main")).alias("source_id"), _case(ACTIONS, None).alias("action"), _case(OUTCOMES, "success").alias("outcome"),
        F.concat(F.lit("10.0."), F.pmod("user_id", F.lit(256)), F.lit("."), F.pmod(k, F.lit(4))).alias("source_ip"), F.lit("page").alias("resource_type"), shown.alias("resource_name"),
        F.concat(F.lit("page:"), shown).alias("resource_key"), shown.alias("resource_display"), F.floor(F.col("value") * 100).cast("long").alias("network_bytes"),
    )


def peer_groups(events: DataFrame) -> DataFrame:
    """user_name, group_id of the users of canonical_events."""
    users = events.select("user_name").distinct()
    return users.withColumn("group_id", F.concat(F.lit("g"), F.pmod(F.substring_index("user_name", "-", -1).cast("long"), F.lit(3))))
