"""How much history there is, and what detectors and models could start from it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..settings import BASELINE, BASELINE_SIZES, HISTORY_DAYS
from .features import DAY_MS
from .models import MIN_MEMBERS, MIN_ROWS


def _missing(limit: int, have: str):
    return F.greatest(F.lit(0).cast("long"), F.lit(limit) - F.col(have))


def window_readiness(windows: DataFrame, peers: DataFrame, to_ms: int, days: int = HISTORY_DAYS, config: dict = BASELINE) -> DataFrame:
    """A row for each scope (global, peer_group), group and window size of the history that ends at to_ms.

    Counts windows, users and UTC days by users and days first, so that no distinct count sees all windows. Groups and
    sizes without any window have rows of zeros. configured_members: users of the group, with or without windows.
    """
    rows = windows.where(F.col("window_size").isin(*BASELINE_SIZES) & (F.col("window_start") >= to_ms - days * DAY_MS) & (F.col("window_start") < to_ms) & (F.col("event_count") > 0))
    day = F.floor(F.col("window_start") / DAY_MS)
    parts = rows.groupBy("user_name", "window_size", day.alias("day")).agg(F.count(F.lit(1)).alias("n"))
    scope = lambda kind, group: F.struct(F.lit(kind).alias("scope"), group.alias("group_id"))
    named = parts.join(peers.select("user_name", "group_id"), "user_name", "left")
    named = named.withColumn("_s", F.explode(F.array_compact(F.array(scope("global", F.lit("")), F.when(F.col("group_id").isNotNull(), scope("peer_group", F.col("group_id"))))))).select("user_name", "window_size", "day", "n", "_s.*")
    keys = ["scope", "group_id", "window_size"]
    users = named.groupBy(*keys, "user_name").agg(F.sum("n").alias("n")).groupBy(*keys).agg(F.sum("n").alias("sample_count"), F.count(F.lit(1)).alias("user_count"))
    active = named.select(*keys, "day").distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("active_days"))
    spark = windows.sparkSession
    sizes = spark.createDataFrame([(s,) for s in BASELINE_SIZES], "window_size int")
    groups = peers.groupBy(F.lit("peer_group").alias("scope"), "group_id").agg(F.count_distinct("user_name").alias("configured_members"))
    every = groups.unionByName(spark.createDataFrame([("global", "", None)], "scope string, group_id string, configured_members long"))
    out = every.crossJoin(F.broadcast(sizes)).join(users, keys, "left").join(active, keys, "left").fillna(0, ["sample_count", "user_count", "active_days"])
    peer = F.col("scope") == "peer_group"
    at_least = lambda c, name: F.col(c) >= F.when(peer, max(config[f"min_{name}"], config[f"min_peer_{name}"])).otherwise(config[f"min_{name}"])
    members = lambda least: ~peer | (F.col("user_count") >= least)
    return out.withColumns({
        "statistical_ready": at_least("active_days", "active_days") & at_least("sample_count", "samples") & members(config["min_peer_members"]), "model_ready": (F.col("sample_count") >= MIN_ROWS) & members(MIN_MEMBERS),
        "missing_samples": F.when(peer, _missing(config["min_peer_samples"], "sample_count")).otherwise(_missing(config["min_samples"], "sample_count")),
        "missing_active_days": F.when(peer, _missing(config["min_peer_active_days"], "active_days")).otherwise(_missing(config["min_active_days"], "active_days")),
        "missing_members": F.when(peer, _missing(config["min_peer_members"], "user_count")).otherwise(0), "missing_model_samples": _missing(MIN_ROWS, "sample_count"),
    })


def history(bounds: DataFrame, windows: DataFrame, to_ms: int, days: int = HISTORY_DAYS) -> DataFrame:
    """One row: first and latest event, UTC days spanned, active, observed and missing of the days before to_ms."""
    ends = bounds.agg(F.min("first_time_ms").alias("first_event_ms"), F.max("last_time_ms").alias("latest_event_ms"))
    active = windows.where((F.col("window_size") == 86_400) & (F.col("window_start") >= to_ms - days * DAY_MS) & (F.col("window_start") < to_ms)).select("window_start").distinct().agg(F.count(F.lit(1)).alias("active_utc_days"))
    floor = lambda c: F.col(c) - F.pmod(c, F.lit(DAY_MS))
    end = F.least(F.lit(to_ms), floor("latest_event_ms") + DAY_MS)
    span = lambda start: F.greatest(F.lit(0).cast("long"), F.floor((end - start) / DAY_MS))
    rows = ends.crossJoin(F.broadcast(active)).withColumns({"calendar_span_days": span(floor("first_event_ms")), "observed_days": span(F.greatest(floor("first_event_ms"), F.lit(to_ms - days * DAY_MS)))})
    return rows.withColumns({"missing_days": F.greatest(F.lit(0).cast("long"), days - F.col("observed_days")), "ready": F.col("observed_days") >= days})


def detectors(windows: DataFrame, past: DataFrame) -> DataFrame:
    """detector_id, by_everyone, by_peers: whether statistical, hbos and isolation_forest detectors have what they need.

    windows is window_readiness, past is history. Of peer groups one that is ready in all sizes is enough.
    """
    kinds = F.explode(F.array(F.struct(F.lit("statistical").alias("detector_id"), F.col("statistical_ready").alias("ok")), F.struct(F.lit("hbos").alias("detector_id"), F.col("model_ready").alias("ok")), F.struct(F.lit("isolation_forest").alias("detector_id"), F.col("model_ready").alias("ok"))))
    groups = windows.select("scope", "group_id", kinds.alias("k")).groupBy("k.detector_id", "scope", "group_id").agg(F.bool_and("k.ok").alias("ok"))
    out = groups.groupBy("detector_id").agg(F.bool_or(F.expr("scope = 'global' AND ok")).alias("by_everyone"), F.bool_or(F.expr("scope = 'peer_group' AND ok")).alias("by_peers"))
    rows = out.crossJoin(F.broadcast(past.select(F.col("ready").alias("_past"))))
    return rows.select("detector_id", (F.col("by_everyone") & F.col("_past")).alias("by_everyone"), (F.col("by_peers") & F.col("_past")).alias("by_peers"))


def next_actions(windows: DataFrame, past: DataFrame) -> DataFrame:
    """priority, kind, window_size, subject, amount of what to do next, by priority, kind, size and subject."""
    kinds = lambda p, kind, size, subject, amount: [F.lit(p).alias("priority"), F.lit(kind).alias("kind"), size.cast("int").alias("window_size"), subject.alias("subject"), amount.cast("long").alias("amount")]
    none = F.lit(None)
    collect = past.where("missing_days > 0").select(*kinds(1, "collect_history", none, F.lit(""), F.col("missing_days")))
    more = windows.where("scope = 'global' AND missing_model_samples > 0").select(*kinds(2, "collect_windows", F.col("window_size"), F.lit(""), F.col("missing_model_samples")))
    small = windows.where((F.col("scope") == "peer_group") & (F.col("configured_members") < MIN_MEMBERS)).groupBy("group_id").agg(F.max("configured_members").alias("n"))
    peers = small.select(*kinds(3, "expand_peer_groups", none, F.col("group_id"), MIN_MEMBERS - F.col("n")))
    able = detectors(windows, past).agg(F.bool_and(F.expr("by_everyone OR by_peers")).alias("ok")).where("ok").select(*kinds(4, "run_benchmark", none, F.lit(""), none))
    return collect.unionByName(more).unionByName(peers).unionByName(able).orderBy("priority", "kind", "window_size", "subject")
