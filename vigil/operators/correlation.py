"""Incidents: candidates of a user that belong together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..settings import CORRELATION
from .detection import key_of, severity
from .features import DAY_MS


def days(start, end):
    """The UTC days that a half-open range touches."""
    first, last = start - F.pmod(start, F.lit(DAY_MS)), end - 1
    return F.sequence(first, F.greatest(last - F.pmod(last, F.lit(DAY_MS)), first), F.lit(DAY_MS))


def group_keys(candidates: DataFrame, sessions: DataFrame, config: dict = CORRELATION) -> DataFrame:
    """candidates with correlation_key and session_id: the session with most overlap, else the day or hour bucket.

    Of equal overlaps the earliest session wins, then the greater first event. Both sides are spread over the UTC days
    they touch, so that the join is an equality on user and day and no user meets all own sessions.
    """
    short = candidates.where((F.col("window_size") >= 0) & (F.col("window_size") <= config["session_window_s"]))
    left = short.select("candidate_key", "user_name", "window_start", "window_end", F.explode(days(F.col("window_start"), F.col("window_end"))).alias("day"))
    right = sessions.select("user_name", "session_id", "start_time", "last_event_time", "first_event_id", F.explode(days(F.col("start_time"), F.col("last_event_time") + 1)).alias("day"))
    met = left.join(right, ["user_name", "day"]).where((F.col("start_time") < F.col("window_end")) & (F.col("last_event_time") >= F.col("window_start")))
    overlap = F.least(F.col("last_event_time") + 1, F.col("window_end")) - F.greatest("start_time", "window_start")
    best = met.groupBy("user_name", "candidate_key").agg(F.max_by("session_id", F.struct(overlap, -F.col("start_time"), "first_event_id")).alias("session_id"))
    rows = candidates.join(best, ["user_name", "candidate_key"], "left")
    width = config["bucket_s"] * 1000
    bucket = F.col("window_start") - F.pmod("window_start", F.lit(width))
    fallback = F.when(F.col("window_size") == 86_400, F.concat(F.lit("day:"), F.col("window_start"))).otherwise(F.concat(F.lit("bucket:"), bucket))
    return rows.withColumn("correlation_key", F.coalesce(F.concat(F.lit("session:"), F.col("session_id")), fallback))


THINGS = "array<struct<kind:string,name:string>>"


def _thing(kind: str, name: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), name.alias("name"))


def _things_of(evidence: str) -> Column:
    """The different source types, addresses and resources of events."""

    def of(e: Column) -> Column:
        some = F.coalesce(e["resource_type"], e["resource_name"]).isNotNull()
        named = F.concat(F.coalesce(e["resource_type"], F.lit("<unknown_type>")), F.lit(":"), F.coalesce(e["resource_name"], F.lit("<unknown_resource>")))
        return F.array(_thing("source_type", e["source_type"]), _thing("source_ip", e["source_ip"]), _thing("resource", F.when(some, named)))

    return F.array_distinct(F.filter(F.flatten(F.transform(evidence, of)), lambda x: x["name"].isNotNull()))


def incidents(live: DataFrame, tops: DataFrame, own: DataFrame, values: DataFrame, sessions: DataFrame, config: dict = CORRELATION) -> DataFrame:
    """One row for each user and group of active candidates (live: group_keys of them), with score, type, sets of what
    was involved and timeline.

    What was involved comes from the windows' evidence (tops) and source types, the events that are candidates (own),
    the candidates' own values and the sessions. Each window of an incident is looked up once, whatever its candidates.
    """
    keys, window = ["user_name", "correlation_key"], ["user_name", "window_size", "window_start"]
    at = F.struct("window_start", (-F.col("score")).alias("minus_score"), "candidate_key", "window_end", "detector_id", "detector_family", "metric", "value_type", "value_key", "severity")
    rolled = live.groupBy(*keys).agg(
        F.max("session_id").alias("session_id"), F.min("window_start").alias("first_seen"), F.max("window_end").alias("last_seen"), F.max("score").alias("max_score"), F.count(F.lit(1)).alias("candidate_count"),
        F.size(F.collect_set(F.struct("detector_family", "detector_id"))).cast("long").alias("detector_count"), F.array_sort(F.collect_set("detector_family")).alias("detector_families"),
        F.array_sort(F.collect_list(at)).alias("timeline"),
    )
    none = F.array().cast(THINGS)
    held = live.where("window_size > 0").select(*keys, "window_size", "window_start").distinct()
    kinds = values.where("value_type = 'source_type'").groupBy(*window).agg(F.transform(F.collect_set("value_key"), lambda v: _thing("source_type", v)).alias("k"))  # a window's source types
    from_windows = held.join(tops.select(*window, _things_of("evidence").alias("t")), window, "left").join(kinds, window, "left").select(*keys, F.concat(F.coalesce("t", none), F.coalesce("k", none)).alias("t"))
    from_events = live.where("window_size = 0").select("candidate_key", *keys).join(own, ["user_name", "candidate_key"]).select(*keys, _things_of("evidence").alias("t"))
    from_values = live.where(F.col("value_type").isin("source_ip", "resource")).select(*keys, F.array(F.struct(F.col("value_type").alias("kind"), F.col("value_key").alias("name"))).alias("t"))
    one = lambda c, kind: F.transform(f"{c}_samples", lambda v: _thing(kind, v))
    from_sessions = live.where("session_id IS NOT NULL").select(*keys, "session_id").distinct().join(sessions, ["user_name", "session_id"])
    from_sessions = from_sessions.select(*keys, F.concat(one("source_type", "source_type"), one("source_ip", "source_ip"), one("resource_display", "resource")).alias("t"))
    gathered = lambda kind, name: F.collect_set(F.when(F.col("kind") == kind, F.col("name"))).alias(name)
    things, out = ("source_types", "source_ips", "resources"), rolled
    # each source is gathered by itself: where users are dealt already, nothing of this is shuffled
    for i, rows in enumerate((from_windows, from_events, from_values, from_sessions)):
        rows = rows.select(*keys, F.explode("t").alias("x")).select(*keys, "x.*").where("name IS NOT NULL")
        sets = rows.groupBy(*keys).agg(gathered("source_type", "source_types"), gathered("source_ip", "source_ips"), gathered("resource", "resources"))
        out = out.join(sets.withColumnsRenamed({c: f"_{c}{i}" for c in things}), keys, "left")
    none = F.array().cast("array<string>")
    out = out.withColumns({c: F.array_sort(F.array_distinct(F.concat(*[F.coalesce(f"_{c}{i}", none) for i in range(4)]))) for c in things})
    out = out.drop(*[f"_{c}{i}" for c in things for i in range(4)])
    bonus = F.least(F.lit(config["bonus_cap"]), config["bonus"] * (F.col("candidate_count") - 1))
    kind = F.when(F.size("source_types") > 1, "cross_system_behavior_anomaly").when(F.size("detector_families") > 1, "compound_behavior_anomaly").otherwise("user_behavior_anomaly")
    score = F.least(F.lit(100), F.col("max_score") + bonus).cast("int")
    out = out.withColumns({"incident_key": key_of("user_name", "correlation_key"), "aggregation_score": score, "incident_type": kind, "detector_family_count": F.size("detector_families")})
    return out.withColumn("severity", severity(F.col("aggregation_score"))).drop("max_score")
