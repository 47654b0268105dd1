"""Sessions of users: events no further apart than the gap, in any order of arrival."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..settings import SAMPLE_LIMIT, SESSION_GAP_S
from .features import DAY_MS

SAMPLES = ("source_type", "source_ip", "resource_display")


def _grouped(rows: DataFrame, keys: list[str], start: str, end: str, gap_ms: int) -> DataFrame:
    """rows with _session, counted within keys: a new one where start lies beyond all earlier ends and the gap."""
    order = Window.partitionBy(*keys).orderBy(start, end, "first_event_id")
    before = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(before.isNull() | (F.col(start) > before + gap_ms), 1).otherwise(0)
    return rows.withColumn("_opens", opens).withColumn("_session", F.sum("_opens").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_opens")


def _merged(first: bool, limit: int) -> list[Column]:
    at = F.struct("start_time", "first_event_id"), F.struct("last_event_time", "last_event_id")
    sets = [F.array_sort(F.array_distinct(F.flatten(F.collect_list(f"{c}_samples")))).alias(f"{c}_samples") for c in SAMPLES]
    actions = lambda c: F.array_sort(F.flatten(F.collect_list(c)))
    return [
        F.min(at[0]).alias("a"), F.max(at[1]).alias("b"), F.sum("event_count").alias("event_count"), F.sum("action_count").alias("action_count"), *sets,
        F.slice(actions("first_actions"), 1, limit).alias("first_actions"), F.reverse(F.slice(F.reverse(actions("last_actions")), 1, limit)).alias("last_actions"),
    ]


def sessions(events: DataFrame, gap_s: int = SESSION_GAP_S, limit: int = SAMPLE_LIMIT) -> DataFrame:
    """Each user's sessions: bounds, counts, sorted samples of values (limit of each, and whether more were seen),
    the first and last actions, and session_id, the SHA-256 of user, start and first event.

    Two events exactly gap_s apart are one session. A user's events are first joined to sessions within a day, by
    (user, day), and only those are then merged over days: a user of any size sorts a day at a time.
    """
    gap = gap_s * 1000
    day = events.select(
        "user_name", (F.col("event_time_ms") - F.pmod("event_time_ms", F.lit(DAY_MS))).alias("day"), F.col("event_time_ms").alias("start_time"), F.col("event_id").alias("first_event_id"), F.col("event_time_ms").alias("last_event_time"),
        F.col("event_id").alias("last_event_id"), "action", *SAMPLES,
    )
    keys = ["user_name", "day", "_session"]
    local = _grouped(day, ["user_name", "day"], "start_time", "last_event_time", gap)
    order = Window.partitionBy(*keys)
    local = local.withColumns({"_i": F.row_number().over(order.orderBy("start_time", "first_event_id")), "_n": F.count(F.lit(1)).over(order)})
    # of a session's values in order one more than are shown, so that more are noticed
    named = F.array(*[F.struct(F.lit(c).alias("kind"), F.col(c).alias("value")) for c in SAMPLES])
    seen = local.select(*keys, F.explode(named).alias("v")).select(*keys, "v.*").where("value IS NOT NULL").distinct()
    seen = seen.withColumn("_i", F.row_number().over(Window.partitionBy(*keys, "kind").orderBy("value"))).where(F.col("_i") <= limit + 1)
    seen = seen.groupBy(*keys).agg(*[F.collect_list(F.when(F.col("kind") == c, F.col("value"))).alias(f"{c}_samples") for c in SAMPLES])
    action = F.struct(F.col("start_time").alias("time_ms"), F.col("first_event_id").alias("event_id"), "action")
    local = local.groupBy(*keys).agg(
        F.min(F.struct("start_time", "first_event_id")).alias("a"), F.max(F.struct("last_event_time", "last_event_id")).alias("b"), F.count(F.lit(1)).alias("event_count"), F.count(F.nullif("action", F.lit(""))).alias("action_count"),
        F.collect_list(F.when(F.col("_i") <= limit, action)).alias("first_actions"), F.collect_list(F.when(F.col("_i") > F.col("_n") - limit, action)).alias("last_actions"),
    ).join(seen, keys, "left")
    local = local.withColumns({f"{c}_samples": F.coalesce(f"{c}_samples", F.array().cast("array<string>")) for c in SAMPLES})
    flat = ["user_name", F.col("a.start_time").alias("start_time"), F.col("a.first_event_id").alias("first_event_id"), F.col("b.last_event_time").alias("last_event_time"), F.col("b.last_event_id").alias("last_event_id")]
    rest = ["event_count", "action_count", *[f"{c}_samples" for c in SAMPLES], "first_actions", "last_actions"]
    whole = _grouped(local.select(*flat, *rest), ["user_name"], "start_time", "last_event_time", gap).groupBy("user_name", "_session").agg(*_merged(False, limit))
    capped = [(F.size(f"{c}_samples") > limit).alias(f"{c}_capped") for c in SAMPLES]
    out = whole.select(*flat, *rest, *capped, (F.col("action_count") > limit).alias("sequence_capped"))
    out = out.withColumns({f"{c}_samples": F.slice(f"{c}_samples", 1, limit) for c in SAMPLES})
    return out.withColumn("session_id", session_id())


def session_id() -> Column:
    return F.sha2(F.concat_ws(":", "user_name", F.col("start_time").cast("string"), "first_event_id"), 256)


def closed(rows: DataFrame, watermark_ms: int, gap_s: int = SESSION_GAP_S) -> DataFrame:
    """rows with status: closed where the session's gap ended before the watermark (strictly), else provisional."""
    return rows.withColumn("status", F.when(F.col("last_event_time") + gap_s * 1000 < watermark_ms, "closed").otherwise("provisional"))


def overlapping(rows: DataFrame, from_ms: int, to_ms: int) -> DataFrame:
    """Sessions with an event's span inside or across the half-open range; a last event at from_ms counts."""
    return rows.where((F.col("start_time") < to_ms) & (F.col("last_event_time") >= from_ms))


def none_closed(events: DataFrame) -> DataFrame:
    """What advance starts from."""
    return sessions(events.limit(0)).withColumns({"status": F.lit("closed"), "close_reason": F.lit("")})


def advance(done: DataFrame, pool: DataFrame, events: DataFrame, watermark_ms: int, gap_s: int = SESSION_GAP_S) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What a watermark makes of sessions: those that are closed, the pool of events that are in none, and the
    provisional ones.

    done are sessions that are closed already: nothing changes them any more, and an event that comes too late for one
    begins a session of its own. pool are the events that were in no closed session, events the new ones. Sessions of
    both that ended before the watermark are closed; their events leave the pool.
    """
    rows = pool.unionByName(events)
    made = closed(sessions(rows, gap_s), watermark_ms, gap_s)
    new = made.where("status = 'closed'").withColumn("close_reason", F.lit("watermark"))
    midnight = lambda c: F.col(c) - F.pmod(F.col(c), F.lit(DAY_MS))
    spans = new.select("user_name", "start_time", "last_event_time", F.explode(F.sequence(midnight("start_time"), midnight("last_event_time"), F.lit(DAY_MS))).alias("_day"))
    inside = rows.withColumn("_day", midnight("event_time_ms")).join(spans, ["user_name", "_day"]).where((F.col("event_time_ms") >= F.col("start_time")) & (F.col("event_time_ms") <= F.col("last_event_time")))
    return done.unionByName(new.select(*done.columns)), rows.join(inside.select("event_id"), "event_id", "left_anti"), made.where("status = 'provisional'")


def flushed(done: DataFrame, pool: DataFrame, gap_s: int = SESSION_GAP_S) -> DataFrame:
    """All sessions when the input has ended: those of the pool are closed as they are."""
    new = sessions(pool, gap_s).withColumns({"status": F.lit("closed"), "close_reason": F.lit("end_of_input")})
    return done.unionByName(new.select(*done.columns))
