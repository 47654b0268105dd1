"""Statistical baselines of users, peer groups and everyone."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..settings import BASELINE, BASELINE_SIZES, HISTORY_DAYS, METRICS, VALUE_WINDOW_S
from ..sources.state import settle
from .features import DAY_MS, window_start

PERCENTILES = (0.5, 0.95, 0.99)


def long_metrics(windows: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each window and metric."""
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in METRICS])
    return windows.select(*keys, F.explode(pairs).alias("m")).select(*keys, "m.*")


def _by_rank(hist: DataFrame, keys: list[str], ps: tuple[float, ...], sums: dict[str, Column]) -> DataFrame:
    """Exact, linearly interpolated percentiles of hist (keys, value >= 0, n: how often; a value may have several rows) as
    columns p50, p95, ..., with total (of n) and the sums of hist's columns asked for.

    Counts of a few hundred value classes locate the ranks asked for; only the classes that hold them are looked
    through value by value. A key of any size is so never sorted in one task. Sums are added up by class on the way.
    """
    scale = F.floor(F.log2(F.col("value") + 1) * 16).cast("int")
    classes = hist.groupBy(*keys, scale.alias("c")).agg(F.sum("n").alias("n"), *[F.sum(v).alias(k) for k, v in sums.items()], F.min("value").alias("min"), F.max("value").alias("max"))
    before = Window.partitionBy(*keys).orderBy("c").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(*keys)
    wide = {"_first": F.coalesce(F.sum("n").over(before), F.lit(0)), "total": F.sum("n").over(every), "min": F.min("min").over(every), "max": F.max("max").over(every), **{k: F.sum(k).over(every) for k in sums}}
    classes = classes.withColumns(wide)
    asked = F.array(*[F.lit(p) for p in ps])
    low = lambda p: F.floor(p * (F.col("total") - 1))
    holds = F.exists(asked, lambda p: (low(p) < F.col("_first") + F.col("n")) & (low(p) + 1 >= F.col("_first")))
    held = hist.select(*keys, "value", "n").withColumn("c", scale).join(classes.where(holds).drop("n"), [*keys, "c"])
    within = Window.partitionBy(*keys, "c").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    held = held.withColumn("_at", F.col("_first") + F.coalesce(F.sum("n").over(within), F.lit(0)))
    at = lambda rank: (F.col("_at") <= rank) & (rank < F.col("_at") + F.col("n"))
    out = []
    for p in ps:
        rank = p * (F.col("total") - 1)
        lo, hi = F.floor(rank), F.least(F.floor(rank) + 1, F.col("total") - 1)
        a, b = F.max(F.when(at(lo), F.col("value"))), F.max(F.when(at(hi), F.col("value")))
        part = F.max(rank - F.floor(rank))
        out.append((a + (b - a) * part).alias(f"p{round(100 * p)}"))
    return held.groupBy(*keys).agg(*out, *[F.max(k).alias(k) for k in ("total", "min", "max", *sums)])


def statistics(rows: DataFrame, keys: list[str]) -> DataFrame:
    """count, mean, population deviation, min, max, p50, p95, p99 and MAD of rows (keys, value, n).

    For keys with a bounded number of rows, such as one user's windows of a history: two aggregations.
    """
    n, value = F.col("n"), F.col("value")
    ranks = F.percentile("value", F.array(*map(F.lit, PERCENTILES)), n)
    basic = rows.groupBy(*keys).agg(F.sum("n").alias("sample_count"), (F.sum(value * n) / F.sum("n")).alias("mean"), F.min("value").alias("min"), F.max("value").alias("max"), ranks.alias("p"))
    basic = basic.select(*keys, "sample_count", "mean", "min", "max", *[F.col("p")[i].alias(f"p{round(100 * x)}") for i, x in enumerate(PERCENTILES)])
    far = value - F.col("mean")
    near = rows.join(basic, keys).groupBy(*keys, "sample_count", "mean", "min", "max", "p50", "p95", "p99")
    return near.agg(F.sqrt(F.sum(far * far * n) / F.sum("n")).alias("std"), F.percentile(F.abs(value - F.col("p50")), F.lit(0.5), n).alias("mad"))


def large_statistics(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The same for keys of any size: from counts of distinct values, with ranks found class by class (see _by_rank).

    The deviation has 12 digits, so that the order in which tasks add squares up does not show in it.
    """
    n, value = F.col("n"), F.col("value")
    hist = settle(rows.groupBy(*keys, "value").agg(F.sum("n").alias("n")))
    basic = _by_rank(hist, keys, PERCENTILES, {"mean": value * n}).withColumnRenamed("total", "sample_count")
    basic = settle(basic.withColumn("mean", F.col("mean") / F.col("sample_count")))  # a row for each key
    far = value - F.col("mean")
    near = hist.join(basic.select(*keys, "mean", "p50"), keys).select(*keys, F.abs(value - F.col("p50")).alias("value"), "n", (far * far * n).alias("square"))
    spread = _by_rank(near, keys, (0.5,), {"square": F.col("square")})
    return basic.join(spread.select(*keys, F.format_string("%.11e", F.sqrt(F.col("square") / F.col("total"))).cast("double").alias("std"), F.col("p50").alias("mad")), keys)


def history(windows: DataFrame, as_of_ms: int, days: int = HISTORY_DAYS, sizes: tuple[int, ...] = BASELINE_SIZES) -> DataFrame:
    """Windows that start in the history before as_of, both ends included; the start is not floored to a window."""
    start = as_of_ms - days * DAY_MS
    return windows.where(F.col("window_size").isin(*sizes) & (F.col("window_start") >= start) & (F.col("window_start") <= as_of_ms))


def status(days: Column, samples: Column, min_days: int, min_samples: int) -> Column:
    return F.when((days >= min_days) & (samples >= min_samples), "ready").otherwise("warming_up")


STATISTICS = "sample_count long, mean double, std double, min double, max double, p50 double, p95 double, p99 double, mad double"


def _statistics_of(v: np.ndarray, zeros: int) -> tuple:
    """The numbers of STATISTICS of sorted numbers of at least 0 and so many zeros before them."""
    n, none = len(v) + zeros, np.nan
    if not n:
        return 0, none, none, none, none, none, none, none, none

    def ranked(at, p: float) -> float:
        rank = (n - 1) * p
        low = int(rank)
        a, b = at(low), at(min(low + 1, n - 1))
        return a + (b - a) * (rank - low)

    own = lambda i: v[i - zeros] if i >= zeros else 0.0
    mean, p50 = float(v.sum()) / n, ranked(own, 0.5)
    square = float(((v - mean) ** 2).sum()) + zeros * mean * mean
    far = np.sort(np.abs(v - p50))
    below = int(np.searchsorted(far, p50))  # the zeros are all p50 away
    away = lambda i: far[i] if i < below else p50 if i < below + zeros else far[i - zeros]
    return n, mean, (square / n) ** 0.5, own(0), own(n - 1), p50, ranked(own, 0.95), ranked(own, 0.99), ranked(away, 0.5)


def _padded(values: pd.Series, zeros: pd.Series) -> pd.DataFrame:
    made = [_statistics_of(np.sort(np.asarray(v, np.float64)), int(z)) for v, z in zip(values, zeros, strict=True)]
    return pd.DataFrame(made, columns=[x.split()[0] for x in STATISTICS.split(", ")])


def padded_statistics(values: Column | str, zeros: Column | str) -> Column:
    """sample_count, mean, std, min, max, p50, p95, p99, mad of the numbers (at least 0) of an array and so many zeros
    beside them, as a struct. The zeros are counted, never made; arrays are those of a bounded history."""
    return F.pandas_udf(_padded, STATISTICS)(values, zeros)


def personal_baselines(windows: DataFrame, as_of_ms: int, days: int = HISTORY_DAYS, sizes: tuple[int, ...] = BASELINE_SIZES, config: dict = BASELINE) -> DataFrame:
    """A row for each user and window size of the history: active_days, status, seen (a bit for each day of the history
    with events) and stats, the statistics of each metric over all windows from the first to the last active one.

    Windows without events count as zeros, which are counted, not made. A user's history has a bounded number of
    windows, so one aggregation gathers them; no window is spread into a row a metric.
    """
    if days > 60:
        raise ValueError("days of a history are bits of a number: 60 at most")
    start, width = as_of_ms - days * DAY_MS, F.col("window_size").cast("long") * 1000
    begin = F.col("window_start")
    held = (begin >= window_start(F.lit(start), F.col("window_size").cast("long"))) & (begin <= as_of_ms)
    day = begin - F.pmod(begin, F.lit(DAY_MS))
    bit = lambda when: F.coalesce(F.bit_or(F.when(when & (F.col("event_count") > 0), F.call_function("shiftleft", F.lit(1).cast("long"), ((day - start) / DAY_MS + 1).cast("int")))), F.lit(0).cast("long"))
    rows = windows.where(F.col("window_size").isin(*sizes)).groupBy("user_name", "window_size").agg(
        F.min("window_start").alias("_first"), F.max("window_start").alias("_last"), bit(held).alias("_days"), bit((begin >= start) & (begin <= as_of_ms)).alias("seen"),
        *[F.collect_list(F.when(held, F.col(m).cast("double"))).alias(m) for m in METRICS],
    )
    floor = lambda t: window_start(F.lit(t), F.col("window_size").cast("long"))
    slots = ((F.least("_last", floor(as_of_ms)) - F.greatest("_first", floor(start))) / width + 1).cast("long")
    rows = rows.where(F.size(METRICS[0]) > 0).withColumns({"_zeros": F.greatest(F.lit(0).cast("long"), slots - F.size(METRICS[0])), "active_days": F.bit_count("_days").cast("long")})
    rows = rows.withColumns({f"_{m}": padded_statistics(m, "_zeros") for m in METRICS})  # one pass through Arrow for all
    fields = [x.split()[0] for x in STATISTICS.split(", ")]
    rows = rows.withColumn("stats", F.array(*[F.struct(*[F.col(f"_{m}")[k].alias(k) for k in fields], F.lit(m).alias("metric")) for m in METRICS]))
    ready = status(F.col("active_days"), F.col("stats")[0]["sample_count"], config["min_active_days"], config["min_samples"])
    return rows.select("user_name", "window_size", "active_days", ready.alias("status"), "seen", "stats")


def group_baselines(windows: DataFrame, personal: DataFrame, peers: DataFrame, as_of_ms: int, days: int = HISTORY_DAYS, sizes: tuple[int, ...] = BASELINE_SIZES, config: dict = BASELINE) -> DataFrame:
    """scope, subject, window_size, member_count, active_days, status, stats of each peer group and of everyone (scope
    global, subject empty) over the windows that were seen.

    Windows are counted by value and group in one pass; everyone's counts are the groups' added up. Members and days
    come from the users' rows (personal). peers has user_name and group_id, a user in one group.
    """
    keys = ["scope", "subject", "window_size"]
    scopes = F.array_compact(F.array(F.when(F.col("group_id").isNotNull(), F.struct(F.lit("peer_group").alias("scope"), F.col("group_id").alias("subject"))), F.struct(F.lit("global").alias("scope"), F.lit("").alias("subject"))))
    both = lambda df, *rest: df.select("*", F.explode(scopes).alias("_s")).select("_s.*", *rest)
    grouped = history(windows, as_of_ms, days, sizes).join(peers.select("user_name", "group_id"), "user_name", "left")
    hist = long_metrics(grouped, ["group_id", "window_size"]).groupBy("group_id", "window_size", "metric", "value").agg(F.count(F.lit(1)).alias("n"))
    stats = large_statistics(both(hist, "window_size", "metric", "value", "n"), [*keys, "metric"])
    users = both(personal.select("user_name", "window_size", "seen").join(peers.select("user_name", "group_id"), "user_name", "left").where("seen <> 0"), "window_size", "seen")
    members = users.groupBy(*keys).agg(F.count(F.lit(1)).alias("member_count"), F.bit_count(F.bit_or("seen")).cast("long").alias("active_days"))
    order = F.array_position(F.array(*map(F.lit, METRICS)), F.col("metric"))
    names = ("sample_count", "mean", "std", "min", "max", "p50", "p95", "p99", "mad", "metric")
    wide = stats.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("i"), *names))), lambda x: F.struct(*[x[n].alias(n) for n in names])).alias("stats"))
    samples = F.col("stats")[0]["sample_count"]
    peer = F.when(F.col("member_count") >= config["min_peer_members"], status(F.col("active_days"), samples, config["min_peer_active_days"], config["min_peer_samples"])).otherwise("warming_up")
    whole = status(F.col("active_days"), samples, config["min_active_days"], config["min_samples"])
    return wide.join(members, keys).select(*keys, "member_count", "active_days", F.when(F.col("scope") == "global", whole).otherwise(peer).alias("status"), "stats")


def by_metric(wide: DataFrame) -> DataFrame:
    """A row for each metric of personal_baselines or group_baselines."""
    keep = [c for c in wide.columns if c not in ("stats", "seen")]
    return wide.select(*keep, F.explode("stats").alias("_x")).select(*keep, "_x.*")


def value_baselines(values: DataFrame, bounds: DataFrame, peers: DataFrame, as_of_ms: int, days: int = HISTORY_DAYS, size: int = VALUE_WINDOW_S) -> DataFrame:
    """Counts, sightings and share (of its type) of each value in each scope: scope, subject, value_type, value_key,
    display_value, event_count, window_count, user_count, first_seen, last_seen, share.

    Users' values are counted once (value_counts); groups and everyone add them up.
    """
    users = settle(value_counts(values, bounds, peers, as_of_ms, days, size))
    return own_values(users).unionByName(group_values(users))


def value_counts(values: DataFrame, bounds: DataFrame, peers: DataFrame, as_of_ms: int, days: int = HISTORY_DAYS, size: int = VALUE_WINDOW_S) -> DataFrame:
    """Each user's values with group_id and two structs of counts and sightings: own, and every for the groups.

    A user's own range starts at the first event itself, not its window, so values of a first partial hour are left out
    there. bounds has each user's first_time_ms.
    """
    start, begin = as_of_ms - days * DAY_MS, F.col("window_start")
    rows = values.where((F.col("window_size") == size) & (begin >= start) & (begin <= as_of_ms)).join(bounds.select("user_name", "first_time_ms"), "user_name")
    own = begin >= F.col("first_time_ms")
    keys = ["value_type", "value_key"]
    total = lambda when: F.sum(F.when(when, F.col("event_count")).otherwise(0))
    yes = F.lit(True)
    parts = lambda when: F.struct(
        F.max(F.when(when, F.col("display_value"))).alias("display_value"), total(when).alias("event_count"), F.count_if(when).alias("window_count"), F.min(F.when(when, begin)).alias("first_seen"), F.max(F.when(when, begin)).alias("last_seen"),
    )
    return rows.groupBy("user_name", *keys).agg(parts(own).alias("own"), parts(yes).alias("every")).join(peers.select("user_name", "group_id"), "user_name", "left")


def own_values(users: DataFrame) -> DataFrame:
    """value_baselines of scope personal, from value_counts."""
    personal = users.where("own.window_count > 0").select(F.lit("personal").alias("scope"), F.col("user_name").alias("subject"), "value_type", "value_key", "own.*", F.lit(1).cast("long").alias("user_count"))
    return personal.withColumn("share", F.col("event_count") / F.sum("event_count").over(Window.partitionBy("subject", "value_type")))


def group_values(users: DataFrame) -> DataFrame:
    """value_baselines of groups and everyone, from value_counts."""
    keys = ["value_type", "value_key"]
    scopes = F.array_compact(F.array(F.when(F.col("group_id").isNotNull(), F.struct(F.lit("peer_group").alias("scope"), F.col("group_id").alias("subject"))), F.struct(F.lit("global").alias("scope"), F.lit("").alias("subject"))))
    spread = users.select(*keys, "every.*", F.explode(scopes).alias("_s")).select("_s.*", *keys, "display_value", "event_count", "window_count", "first_seen", "last_seen")
    added = spread.groupBy("scope", "subject", *keys).agg(
        F.max("display_value").alias("display_value"), F.sum("event_count").alias("event_count"), F.sum("window_count").alias("window_count"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"),
        F.count(F.lit(1)).alias("user_count"),
    )
    every = settle(added)
    totals = every.groupBy("scope", "subject", "value_type").agg(F.sum("event_count").alias("_total"))
    return every.join(totals, ["scope", "subject", "value_type"]).withColumn("share", F.col("event_count") / F.col("_total")).drop("_total")
