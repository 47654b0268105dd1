"""Point-in-time backtests: what a detector would have known and said on each past day."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..settings import BASELINE, BASELINE_SIZES, DETECTION, HISTORY_DAYS, METRICS, VALUE_WINDOW_S
from ..sources.state import StateError, StateTable, fingerprint, settle
from . import models
from .baseline import long_metrics, status
from .detection import severity
from .features import DAY_MS
from .ranks import class_of, picked

#: Users whose days are worked out before they are sent on.
ROWS_A_BATCH = 500
MODEL = ["eval_day", "window_size", "scope", "subject"]


def history(windows: DataFrame, from_ms: int, to_ms: int, days: int = HISTORY_DAYS, sizes: tuple[int, ...] = BASELINE_SIZES) -> DataFrame:
    """windows with eval_day: once for each UTC day of [from, to) that has them among the days before it."""
    own = F.col("window_start") - F.pmod("window_start", F.lit(DAY_MS))
    rows = windows.where(F.col("window_size").isin(*sizes) & (F.col("window_start") >= from_ms - days * DAY_MS) & (F.col("window_start") < to_ms - DAY_MS))
    reach = F.sequence(F.greatest(own + DAY_MS, F.lit(from_ms)), F.least(own + days * DAY_MS, F.lit(to_ms - DAY_MS)), F.lit(DAY_MS))
    return rows.where(own + days * DAY_MS >= from_ms).withColumn("eval_day", F.explode(reach))


LIMITS = (0.95, 0.99)


def _ranked(rows: np.ndarray, zeros: int, p: float) -> np.ndarray:
    """The interpolated percentile of each column of sorted rows with so many zeros before them."""
    n = len(rows) + zeros
    rank = p * (n - 1)
    low = int(rank)
    none = np.zeros(rows.shape[1])
    a, b = (rows[i - zeros] if i >= zeros else none for i in (low, min(low + 1, n - 1)))
    return a + (b - a) * (rank - low)


def day_limits(windows: DataFrame, from_ms: int, to_ms: int, days: int = HISTORY_DAYS, sizes: tuple[int, ...] = BASELINE_SIZES, config: dict = BASELINE) -> DataFrame:
    """Each user's percentiles as known at the start of every UTC day (UTC midnights) of [from, to): eval_day, user_name,
    window_size, observed, active_days, status and p95, p99, arrays in the order of METRICS.

    One aggregation gathers a user's windows of a size, which the range bounds; the days' histories are slices of them,
    so that no window is sent to each of the days that use it. All slots of the history count, empty ones as zeros,
    which are counted, not made; readiness goes by the windows that were seen.
    """
    day = F.col("window_start") - F.pmod("window_start", F.lit(DAY_MS))
    rows = windows.where(F.col("window_size").isin(*sizes) & (F.col("window_start") >= from_ms - days * DAY_MS) & (F.col("window_start") < to_ms - DAY_MS))
    held = rows.groupBy("user_name", F.col("window_size").cast("int").alias("window_size")).agg(F.collect_list(day).alias("days"), F.collect_list(F.array(*[F.col(m).cast("double") for m in METRICS])).alias("values"))

    def of(own: np.ndarray, values: np.ndarray, size: int) -> Iterator[tuple]:
        order = np.argsort(own, kind="stable")
        own, values = own[order], values[order]
        first, last = max(from_ms, int(own[0]) + DAY_MS), min(to_ms - DAY_MS, int(own[-1]) + days * DAY_MS)
        for at in range(first, last + 1, DAY_MS):
            low, high = np.searchsorted(own, at - days * DAY_MS), np.searchsorted(own, at)
            if high > low:
                part = np.sort(values[low:high], axis=0)
                zeros = max(0, days * 86400 // size - len(part))
                yield at, len(part), len(np.unique(own[low:high])), *(_ranked(part, zeros, p) for p in LIMITS)

    def limits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = len(METRICS)
        for batch in batches:
            users, windows_, own, values = batch.columns
            ends = own.offsets.to_numpy() - own.offsets[0].as_py()
            flat, table = own.flatten().to_numpy(), values.flatten().flatten().to_numpy().reshape(-1, number)
            for start in range(0, len(users), ROWS_A_BATCH):
                made, names, sizes_ = [], [], []
                for i in range(start, min(start + ROWS_A_BATCH, len(users))):
                    size = windows_[i].as_py()
                    found = list(of(flat[ends[i] : ends[i + 1]], table[ends[i] : ends[i + 1]], size))
                    made += found
                    names += [users[i].as_py()] * len(found)
                    sizes_ += [size] * len(found)
                if made:
                    ats, observed, active, *ps = zip(*made, strict=True)
                    lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(made) + 1) * number, pa.int32()), pa.array(np.concatenate(p))) for p in ps]
                    yield pa.record_batch([pa.array(ats, pa.int64()), pa.array(names, pa.string()), pa.array(sizes_, pa.int32()), pa.array(observed, pa.int64()), pa.array(active, pa.int64()), *lists], ["eval_day", "user_name", "window_size", "observed", "active_days", "p95", "p99"])

    out = held.mapInArrow(limits, "eval_day long, user_name string, window_size int, observed long, active_days long, p95 array<double>, p99 array<double>")
    return out.withColumn("status", status(F.col("active_days"), F.col("observed"), config["min_active_days"], config["min_samples"]))


def day_snapshots(windows: DataFrame, from_ms: int, to_ms: int, days: int = HISTORY_DAYS, sizes: tuple[int, ...] = BASELINE_SIZES, config: dict = BASELINE) -> DataFrame:
    """day_limits with a row for each metric."""
    each = F.arrays_zip(F.array(*map(F.lit, METRICS)).alias("metric"), "p95", "p99")
    rows = day_limits(windows, from_ms, to_ms, days, sizes, config).withColumn("_m", F.explode(each))
    return rows.select("eval_day", "user_name", "window_size", F.col("_m.metric").alias("metric"), "observed", "active_days", F.col("_m.p95").alias("p95"), F.col("_m.p99").alias("p99"), "status")


def day_candidates(windows: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Windows of each evaluation day that lie above the percentiles known before it (both to 9 digits, so that no way of
    interpolating shows), by users that were ready. snapshots are day_snapshots, or better day_limits: then a window's
    metrics are compared in place, and only those that lie above become rows."""
    keys = ["eval_day", "user_name", "window_size"]
    ready = snapshots.where("status = 'ready'")
    if "metric" in snapshots.columns:
        at = lambda c: F.transform(F.array(*map(F.lit, METRICS)), lambda m: F.try_element_at("_of", m)[c]).alias(c)
        ready = ready.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("metric", F.struct("p95", "p99")))).alias("_of")).select(*keys, at("p95"), at("p99"))
    day = F.col("window_start") - F.pmod("window_start", F.lit(DAY_MS))
    rows = windows.withColumn("eval_day", day).join(ready.select(*keys, "p95", "p99"), keys)
    near = lambda x: F.round(x, 9)
    above = lambda m, i: F.when(near(F.col(m).cast("double")) > near(F.col("p95")[i]), F.struct(F.lit(m).alias("metric"), (near(F.col(m).cast("double")) > near(F.col("p99")[i])).alias("high")))
    hit = rows.select(*keys, "window_start", F.explode(F.array_compact(F.array(*[above(m, i) for i, m in enumerate(METRICS)]))).alias("_hit"))
    high, metric = F.col("_hit.high"), F.col("_hit.metric")
    score = F.when(high, DETECTION["p99_score"]).otherwise(DETECTION["p95_score"])
    return hit.select(*keys, "window_start", metric.alias("metric"), F.when(high, "numeric_p99").otherwise("numeric_p95").alias("detector_id"), score.alias("score"), severity(score).alias("severity"))


def day_values(values: DataFrame, from_ms: int, to_ms: int, days: int = HISTORY_DAYS, size: int = VALUE_WINDOW_S) -> DataFrame:
    """Each user's values as known at the start of every UTC day of [from, to): eval_day, user_name, value_type, value_key,
    event_count, share (of its type) and first_seen in the windows of the days before it."""
    seen = history(values, from_ms, to_ms, days, (size,))
    keys = ["eval_day", "user_name", "value_type"]
    rows = seen.groupBy(*keys, "value_key").agg(F.sum("event_count").alias("event_count"), F.min("window_start").alias("first_seen"))
    total = rows.groupBy(*keys).agg(F.sum("event_count").alias("_total"))
    return rows.join(total, keys).withColumn("share", F.col("event_count") / F.col("_total")).drop("_total")


def day_value_candidates(values: DataFrame, known: DataFrame, ready: DataFrame, size: int = VALUE_WINDOW_S) -> DataFrame:
    """rare_value candidates of each evaluation day: values of its windows that the days before know, but seldom. ready
    (eval_day, user_name) are users whose history is long enough. A value that was never seen before has no baseline in
    a snapshot of the past, so it is no candidate there."""
    day = F.col("window_start") - F.pmod("window_start", F.lit(DAY_MS))
    rows = values.where(F.col("window_size") == size).withColumn("eval_day", day).join(ready, ["eval_day", "user_name"], "left_semi")
    hit = rows.select("eval_day", "user_name", "window_start", "value_type", "value_key").join(known, ["eval_day", "user_name", "value_type", "value_key"])
    hit = hit.where((F.col("share") <= DETECTION["rare_share_threshold"]) & (F.col("event_count") <= DETECTION["rare_event_count_max"]))
    score = F.lit(DETECTION["rare_value_score"])
    return hit.select("eval_day", "user_name", "window_start", "value_type", "value_key", F.lit("rare_value").alias("detector_id"), score.alias("score"), severity(score).alias("severity"))


def scoped(rows: DataFrame) -> DataFrame:
    """rows with scope and subject in the place of group_id: once for everyone, and once for the group where there is one."""
    scopes = F.array_compact(F.array(F.when(F.col("group_id").isNotNull(), F.struct(F.lit("peer_group").alias("scope"), F.col("group_id").alias("subject"))), F.struct(F.lit("global").alias("scope"), F.lit("").alias("subject"))))
    return rows.withColumn("_s", F.explode(scopes)).select("*", "_s.*").drop("_s", "group_id")


def model_training(windows: DataFrame, peers: DataFrame, from_ms: int, to_ms: int) -> DataFrame:
    """history of each day's models: windows with eval_day, scope and subject, for the peer group and for everyone."""
    return scoped(history(windows, from_ms, to_ms).join(peers.select("user_name", "group_id"), "user_name", "left"))


def model_snapshots(training: DataFrame) -> DataFrame:
    """eval_day, window_size, scope, subject, sample_count, member_count, status of every model that could be fitted.

    A peer group's model needs MIN_MEMBERS active members, any model MIN_ROWS rows.
    """
    users = training.groupBy(*MODEL, "user_name").agg(F.count(F.lit(1)).alias("n"))
    return _judged_sizes(users.groupBy(*MODEL).agg(F.sum("n").alias("sample_count"), F.count(F.lit(1)).alias("member_count")))


def _judged_sizes(sizes: DataFrame) -> DataFrame:
    enough = (F.col("sample_count") >= models.MIN_ROWS) & ((F.col("scope") == "global") | (F.col("member_count") >= models.MIN_MEMBERS))
    return sizes.withColumn("status", F.when(enough, "ready").otherwise("model_not_ready"))


def _day(start: str = "window_start") -> Column:
    return F.col(start) - F.pmod(start, F.lit(DAY_MS))


def model_sizes(windows: DataFrame, peers: DataFrame, from_ms: int, to_ms: int, days: int = HISTORY_DAYS) -> DataFrame:
    """What model_snapshots makes of model_training, without a row for each window and day that knows it.

    A user's active day adds its windows to the days behind it up to its history's end, and the user as a member up to the
    next active day, from when on that one does; so models' sizes are running sums of what comes and goes.
    """
    rows = windows.where(F.col("window_size").isin(*BASELINE_SIZES) & (F.col("window_start") >= from_ms - days * DAY_MS) & (F.col("window_start") < to_ms - DAY_MS))
    active = rows.groupBy("user_name", "window_size", _day().alias("day")).agg(F.count(F.lit(1)).alias("n"))
    later = F.lead("day").over(Window.partitionBy("user_name", "window_size").orderBy("day"))
    gone = F.col("day") + (days + 1) * DAY_MS
    active = active.withColumn("_left", F.least(gone, later + DAY_MS)).join(peers.select("user_name", "group_id"), "user_name", "left")
    step = lambda at, n, members: F.struct(F.greatest(at, F.lit(from_ms)).alias("at"), n.alias("n"), F.lit(members).alias("m"))
    none = F.lit(0).cast("long")
    steps = active.select("window_size", "group_id", F.explode(F.array(step(F.col("day") + DAY_MS, F.col("n"), 1), step(gone, -F.col("n"), 0), step(F.col("_left"), none, -1))).alias("s")).select("window_size", "group_id", "s.*")
    steps = steps.groupBy("window_size", "group_id", "at").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))
    subject = ["window_size", "scope", "subject"]
    steps = scoped(steps).groupBy(*subject, "at").agg(F.sum("n").alias("n"), F.sum("m").alias("m")).where(F.col("at") < to_ms)
    order = Window.partitionBy(*subject).orderBy("at")  # a row a day
    steps = steps.select(*subject, "at", F.sum("n").over(order).alias("sample_count"), F.sum("m").over(order).alias("member_count"), (F.coalesce(F.lead("at").over(order), F.lit(to_ms)) - DAY_MS).alias("_last"))
    return _judged_sizes(steps.where("sample_count > 0").select(F.explode(F.sequence("at", "_last", F.lit(DAY_MS))).alias("eval_day"), *subject, "sample_count", "member_count"))


#: Classes an octave: as many as keep what lies in a quantile's class a small part of all.
FINE = 8192
SUBJECT = ["window_size", "scope", "subject"]


def day_histograms(vectors: DataFrame, ready: DataFrame, from_ms: int, to_ms: int, days: int = HISTORY_DAYS) -> DataFrame:
    """MODEL, feature, n, low, high, edges, below (how many training values are less than each edge) of the ready models:
    those of models.fit_histograms over each day's training vectors (user_name, window_size, window_start, group_id, FEATURES).

    A day's values are counted once. Counts of classes, a table bounded by classes and days, slide over the days and say in
    which classes each day's quantiles lie; only values of these classes meet the days that ask for them.
    """
    known = vectors.where((F.col("window_start") >= from_ms - days * DAY_MS) & (F.col("window_start") < to_ms - DAY_MS)).withColumn("day", _day())
    own = ["window_size", "group_id", "day"]
    values = settle(models.long_features(known, own).groupBy(*own, "feature", "value").agg(F.count(F.lit(1)).alias("n")).withColumn("_c", class_of(F.col("value"), FINE)))
    classes = scoped(values).groupBy(*SUBJECT, "feature", "day", "_c").agg(F.sum("n").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))
    size = vectors.schema["window_size"].dataType.simpleString()

    def slide(part: pd.DataFrame) -> pd.DataFrame:
        """The classes of one feature that each day's quantiles lie in."""
        names, of = np.unique(part["_c"].to_numpy(), return_inverse=True)
        part = part.assign(of=of).sort_values("day", kind="stable")
        at, out = part["day"].to_numpy(), []
        total, bounds = np.zeros(len(names), np.int64), [0, 0]
        place, n, low, high = (part[c].to_numpy() for c in ("of", "n", "low", "high"))
        for day in range(max(from_ms, int(at[0]) + DAY_MS), min(to_ms - DAY_MS, int(at[-1]) + days * DAY_MS) + 1, DAY_MS):
            start, end = np.searchsorted(at, day - days * DAY_MS), np.searchsorted(at, day)
            np.add.at(total, place[bounds[1] : end], n[bounds[1] : end])
            np.subtract.at(total, place[bounds[0] : start], n[bounds[0] : start])
            bounds = [start, end]
            if (count := int(total.sum())) == 0:
                continue
            bins = max(models.MIN_BINS, min(models.MAX_BINS, math.ceil(math.sqrt(count))))
            ranks = np.floor(np.arange(1, bins) / bins * (count - 1)).astype(np.int64)
            upto = np.cumsum(total)
            hit = np.unique(np.searchsorted(upto, np.concatenate([ranks, np.minimum(ranks + 1, count - 1)]), side="right"))
            out.append(pd.DataFrame({"eval_day": day, "_c": names[hit], "_first": upto[hit] - total[hit], "_total": count, "low": low[start:end].min(), "high": high[start:end].max()}))
        out = pd.concat(out) if out else pd.DataFrame(columns=["eval_day", "_c", "_first", "_total", "low", "high"])
        return out.assign(**{c: part[c].iloc[0] for c in (*SUBJECT, "feature")})

    asked = classes.groupBy(*SUBJECT, "feature").applyInPandas(slide, f"eval_day long, window_size {size}, scope string, subject string, feature string, _c int, _first long, _total long, low double, high double")
    asked = settle(asked.join(ready.select(*MODEL), MODEL))
    keys = [*MODEL, "feature"]
    met = scoped(values).join(asked, [*SUBJECT, "feature", "_c"]).where((F.col("day") < F.col("eval_day")) & (F.col("day") >= F.col("eval_day") - days * DAY_MS))
    held = met.groupBy(*keys, "_c", "_first", "_total", "value").agg(F.sum("n").alias("n"))
    ends = asked.groupBy(*keys).agg(F.min("low").alias("low"), F.max("high").alias("high"))
    edges = F.array_sort(F.array_distinct(F.arrays_zip("q", "below")))  # equal edges have equal numbers below them
    found = picked(held, keys, models.inner_fractions).select(*keys, F.col("total").alias("n"), edges.alias("e"))
    return found.select(*keys, "n", F.col("e.q").alias("edges"), F.col("e.below").alias("below")).join(ends, keys)


def day_scores(vectors: DataFrame, histograms: DataFrame, days: int = HISTORY_DAYS, block: int = 50_000) -> DataFrame:
    """MODEL and raw, as models.raw_scores: with n, how many of a model's training vectors have it; and with user_name,
    window_start and top_features (n null) of vectors that the model tests.

    vectors have chosen (the scope they are tested in) beside FEATURES. They are dealt into blocks of some block of a
    subject's; a block meets the histograms of all days and gives counts, so that no vector is sent to each of its days.
    """
    names, keep = sorted(models.FEATURES), ["user_name", "window_start", "chosen"]
    rows = scoped(vectors.select(*keep, "window_size", "group_id", *names))
    sizes = rows.groupBy(*SUBJECT).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("_blocks"))
    rows = rows.join(F.broadcast(sizes), SUBJECT).withColumn("_block", F.pmod(F.xxhash64("user_name", "window_start"), F.col("_blocks")).cast("int")).drop("_blocks")
    copies = histograms.join(F.broadcast(sizes), SUBJECT).withColumn("_block", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))).drop("_blocks")
    size = vectors.schema["window_size"].dataType.simpleString()
    columns = ["eval_day", *SUBJECT, "raw", "n", "user_name", "window_start", "top_features"]

    def score(own: pd.DataFrame, made: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame(columns=columns)
        if not len(own) or not len(made):
            return none
        start = own["window_start"].to_numpy()
        order = np.argsort(start, kind="stable")
        own, start = own.iloc[order], start[order]
        x = np.ascontiguousarray(own[names].to_numpy().T)
        tests, out = (own["chosen"] == own["scope"].iloc[0]).to_numpy(), []
        for day, model in made.groupby("eval_day"):
            begin, now, end = np.searchsorted(start, [day - days * DAY_MS, day, day + DAY_MS])
            parts = np.zeros((len(names), end - begin))
            for f in model.itertuples():
                edges, below = np.asarray(f.edges, float), np.asarray(f.below, np.int64)
                counts = np.diff(np.concatenate([[0], below, [f.n]]))
                v, i = x[names.index(f.feature), begin:end], names.index(f.feature)
                parts[i] = -np.log((counts + 1.0) / (f.n + len(edges) + 1))[np.searchsorted(edges, v, side="right")]
                parts[i][(v < f.low) | (v > f.high)] = -np.log(1.0 / (f.n + len(edges) + 1))
            raw = np.round(parts.sum(0), 9)
            known, n = np.unique(raw[: now - begin], return_counts=True)
            if len(known):
                out.append(pd.DataFrame({"eval_day": day, "raw": known, "n": n}))
            tested = np.flatnonzero(tests[now:end]) + now
            if len(tested):
                first = np.argsort(-np.round(parts[:, tested - begin].T, 9), axis=1, kind="stable")[:, : models.TOP]
                tops = np.array(names, dtype=object)[first]
                out.append(pd.DataFrame({"eval_day": day, "raw": raw[tested - begin], "user_name": own["user_name"].to_numpy()[tested], "window_start": start[tested], "top_features": list(tops)}))
        if not out:
            return none
        out = pd.concat(out, ignore_index=True).reindex(columns=columns).assign(**{c: own[c].iloc[0] for c in SUBJECT})
        none = {c: out[c].astype(object).where(out[c].notna(), None) for c in ("user_name", "top_features")}
        return out.assign(**none, n=out["n"].astype("Int64"), window_start=out["window_start"].astype("Int64"))

    kinds = f"eval_day long, window_size {size}, scope string, subject string, raw double, n long, user_name string, window_start long, top_features array<string>"
    both = rows.groupBy(*SUBJECT, "_block").cogroup(copies.groupBy(*SUBJECT, "_block"))
    return both.applyInPandas(score, kinds)


def model_day_candidates(windows: DataFrame, peers: DataFrame, from_ms: int, to_ms: int, detector: str = "hbos") -> DataFrame:
    """Windows of each evaluation day that a model of the days before it finds unusual: by the user's peer group if its
    model is ready, else by everyone's. detector: hbos or isolation_forest."""
    ready = settle(model_sizes(windows, peers, from_ms, to_ms).where("status = 'ready'").select(*MODEL))
    tested = windows.where(F.col("window_size").isin(*BASELINE_SIZES) & (F.col("window_start") < to_ms)).withColumn("eval_day", _day()).join(peers.select("user_name", "group_id"), "user_name", "left")
    peer = ready.where("scope = 'peer_group'").select("eval_day", "window_size", F.col("subject").alias("group_id"), F.lit(True).alias("_peer"))
    tested = tested.join(peer, ["eval_day", "window_size", "group_id"], "left").withColumn("chosen", F.when(F.col("_peer"), "peer_group").otherwise("global"))
    shown = [*MODEL, "user_name", "window_start", F.lit(detector).alias("detector_id"), "raw", "threshold", "percentile", "score", "top_features"]
    if detector == "hbos":
        history_ = tested.where(F.col("window_start") >= from_ms - HISTORY_DAYS * DAY_MS)
        vectors = settle(models.features(history_, ("user_name", "window_size", "window_start", "group_id", "chosen")))
        scores = settle(day_scores(vectors, settle(day_histograms(vectors, ready, from_ms, to_ms))))
        known = settle(scores.where("n IS NOT NULL").groupBy(*MODEL, "raw").agg(F.sum("n").alias("n")))
        return models.judged(scores.where("n IS NULL").drop("n"), known, MODEL, fire_only=True).select(*shown)
    training = model_training(windows, peers, from_ms, to_ms)
    tested = tested.where(F.col("window_start") >= from_ms).withColumns({"scope": F.col("chosen"), "subject": F.when(F.col("_peer"), F.col("group_id")).otherwise("")})
    keys, name = ["user_name", "window_start"], F.concat_ws("|", *MODEL).alias("model")

    def vectors_of(rows: DataFrame) -> DataFrame:
        return models.features(rows.join(ready, MODEL).withColumn("model", name), ("model", *MODEL, *keys))

    rows = models.forest_scored(vectors_of(tested), vectors_of(training), "model", [*keys, *MODEL])
    return rows.where("fires").select(*shown)


METRIC_NAMES = (
    "candidate_count", "predicted_user_days", "unique_predicted_users", "active_prediction_days", "average_daily_predictions", "average_daily_candidates", "min_daily_predictions", "max_daily_predictions",
    "daily_prediction_stddev", "daily_prediction_cv", "high_severity_candidates", "max_candidate_score", "min_daily_candidates", "max_daily_candidates",
)


def user_days(candidates: DataFrame) -> DataFrame:
    """A row for each user and day with candidates: the greatest score, their number, and the detectors and severities."""
    return candidates.groupBy("user_name", "eval_day").agg(
        F.max("score").alias("max_score"), F.count(F.lit(1)).alias("candidate_count"), F.array_sort(F.collect_set("detector_id")).alias("detectors"), F.array_sort(F.collect_set("severity")).alias("severities"),
    )


def experiment_metrics(candidates: DataFrame, from_ms: int, to_ms: int) -> DataFrame:
    """One row of METRIC_NAMES over all days of the range, those without candidates too. Predictions are user-days.

    candidates have eval_day, user_name, score, severity. Days and users are counted from user-days, not candidates.
    """
    parts = candidates.groupBy("eval_day", "user_name").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("severity") == "high").alias("high"), F.max("score").alias("score"))
    daily = parts.groupBy("eval_day").agg(F.count(F.lit(1)).alias("predictions"), F.sum("n").alias("candidates"), F.sum("high").alias("high"), F.max("score").alias("score"))
    days = candidates.sparkSession.range(from_ms, to_ms, DAY_MS).withColumnRenamed("id", "eval_day")
    rows = days.join(daily, "eval_day", "left").fillna(0, ["predictions", "candidates", "high", "score"])
    users = parts.select("user_name").distinct().agg(F.count(F.lit(1)).alias("unique_predicted_users"))
    out = rows.agg(
        F.sum("candidates").alias("candidate_count"), F.sum("predictions").alias("predicted_user_days"), F.count_if(F.col("predictions") > 0).alias("active_prediction_days"),
        F.avg("predictions").alias("average_daily_predictions"), F.avg("candidates").alias("average_daily_candidates"), F.min("predictions").alias("min_daily_predictions"), F.max("predictions").alias("max_daily_predictions"),
        F.stddev_pop("predictions").alias("daily_prediction_stddev"), F.sum("high").alias("high_severity_candidates"), F.max("score").alias("max_candidate_score"),
        F.min("candidates").alias("min_daily_candidates"), F.max("candidates").alias("max_daily_candidates"),
    ).crossJoin(F.broadcast(users))  # one row each
    mean = F.col("average_daily_predictions")
    return out.withColumn("daily_prediction_cv", F.when(mean > 0, F.col("daily_prediction_stddev") / mean).otherwise(0.0)).select(*METRIC_NAMES)


def experiment_id(name: str, from_ms: int, to_ms: int, inputs: dict) -> str:
    """What names an experiment: its name, its range of UTC days and what went in (revisions and configurations). The same
    experiment has the same name, so that it need not run twice."""
    if from_ms % DAY_MS or to_ms % DAY_MS or to_ms <= from_ms:
        raise ValueError("an experiment begins and ends at a UTC midnight")
    return fingerprint({"name": name, "start": from_ms, "end": to_ms, "input": fingerprint(inputs)})


def contents(df: DataFrame) -> str:
    """A number for the rows of a table, whatever their order: what an experiment was fed with is part of its name."""
    n, total = df.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*sorted(df.columns)).cast("decimal(38,0)"))).first()
    return f"{n}:{total or 0}"


class Experiments:
    """Stored experiments, each in a folder named by experiment_id: run with the same name, range and inputs, one is
    read and not made again; any change of these makes another."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _table(self, identity: str) -> StateTable:
        return StateTable(self.spark, f"{self.folder}/{identity}", 1, {"experiment": identity})

    def run(self, name: str, from_ms: int, to_ms: int, inputs: dict, make: Callable[[], DataFrame]) -> tuple[str, DataFrame, bool]:
        """The experiment's id, its candidates, and whether they were stored before; make() gives candidates with
        eval_day, user_name, score, severity and detector_id."""
        if not name.strip():
            raise ValueError("an experiment needs a name")
        identity = experiment_id(name, from_ms, to_ms, inputs)
        table = self._table(identity)
        found = table.current()[1]
        if found is not None:
            return identity, found, True
        table.commit(make(), {"name": name, "from": from_ms, "to": to_ms, "inputs": fingerprint(inputs)})
        return identity, table.current()[1], False

    def query(self, identity: str) -> dict:
        """The notes of a stored experiment with its metrics and user-days; StateError where there is none."""
        table = self._table(identity)
        found, notes = table.current()[1], table.notes()
        if found is None:
            raise StateError(f"there is no experiment {identity}")
        return {**notes, "metrics": experiment_metrics(found, notes["from"], notes["to"]), "user_days": user_days(found)}

    def compare(self, left: str, right: str) -> tuple[DataFrame, DataFrame]:
        """How two stored experiments' user-days agree, and how their metrics differ."""
        a, b = self.query(left), self.query(right)
        return compare(a["user_days"], b["user_days"]), deltas(a["metrics"], b["metrics"])


def compare(left: DataFrame, right: DataFrame) -> DataFrame:
    """How two experiments' user-days agree: each side's, both, either, and their Jaccard index (1 where neither has any)."""
    a, b = (x.select("eval_day", "user_name").distinct() for x in (left, right))
    joined = a.withColumn("a", F.lit(1)).join(b.withColumn("b", F.lit(1)), ["eval_day", "user_name"], "full_outer")
    out = joined.agg(F.count("a").alias("left_user_days"), F.count("b").alias("right_user_days"), F.count(F.lit(1)).alias("either"), F.count_if(F.expr("a = 1 AND b = 1")).alias("both"))
    return out.withColumn("jaccard", F.when(F.col("either") > 0, F.col("both") / F.col("either")).otherwise(1.0))


def deltas(left: DataFrame, right: DataFrame) -> DataFrame:
    """metric, delta: how the right experiment's metrics (a row of experiment_metrics) differ from the left one's."""
    long = lambda df, name: df.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias(name)) for m in METRIC_NAMES])).alias("x")).select("x.*")
    return long(left, "l").join(long(right, "r"), "metric").select("metric", (F.col("r") - F.col("l")).alias("delta"))
