"""Versions of windows, candidates and assessments, baselines against plain counts, and experiments."""

import random

import pytest
from pyspark.sql import functions as F

from vigil.operators import baseline, detection, evaluation, features, fusion
from vigil.settings import METRICS

from .test_features import HOUR, T0, event, frame, plain_percentile

DAY = 24 * HOUR


@pytest.mark.parametrize("seed", range(3))
def test_padded_statistics_against_plain(spark, seed):
    r = random.Random(seed)
    rows = [([float(r.choice([0, 1, 1, 2, 7, 500])) for _ in range(r.randint(1, 30))], r.choice([0, 0, 1, 5, 700])) for _ in range(40)]
    got = spark.createDataFrame([(i, v, z) for i, (v, z) in enumerate(rows)], "i int, v array<double>, z long").select("i", baseline.padded_statistics(F.col("v"), F.col("z")).alias("s")).select("i", "s.*").collect()
    for x in got:
        vs = rows[x.i][0] + [0.0] * rows[x.i][1]
        mean, p50 = sum(vs) / len(vs), plain_percentile(vs, 0.5)
        want = (len(vs), mean, (sum((v - mean) ** 2 for v in vs) / len(vs)) ** 0.5, min(vs), max(vs), p50, plain_percentile(vs, 0.95), plain_percentile(vs, 0.99), plain_percentile([abs(v - p50) for v in vs], 0.5))
        assert (x.sample_count, x.mean, x.std, x.min, x.max, x.p50, x.p95, x.p99, x.mad) == pytest.approx(want, rel=1e-9, abs=1e-9)


def test_personal_and_group_baselines(spark):
    """Windows from the first to the last active one, of the history alone; groups of windows that were seen."""
    rows = [event(f"{u}{d}{h}", d * DAY + h * HOUR, user=u, size=d + h) for u in ("ana", "bo", "cy") for d in range(40) for h in range(0, 24, 5) if (d * 7 + h + len(u)) % 3]
    windows = features.user_windows(frame(spark, rows)).cache()
    peers = spark.createDataFrame([("ana", "g"), ("bo", "g")], "user_name string, group_id string")
    as_of = T0 + 38 * DAY + 7 * HOUR
    personal = baseline.personal_baselines(windows, as_of).cache()
    held = [w for w in windows.collect() if w.window_size in (3600, 86400)]
    for p in personal.collect():
        width = p.window_size * 1000
        own = {w.window_start: w for w in held if (w.user_name, w.window_size) == (p.user_name, p.window_size)}
        start, end = max(min(own), (as_of - 30 * DAY) // width * width), min(max(own), as_of // width * width)
        slots = range(start, end + 1, width)
        values = [float(own[t].network_bytes_total) if t in own else 0.0 for t in slots]
        s = next(x for x in p.stats if x.metric == "network_bytes_total")
        assert (s.sample_count, s.mean, s.p95) == pytest.approx((len(values), sum(values) / len(values), plain_percentile(values, 0.95)))
        assert p.active_days == len({t // DAY for t in slots if t in own}) and [x.metric for x in p.stats] == list(METRICS)
    for g in baseline.group_baselines(windows, personal, peers, as_of).collect():
        own = [w for w in held if w.window_size == g.window_size and as_of - 30 * DAY <= w.window_start <= as_of and (g.scope == "global" or w.user_name in ("ana", "bo"))]
        values = [float(w.event_count) for w in own]
        s = g.stats[0]
        assert (s.metric, s.sample_count, s.mean, s.p99) == pytest.approx(("event_count", len(values), sum(values) / len(values), plain_percentile(values, 0.99)))
        assert g.member_count == (3 if g.scope == "global" else 2) and g.active_days == len({w.window_start // DAY for w in own})


def test_stamps(spark):
    one = features.stamped(spark.createDataFrame([("a", 1, "x"), ("b", 2, None)], "k string, n int, t string"), None, ["k"], 1)
    two = features.stamped(spark.createDataFrame([("a", 1, "x"), ("b", 2, "y"), ("c", 3, None)], "k string, n int, t string"), one, ["k"], 2)
    assert {r.k: r.updated_revision for r in two.collect()} == {"a": 1, "b": 2, "c": 2}
    again = features.stamped(two.drop("updated_revision"), two, ["k"], 3)
    assert {r.k: r.updated_revision for r in again.collect()} == {"a": 1, "b": 2, "c": 2}


def candidates(spark, rows):
    return spark.createDataFrame(rows, "candidate_key string, user_name string, window_size int, window_start long, score int")


def test_superseding(spark):
    first = detection.first_versions(candidates(spark, [("k1", "ana", 3600, 0, 60), ("k2", "ana", 3600, 3600, 60), ("k3", "bo", 3600, 0, 60)]), 1)
    touched = candidates(spark, [("", "ana", 3600, 0, 0), ("", "ana", 3600, 7200, 0)])
    found = candidates(spark, [("k1", "ana", 3600, 0, 80), ("k4", "ana", 3600, 7200, 60)])
    show = lambda df: sorted((r.candidate_key, r.revision, r.status, r.score) for r in df.collect())
    two = detection.superseded(first, found, 2, touched).cache()
    want = [("k1", 1, "superseded", 60), ("k1", 2, "active", 80), ("k2", 1, "active", 60), ("k3", 1, "active", 60), ("k4", 2, "active", 60)]
    assert show(two) == want
    ids = {(r.candidate_key, r.revision): r for r in two.collect()}
    assert ids["k1", 2].supersedes == ids["k1", 1].candidate_id and ids["k4", 2].supersedes is None
    assert show(detection.superseded(two, found, 2, touched)) == want  # a run that comes again
    gone = detection.superseded(two, found.limit(0), 3, touched).cache()
    assert [s for k, r, s, _ in show(gone) if k in ("k1", "k4")] == ["superseded"] * 3
    every = detection.superseded(two, found.where("candidate_key = 'k1'"), 4)  # refreshed rules look at everything again
    assert [(k, r) for k, r, s, _ in show(every) if s == "active"] == [("k1", 4)]


def test_versions_of_assessments(spark):
    made = lambda *rows: spark.createDataFrame([*rows], "assessment_key string, policy_action string")
    one = fusion.versioned(None, made(("a", "alert"), ("b", "alert")), 1).cache()
    two = fusion.versioned(one, made(("a", "alert"), ("c", "alert")), 2).cache()
    show = lambda df: sorted((r.assessment_key, r.revision, r.status, r.policy_action, r.supersedes is not None) for r in df.collect())
    assert show(two) == [("a", 1, "superseded", "alert", False), ("a", 2, "active", "alert", True), ("b", 1, "superseded", "alert", False), ("c", 2, "active", "alert", False)]
    refreshed = fusion.versioned(two, made(("a", "below_threshold"), ("c", "alert")), 2)
    assert show(refreshed) == [("a", 1, "superseded", "alert", False), ("a", 2, "active", "below_threshold", True), ("b", 1, "superseded", "alert", False), ("c", 2, "active", "alert", False)]


def test_experiments(spark):
    r = random.Random(2)
    rows = [(d * DAY, f"u{r.randrange(4)}", r.choice(["p95", "p99"]), r.choice([60, 80])) for d in (0, 1, 4) for _ in range(r.randint(1, 9))]
    made = spark.createDataFrame([(d, u, x, s, "high" if s == 80 else "medium") for d, u, x, s in rows], "eval_day long, user_name string, detector_id string, score int, severity string")
    got = evaluation.experiment_metrics(made, 0, 6 * DAY).first()
    predictions = [len({u for d, u, _, _ in rows if d == k * DAY}) for k in range(6)]
    per_day = [sum(d == k * DAY for d, _, _, _ in rows) for k in range(6)]
    mean = sum(predictions) / 6
    std = (sum((p - mean) ** 2 for p in predictions) / 6) ** 0.5
    want = (len(rows), sum(predictions), len({u for _, u, _, _ in rows}), 3, mean, len(rows) / 6, min(predictions), max(predictions), std, std / mean, sum(s == 80 for *_, s in rows), max(s for *_, s in rows), min(per_day), max(per_day))
    assert tuple(got) == pytest.approx(want)
    none = evaluation.experiment_metrics(made.limit(0), 0, 2 * DAY).first()
    assert (none.candidate_count, none.predicted_user_days, none.daily_prediction_cv, none.max_candidate_score) == (0, 0, 0.0, 0)
    days = {(x.user_name, x.eval_day): x for x in evaluation.user_days(made).collect()}
    assert len(days) == sum(predictions) and all(x.max_score == max(s for d, u, _, s in rows if (u, d) == k) for k, x in days.items())
    delta = {x.metric: x.delta for x in evaluation.deltas(evaluation.experiment_metrics(made, 0, 6 * DAY), evaluation.experiment_metrics(made.where("score = 80"), 0, 6 * DAY)).collect()}
    assert delta["candidate_count"] == -sum(s == 60 for *_, s in rows) and set(delta) == set(evaluation.METRIC_NAMES)
    both = evaluation.compare(made, made.where("score = 80")).first()
    assert (both.left_user_days, both.right_user_days, both.either) == (sum(predictions), both.both, sum(predictions))
    one = evaluation.experiment_id("x", 0, DAY, {"a": 1})
    assert one == evaluation.experiment_id("x", 0, DAY, {"a": 1}) and len({one, evaluation.experiment_id("y", 0, DAY, {"a": 1}), evaluation.experiment_id("x", 0, 2 * DAY, {"a": 1}), evaluation.experiment_id("x", 0, DAY, {"a": 2})}) == 4
    for bad in ((1, DAY), (0, 5), (DAY, DAY)):
        with pytest.raises(ValueError):
            evaluation.experiment_id("x", *bad, {})


def test_values_of_past_days(spark):
    r = random.Random(3)
    rows = [(f"u{r.randrange(3)}", 3600, T0 + r.randrange(20) * DAY + r.randrange(24) * HOUR, "source_ip", f"ip{min(r.randrange(40), 6)}", r.randint(1, 3)) for _ in range(400)]
    totals = {}
    for u, s, w, k, v, n in rows:
        totals[u, s, w, k, v] = totals.get((u, s, w, k, v), 0) + n
    values = spark.createDataFrame([(*k, n) for k, n in totals.items()], "user_name string, window_size int, window_start long, value_type string, value_key string, event_count int")
    span = T0 + 10 * DAY, T0 + 20 * DAY
    known = evaluation.day_values(values, *span).cache()
    want = {}
    for day in range(*span, DAY):
        past = [(u, v, w, n) for (u, _, w, _, v), n in totals.items() if day - 30 * DAY <= w < day]
        for u, v, _, _ in past:
            own = [(w, n) for x, y, w, n in past if (x, y) == (u, v)]
            want[day, u, v] = sum(n for _, n in own), sum(n for _, n in own) / sum(n for x, _, _, n in past if x == u), min(w for w, _ in own)
    assert {(x.eval_day, x.user_name, x.value_key): (x.event_count, x.share, x.first_seen) for x in known.collect()} == want
    ready = known.select("eval_day", "user_name").distinct()
    hit = {(x.user_name, x.window_start, x.value_key) for x in evaluation.day_value_candidates(values, known, ready).collect()}
    plain = {(u, w, v) for (u, _, w, _, v) in totals if (d := (w // DAY * DAY, u, v)) in want and want[d][1] <= 0.01 and want[d][0] <= 3}
    assert hit == plain
