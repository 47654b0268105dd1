"""Models of each past day from counts that slide over the days, against a fit of every day's training rows."""

import numpy as np
from pyspark.sql import functions as F

from vigil.operators import evaluation, models
from vigil.operators.features import DAY_MS
from vigil.settings import METRICS


def _windows(spark):
    rng, rows = np.random.default_rng(3), []
    for u in range(14):
        for d in sorted(rng.choice(75, 50, replace=False)) if u else (0, 1, 40, 74):
            values = {m: int(rng.integers(0, 4)) for m in METRICS} | {"event_count": int(rng.integers(1, 30)), "network_bytes_total": int(rng.integers(1, 10**6))}
            rows.append((f"u{u}", 86_400, int(d) * DAY_MS, *values.values()))
    windows = spark.createDataFrame(rows, ", ".join(["user_name string", "window_size int", "window_start long", *[f"{m} long" for m in METRICS]]))
    peers = spark.createDataFrame([(f"u{u}", f"g{u % 2}") for u in range(13)], "user_name string, group_id string")
    return windows, peers


def test_sizes_of_models_are_those_of_their_training_rows(spark):
    windows, peers = _windows(spark)
    for from_, to in ((0, 76), (33, 60)):
        args = windows, peers, from_ * DAY_MS, to * DAY_MS
        want = {tuple(r) for r in evaluation.model_snapshots(evaluation.model_training(*args)).collect()}
        assert want and {tuple(r) for r in evaluation.model_sizes(*args).collect()} == want


def test_days_scores_are_those_of_a_fit_of_each_days_rows_and_no_window_meets_each_day(spark):
    windows, peers = _windows(spark)
    from_, to = 20 * DAY_MS, 76 * DAY_MS
    found = evaluation.model_day_candidates(windows, peers, from_, to)
    assert "sequence(greatest" not in found._jdf.queryExecution().optimizedPlan().toString()
    got = {(r.eval_day, r.user_name): (r.scope, r.subject, round(r.raw, 6), round(r.threshold, 6), round(r.percentile, 6), r.score, tuple(r.top_features)) for r in found.collect()}
    training = evaluation.model_training(windows, peers, from_, to)
    ready = evaluation.model_snapshots(training).where("status = 'ready'").select(*evaluation.MODEL)
    day = F.col("window_start") - F.pmod("window_start", F.lit(DAY_MS))
    tested = windows.where((F.col("window_start") >= from_) & (F.col("window_start") < to)).withColumn("eval_day", day).join(peers, "user_name", "left")
    name = F.concat_ws("|", *evaluation.MODEL).alias("model")
    vectors = lambda rows: models.features(rows.join(ready, evaluation.MODEL).withColumn("model", name), ("model", *evaluation.MODEL, "user_name", "window_start"))
    rows = models.scored(vectors(evaluation.scoped(tested)), vectors(training), "model", ["user_name", "window_start", *evaluation.MODEL]).where("fires").collect()
    by_group = {(r.eval_day, r.subject) for r in ready.where("scope = 'peer_group'").collect()}
    group = {r.user_name: r.group_id for r in peers.collect()}
    chosen = [r for r in rows if r.scope == ("peer_group" if (r.eval_day, group.get(r.user_name)) in by_group else "global")]
    assert len(chosen) > 5 and len({r.scope for r in chosen}) == 2
    assert got == {(r.eval_day, r.user_name): (r.scope, r.subject, round(r.raw, 6), round(r.threshold, 6), round(r.percentile, 6), r.score, tuple(r.top_features)) for r in chosen}
