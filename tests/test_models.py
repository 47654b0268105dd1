"""Ranks, isolation trees and point-in-time model detection."""

import numpy as np
from pyspark.sql import functions as F

from vigil.operators import evaluation, models, ranks
from vigil.operators.features import DAY_MS
from vigil.settings import METRICS


def test_quantiles_and_percentiles(spark):
    rng = np.random.default_rng(1)
    data = [(k, float(v)) for k, size in (("a", 1), ("b", 2), ("c", 500)) for v in np.round(rng.exponential(5, size), 1)] + [("d", 0.0)] * 9
    rows = spark.createDataFrame(data, "g string, value double")
    ps = [0.0, 0.31, 0.5, 0.995, 1.0]
    got = {r.g: r.q for r in ranks.quantiles(rows, ["g"], lambda _: F.array(*map(F.lit, ps))).collect()}
    for g in "abcd":
        np.testing.assert_allclose(got[g], np.quantile([v for k, v in data if k == g], ps), atol=1e-9)
    tests = spark.createDataFrame([("c", 3.0, 1), ("c", 0.0, 2), ("c", 1e6, 3), ("x", 1.0, 4)], "g string, value double, id int")
    c = [v for k, v in data if k == "c"]
    shares = {r.id: r.percentile for r in ranks.empirical(tests, rows, ["g"], "value").collect()}
    assert shares == {1: sum(v <= 3 for v in c) / 500, 2: sum(v <= 0 for v in c) / 500, 3: 1.0}  # no rows of x are known


def windows(spark, users: int, days: int, first: int = 0):
    rng, rows = np.random.default_rng(2), []
    for u in range(users):
        for d in range(days):
            odd = u == 0 and d == days - 1
            n = 900 if odd else int(rng.integers(5, 15))
            values = dict.fromkeys(METRICS, 1) | {"event_count": n, "success_count": n, "failure_count": 0, "other_outcome_count": 0, "network_bytes_total": n * (10_000 if odd else int(rng.integers(50, 150))), "read_action_count": n, "write_action_count": 0}
            rows.append((f"u{u}", 86_400, first + d * DAY_MS, first + (d + 1) * DAY_MS, *values.values()))
    return spark.createDataFrame(rows, ", ".join(["user_name string", "window_size int", "window_start long", "window_end long", *[f"{m} long" for m in METRICS]]))


def test_isolation_trees_find_the_odd_window(spark):
    w = windows(spark, 12, 20)
    v = models.features(w).withColumn("g", F.lit("all"))
    rows = models.forest_scored(v, v, "g", ["user_name", "window_start"], trees=50).collect()
    assert len(rows) == 240 and all(0 < r.raw < 1 and 0 < r.percentile <= 1 for r in rows)
    top = max(rows, key=lambda r: r.raw)
    assert (top.user_name, top.window_start, top.score, top.fires) == ("u0", 19 * DAY_MS, 100, True)
    assert set(top.top_features) & {"event_count_log", "network_bytes_log"}
    again = models.forest_scored(v.repartition(7), v.repartition(3), "g", ["user_name", "window_start"], trees=50).collect()
    assert {(r.user_name, r.window_start): r.raw for r in rows} == {(r.user_name, r.window_start): r.raw for r in again}
    assert not models.forest_scored(v.limit(5), v.limit(50), "g", ["user_name", "window_start"], trees=5).collect()  # too few rows for a model


def test_models_of_a_day_know_only_the_days_before(spark):
    w = windows(spark, 12, 20)
    peers = spark.createDataFrame([(f"u{u}", "small" if u > 9 else "large") for u in range(11)], "user_name string, group_id string")
    from_, to = 18 * DAY_MS, 20 * DAY_MS
    made = {(r.eval_day // DAY_MS, r.scope, r.subject): (r.sample_count, r.member_count, r.status) for r in evaluation.model_snapshots(evaluation.model_training(w, peers, from_, to)).collect()}
    assert made == {
        (18, "global", ""): (216, 12, "ready"), (19, "global", ""): (228, 12, "ready"), (18, "peer_group", "large"): (180, 10, "ready"), (19, "peer_group", "large"): (190, 10, "ready"),
        (18, "peer_group", "small"): (18, 1, "model_not_ready"), (19, "peer_group", "small"): (19, 1, "model_not_ready"),
    }
    for detector in ("hbos", "isolation_forest"):
        hits = evaluation.model_day_candidates(w, peers, from_, to, detector).collect()
        assert all(h.raw >= h.threshold and h.detector_id == detector for h in hits)
        assert all(h.scope == ("global" if h.user_name in ("u10", "u11") else "peer_group") for h in hits)
        if detector == "hbos":  # trees see no further than their training's range
            odd = [h for h in hits if h.user_name == "u0" and h.eval_day == 19 * DAY_MS]
            assert len(odd) == 1 and odd[0].percentile == 1.0


def test_registered_model_backtest_judges_every_day(spark, monkeypatch):
    from vigil import queries

    seen = []
    monkeypatch.setattr(evaluation, "model_day_candidates", lambda windows, peers, from_, to: seen.append((from_, to)) or windows)
    queries.e04_hbos_days(spark, "/root/testdata/sf0.001")
    times = spark.read.parquet("/root/testdata/sf0.001/events.parquet").selectExpr("min(ts) AS a", "max(ts) AS b").first()
    day = lambda t: int(t.replace(tzinfo=__import__("datetime").timezone.utc).timestamp()) // 86_400 * DAY_MS
    assert seen == [(day(times.a), day(times.b) + DAY_MS)]


def test_forest_scores_against_a_plain_walk(spark):
    """Each tree sees 256 of all rows; a row's score is what walking every tree node by node gives."""
    v = models.features(windows(spark, 30, 20)).withColumn("g", F.lit("all")).cache()
    forest = models.fit_forest(v, "g", trees=12).collect()
    assert sorted(t.tree for t in forest) == [*range(12)] and {t["take"] for t in forest} == {256}
    got = {(r.user_name, r.window_start): r.raw for r in models.forest_scores(v, spark.createDataFrame(forest), "g", ["user_name", "window_start"], block=100).collect()}

    def depth(tree, row):
        at = 0
        while tree.feature[at] >= 0:
            at = tree.left[at] + (row[models.FEATURES[tree.feature[at]]] > tree.split[at])
        return tree.path[at]

    n = models.average_path(256)
    for row in v.collect():
        mean = sum(depth(t, row) for t in forest) / 12
        assert abs(got[row.user_name, row.window_start] - 2 ** (-mean / n)) < 1e-8
