"""The features that are furthest from the median are told in place, without rows of their own."""

import numpy as np

from vigil.operators import models


def test_furthest_features_without_a_row_a_feature(spark):
    rng = np.random.default_rng(5)
    rows = [(f"u{i}", f"g{i % 2}", *map(float, np.round(rng.random(len(models.FEATURES)), 2))) for i in range(60)]
    vectors = spark.createDataFrame(rows, ["user_name", "group_id", *models.FEATURES])
    out = models.furthest(vectors, vectors, "group_id", ["user_name"])
    assert "Generate" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = {r.user_name: r.top_features for r in out.collect()}
    for g in ("g0", "g1"):
        own = [r for r in rows if r[1] == g]
        x = np.array([r[2:] for r in own])
        middle = np.median(x, axis=0)
        far = -np.abs(x - middle) / np.maximum(np.median(np.abs(x - middle), axis=0), 1e-9)
        for r, f in zip(own, far):
            assert got[r[0]] == [n for _, n in sorted(zip(f, models.FEATURES))[: models.TOP]]


def test_scores_of_the_training_rows_are_made_once(spark, monkeypatch):
    made = []
    kept = models.forest_scores
    monkeypatch.setattr(models, "forest_scores", lambda *a, **k: made.append(1) or kept(*a, **k))
    rng = np.random.default_rng(6)
    rows = [(f"u{i}", "g", *map(float, rng.random(len(models.FEATURES)))) for i in range(120)]
    vectors = spark.createDataFrame(rows, ["user_name", "group_id", *models.FEATURES])
    assert models.forest_scored(vectors, vectors, "group_id", ["user_name"], trees=5).count() == 120 and len(made) == 1
