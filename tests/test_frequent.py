import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from vigil.operators import evaluation, frequent, quality
from vigil.operators.features import DAY_MS
from vigil.sources.state import StateError


def test_exact_below_the_bound_and_bounded_above(spark, monkeypatch):
    monkeypatch.setattr(frequent, "FAN", 2)
    r = random.Random(3)
    items = [f"hot{min(r.randrange(6), 3)}" if r.random() < 0.5 else f"x{r.randrange(900)}" for _ in range(4000)] + [None, ""] * 5
    df = spark.createDataFrame([(x, 1) for x in items], "item string, error int").repartition(5)
    want = Counter(x for x in items if x)
    whole = frequent.frequent_items(df, "item", limit=2000).collect()
    assert {x.item: x.n for x in whole} == want and {x.error for x in whole} == {0}
    for limit in (20, 100):
        rows = frequent.frequent_items(df, "item", limit=limit).collect()
        (error,) = {x.error for x in rows}
        assert 0 < error <= 4000 / (limit + 1) and len(rows) <= limit
        assert all(x.n <= want[x.item] <= x.n + error for x in rows)
        listed = {x.item for x in rows}
        assert all(n <= error for x, n in want.items() if x not in listed) and {"hot0", "hot3"} <= listed
    assert frequent.frequent_items(df.limit(0), "item").count() == 0
    twice = frequent.frequent_items(spark.createDataFrame([("a", 5), ("b", 2), ("a", 1)], "k string, times int"), "k", "times")
    assert sorted(map(tuple, twice.collect())) == [("a", 6, 0), ("b", 2, 0)]


def test_snapshots_stay_bounded(spark):
    rows = [("template", f"t{i}", 1 + (i == 3) * 50) for i in range(30)] + [("normalized", "", 9)]
    df = spark.createDataFrame(rows, "measure string, key string, n long")
    assert quality.bounded(df, 30) is df
    out = {(x.measure, x.key): x.n for x in quality.bounded(df, 10).collect()}
    assert out == {("normalized", ""): 9, ("template", "t3"): 50, ("template_error", ""): 1}
    again = spark.createDataFrame([(*k, n) for k, n in out.items()] + [("template", f"u{i}", 2) for i in range(12)], df.schema)
    out = {(x.measure, x.key): x.n for x in quality.bounded(again, 10).collect()}
    assert out == {("normalized", ""): 9, ("template", "t3"): 48, ("template_error", ""): 3}


def test_experiments_are_stored_by_what_they_are(spark, tmp_path):
    store, made = evaluation.Experiments(spark, str(tmp_path)), []
    rows = spark.createDataFrame([(0, "u", 80, "high", "d"), (0, "u", 60, "medium", "e"), (DAY_MS, "v", 60, "medium", "e")], "eval_day long, user_name string, score int, severity string, detector_id string")
    run = lambda name="n", end=2 * DAY_MS, df=rows, **more: store.run(name, 0, end, {"rows": evaluation.contents(df), **more}, lambda: made.append(1) or df)
    one, found, reused = run()
    assert not reused and found.count() == 3 and run()[2] and run()[0] == one and len(made) == 1
    assert run(df=rows.orderBy(F.desc("score")))[0] == one  # the order of rows is none of its inputs
    others = {run(name="m")[0], run(end=3 * DAY_MS)[0], run(df=rows.where("score > 60"))[0], run(rules="x")[0]}
    assert len(others | {one}) == 5 and len(made) == 5
    held = store.query(one)
    assert held["metrics"].first().candidate_count == 3 and held["user_days"].count() == 2 and held["name"] == "n"
    agreed, deltas = store.compare(one, run(df=rows.where("score > 60"))[0])
    assert agreed.first().both == 1 and {r.metric: r.delta for r in deltas.collect()}["candidate_count"] == -2
    for bad in (lambda: store.query("none"), lambda: run(name=" "), lambda: run(end=5)):
        with pytest.raises((StateError, ValueError)):
            bad()


def test_items_are_counted_without_python(spark):
    rows = frequent.frequent_items(spark.range(1000).selectExpr("concat('t', id % 300) AS k"), "k", limit=1000)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan and "FlatMapGroups" not in plan and rows.count() == 300
