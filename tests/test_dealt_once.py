"""The first batch of the live chain is dealt by user once, and written once as it is dealt."""

from pyspark.sql import functions as F

from vigil.operators import detection
from vigil.plans.live import Live
from vigil.settings import METRICS
from vigil.sources.keyed import KeyedTable
from vigil.sources.state import settle_by

from .test_features import T0, frame
from .test_live import DAY, LOW, RULE, generated


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_dealt_rows_are_neither_shuffled_nor_sorted(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "k"), 1, {}, "k", buckets=4)
    tasks = table.tasks_for(5)
    assert tasks == 8
    a, b = (settle_by("k", tasks, spark.range(i, i + 500).selectExpr("concat('u', id % 50) AS k", "id AS v")) for i in (0, 500))
    assert table.dealt() is None
    table.replace([a, b], a.select("k").union(b.select("k")), {"n": 1}, tasks)
    assert table.notes() == {"n": 1} and len(table.manifest()["parts"]) == 4
    want = sorted((f"u{i % 50}", i) for i in range(1000))
    for rows in (table.dealt(), table.current()[1]):
        assert sorted(map(tuple, rows.select("k", "v").collect())) == want
    assert "Exchange hashpartitioning" not in _plan(table.dealt().groupBy("k", "v").count().join(a, ["k", "v"]))
    assert len(table.dealt().inputFiles()) <= 2 * tasks  # a file a task and part
    assert [r.v for r in table.lookup("u7").orderBy("v").collect()] == [7 + 50 * i for i in range(20)]
    keys = spark.createDataFrame([("u7",)], "k string")
    table.replace(spark.createDataFrame([("u7", -1)], "k string, v long"), keys, tasks=tasks)
    assert table.dealt() is None and table.lookup("u7").count() == 1 and table.current()[1].count() == 981


def test_stages_behind_the_first_batch_read_it_as_dealt(spark, tmp_path, monkeypatch):
    peers = spark.createDataFrame([(f"u{i}", f"g{i % 2}") for i in range(8)], "user_name string, group_id string")
    live = Live(spark, str(tmp_path / "live"), peers, [RULE], config=LOW, buckets=4)
    batch = frame(spark, generated(60, 5)).withColumn("reason", F.lit(None).cast("string"))
    put, rewritten = KeyedTable._write_buckets, []
    monkeypatch.setattr(KeyedTable, "_write_buckets", lambda self, rows: rewritten.append(self.folder.rpartition("/")[2]) or put(self, rows))
    assert live.step(batch, T0 + 12 * DAY).count() > 0
    assert rewritten == ["ids"] and all(t.dealt() is not None for t in (live.events, live.parts, live.windows, live.personal, live.candidates))


def test_windows_are_compared_without_lambdas(spark):
    limits = "array(" + ", ".join(f"named_struct('metric', '{m}', 'p95', {5.0 + i}D, 'p99', {20.0 + i}D)" for i, m in enumerate(METRICS)) + ")"
    policy = "named_struct('p95_score', 60, 'p99_score', 80) AS policy"
    base = spark.range(30).selectExpr("concat('u', id) AS user_name", "3600 AS window_size", "id AS window_start", "id + 1 AS window_end", "'g' AS group_id", "if(id = 29, null, 'personal') AS scope", f"if(id = 29, null, {limits}) AS limits", policy, *[f"id AS {m}" for m in METRICS])
    found = detection.numeric_candidates(base)
    assert "lambda" not in _plan(found)
    want = sorted((f"u{v}", m, "numeric_p99" if v > 20 + i else "numeric_p95", 80 if v > 20 + i else 60) for v in range(29) for i, m in enumerate(METRICS) if v > 5 + i)
    assert sorted(map(tuple, found.select("user_name", "metric", "detector_id", "score").collect())) == want
