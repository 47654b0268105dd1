"""The parts of windows are made from one shuffle of the events."""

from vigil.operators import features, fusion
from vigil.queries import full
from vigil.sources.state import settle_by

EVENTS = "event_id string, event_time_ms long, user_name string, source_type string, action string, outcome string, source_ip string, resource_key string, resource_display string, network_bytes long"


def test_parts_of_events_dealt_by_user_need_no_shuffle_of_their_own(spark):
    rows = [(f"e{i}", i * 1_000_000, f"u{i % 3}", "svn", "repo_read", "success", "10.0.0.1", "page:a", "a", i) for i in range(30)]
    parts = features.window_parts(features.by_user(spark.createDataFrame(rows, EVENTS)))
    plan = parts._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(user_name#") == plan.count("REPARTITION_BY_NUM") > 0 and "ENSURE_REQUIREMENTS" not in plan
    assert sorted(map(str, parts.collect())) == sorted(map(str, features.window_parts(spark.createDataFrame(rows, EVENTS)).collect()))


def test_incidents_of_dealt_events_shuffle_nothing(spark):
    c = full(spark, "/root/testdata/sf0.001")
    plan = c.incidents._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in plan and "Exchange hashpartitioning" not in plan
    plan = fusion.versioned(fusion.versioned(None, fusion.assessments(c.rated, now_ms=0), 1), fusion.assessments(c.rated, now_ms=0), 2)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan


def test_rows_of_several_tables_are_kept_in_the_same_buckets(spark):
    a, b = (spark.range(i, i + 500).selectExpr("concat('u', id % 20) AS user_name", "id") for i in (0, 500))
    kept = settle_by("user_name", 5, a, b)
    assert kept.count() == 1000
    grouped = kept.groupBy("user_name", "id").count().join(kept, ["user_name", "id"])
    assert "Exchange hashpartitioning" not in grouped._jdf.queryExecution().executedPlan().toString() and grouped.count() == 1000
