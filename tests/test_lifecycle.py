"""Quality snapshots, parser drafts, shadow replays, proposals and investigations."""

import pytest
from pyspark.sql import functions as F

from vigil.functions import parsing, registry
from vigil.operators import cases, investigation, quality
from vigil.operators.features import DAY_MS
from vigil.operators.readiness import next_actions
from vigil.plans import generation
from vigil.sources import files

LINES = ["level=INFO user=ana bytes=12 password=hush", "level=WARN user=bo bytes=7 user=cy", '{"user": "ana", "n": 3, "deep": {"a": 1}}', "plain words", ""]


def unknown(spark):
    framed = spark.createDataFrame([(f"f{i}", 1, 1, 1, t) for i, t in enumerate(LINES)], "path string, line_start int, line_end int, record_index int, raw_text string")
    return parsing.routed(files.raw_records(framed, "main", "auto"))


def test_snapshot_is_sound_and_merges(spark):
    good, rest = unknown(spark)
    whole = quality.snapshot(good, rest)
    assert quality.violations(whole).isEmpty()
    count = lambda s: {(r.measure, r.key): r.n for r in s.collect()}
    assert count(whole)[("unknown", "")] == 5 and count(whole)[("reason", "no_parser")] == 5
    halves = [quality.snapshot(good, rest.where((F.col("template_hint") == "plain words") == x)) for x in (True, False)]
    assert count(quality.merged(*halves)) == count(whole)
    broken = whole.withColumn("n", F.when(F.col("measure") == "reason", F.col("n") - 1).otherwise(F.col("n")))
    assert [r.problem for r in quality.violations(broken).collect()] == ["reasons do not add up"]
    assert quality.violations(whole.limit(0)).isEmpty()


def test_drafts_from_samples(spark):
    rows = {r.detected_format: r for r in registry.suggested(quality.parser_candidates(unknown(spark)[1])).collect()}
    assert rows["json"].field_candidates == {"user": "ana", "n": "3"} and rows["json"].schema_mapping == {"user": "user.name"}
    assert rows["key_value"].confidence == 0.7 and set(rows["key_value"].schema_mapping) == {"level", "user", "bytes"}
    assert rows["text"].field_candidates == {} and rows["text"].confidence == 0.3 and rows["empty"].parser_type == "empty"


def test_shadow_replay(spark):
    rest = unknown(spark)[1]
    parser = {"parser_id": "p", "status": "shadow", "parser_type": "key_value", "field_candidates": {"user": "ana", "level": "INFO"}, "schema_mapping": {"user": "user.name"}}
    with pytest.raises(registry.RegistryError):
        registry.shadow_replay(rest, {**parser, "status": "draft"})
    ids = {r.raw_text: r.record_id for r in rest.collect()}
    parser["test_cases"] = [{"record_id": ids[LINES[1]], "expected_fields": {"user": "cy"}}]
    results = registry.shadow_replay(rest, parser)
    got = {r.record_id: (r.matched, r.wrong) for r in results.collect()}
    assert got[ids[LINES[0]]] == (True, {}) and got[ids[LINES[1]]] == (True, {}) and got[ids[LINES[3]]] == (False, {"user": "ana", "level": "INFO"})
    report = registry.shadow_report(results, parser).first()
    assert (report.replay_record_count, report.matched_count, report.success_rate, report.schema_mapping_rate) == (5, 2, 0.4, 0.5)
    assert registry.shadow_report(results.limit(0), parser).first().success_rate == 0.0


def test_proposals(spark):
    rest = unknown(spark)[1]
    asked = generation.requests(rest)
    by = {r.detected_format: r for r in asked.collect()}
    assert by["key_value"].record_count == 2 and any("password=<REDACTED>" in x for x in by["key_value"].samples) and not any("hush" in x for r in by.values() for x in r.samples)
    seen = spark.createDataFrame([(by["text"].format_fingerprint,)], "format_fingerprint string")
    assert {r.detected_format for r in generation.requests(rest, seen).collect()} == {"key_value", "json", "empty"}

    def provider(request):
        if request["detected_format"] == "key_value":
            return {"parser_type": "key_value", "field_candidates": {"user": "ana"}, "schema_mapping": {"user": "user.name"}, "test_cases": [{"raw_text": LINES[0], "expected_fields": {"user": "ana"}}]}
        if request["detected_format"] == "json":
            return {"parser_type": "json", "field_candidates": {"user": "ana"}, "schema_mapping": {"user": "nowhere"}}
        raise OSError("no answer")

    drafts, failures = generation.proposed(asked, provider)
    assert len(drafts) == 1 and len(failures) == 3
    parser = generation.brought_to_approval(rest, drafts[0])
    assert parser["status"] == "pending_approval" and (parser["shadow_replay_record_count"], parser["shadow_replay_success_rate"]) == (2, 1.0)
    assert generation.brought_to_approval(rest, {**drafts[0], "test_cases": []})["status"] == "testing"
    wrong = {**drafts[0], "field_candidates": {"user": "ana", "absent": "x"}}
    assert generation.brought_to_approval(rest, wrong)["status"] == "shadow"
    for bad in (None, {"parser_type": "x"}, {"parser_type": "json", "field_candidates": {}}, {"parser_type": "regex", "field_candidates": {"a": 1}, "field_extractors": {"pattern": "("}}, {"parser_type": "regex", "field_candidates": {"a": 1}}, {"parser_type": "json", "field_candidates": {"a": 1}, "event_defaults": {"user.name": 1}}, {"parser_type": "json", "field_candidates": {"a": 1}, "action_source_field": "b"}):
        with pytest.raises(generation.ProposalError):
            generation.validated(bad)
    assert generation.validated({"parser_type": "json", "field_candidates": {"a": 1}, "schema_mapping": {"a": "svn.op"}})["schema_mapping"] == {"a": "extensions.svn.op"}


def test_investigation_says_what_is_missing(spark):
    alerts = spark.createDataFrame([("a1", "i1", "ana", 90, "high", 1, 2), ("a2", "i2", "bo", 85, "high", 1, 2)], "alert_key string, incident_key string, user_name string, risk_score int, severity string, first_seen long, last_seen long")
    made = cases.sync(cases.empty(spark), alerts, 0)
    assessed = spark.createDataFrame([("i1", 90, "x")], "incident_key string, risk_score int, raw_text string")
    incidents = spark.createDataFrame([("i1", 3)], "incident_key string, candidate_count long")
    members = spark.createDataFrame([("c2", "i1", 5, 6, 70), ("c1", "i1", 5, 6, 80), ("c9", "other", 5, 6, 80)], "candidate_key string, incident_key string, window_start long, window_end long, score int")
    members = members.withColumns({c: F.lit("x") for c in ("detector_id", "severity", "metric", "value_type", "value_key")})
    evidence = spark.createDataFrame([("c1", 4, ["e"])], "candidate_key string, event_count long, evidence array<string>")
    rows = {r.user_name: r for r in investigation.investigations(made, alerts, assessed, incidents, members, evidence).collect()}
    ana, bo = rows["ana"], rows["bo"]
    assert [c.candidate_key for c in ana.candidates] == ["c1", "c2"] and ana.candidates[0].event_count == 4
    assert (ana.risk_status, ana.incident_status, ana.detection_status) == ("available", "available", "partial:1_missing") and "raw_text" not in ana.assessment.asDict()
    assert (bo.risk_status, bo.incident_status, bo.detection_status, bo.candidates) == ("assessment_not_found", "not_found", "not_resolvable", None)


def test_next_actions(spark):
    schema = "scope string, group_id string, window_size int, configured_members long, statistical_ready boolean, model_ready boolean, missing_model_samples long"
    rows = spark.createDataFrame([("global", "", 3600, None, True, True, 0), ("global", "", 86_400, None, True, False, 40), ("peer_group", "g", 3600, 2, False, False, 100)], schema)
    past = lambda missing: spark.createDataFrame([(missing, missing == 0)], "missing_days long, ready boolean")
    assert [(r.priority, r.kind, r.window_size, r.subject, r.amount) for r in next_actions(rows, past(3)).collect()] == [(1, "collect_history", None, "", 3), (2, "collect_windows", 86_400, "", 40), (3, "expand_peer_groups", None, "g", 3)]
    able = rows.where("window_size = 3600 AND scope = 'global'")
    assert [r.kind for r in next_actions(able, past(0)).collect()] == ["run_benchmark"]
    assert DAY_MS == 86_400_000
