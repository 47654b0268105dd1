import pytest
from pyspark.sql import functions as F

from vigil.functions import parsing, registry
from vigil.sources import files

KV = {"parser_id": "kv", "parser_type": "key_value", "status": "active", "priority": 10, "field_candidates": {"user": "", "action": ""}, "schema_mapping": {"user": "user.name", "bytes": "network.bytes"}}
RX = {"parser_id": "rx", "parser_type": "regex", "status": "active", "priority": 10, "field_extractors": {"pattern": r"user=(?P<user>\w+).*action=(?P<action>\w+)"}, "field_candidates": {"user": ""}, "schema_mapping": {"user": "user.name"}, "success_rate": 0.9}
JS = {"parser_id": "js", "parser_type": "json", "status": "active", "field_extractors": {"who": "who.name", "n": "n"}, "field_candidates": {"who": ""}, "schema_mapping": {"who": "user.name"}}


def rows(spark):
    texts = ["user=ana action=read bytes=12 user=bo", '{"who": {"name": "cy"}, "n": 3}', '{"n": 3}', None, "user=ana", "{broken"]
    return spark.createDataFrame([(i + 1, "s", "x", t) for i, t in enumerate(texts)], "i int, source_id string, source_type string, raw_text string")


def test_selection(spark):
    got = {r.i: r.parser for r in registry.select_parser(rows(spark), [KV, RX, JS, {**KV, "parser_id": "off", "priority": 1, "status": "deprecated"}]).collect()}
    assert [got[i] and got[i].id for i in range(1, 7)] == ["rx", "js", None, None, None, None]
    assert (got[1].conflict.candidate_count, got[1].conflict.competing_parser_ids, got[1].conflict.resolution) == (2, ["kv"], "success_rate")
    assert got[2].conflict is None and got[2].fields == {"who": "cy", "n": "3"} and got[2].values["user.name"] == "cy"
    alone = {r.i: r.parser for r in registry.select_parser(rows(spark), [KV]).collect()}
    assert alone[1].values["user.name"] == "bo" and alone[1].values["network.bytes"] == "12" and alone[5] is None
    assert registry.select_parser(rows(spark), []).where("parser IS NULL").count() == 6
    why = lambda *parsers: registry.select_parser(rows(spark).where("i = 1"), [*parsers]).first().parser.conflict.resolution
    assert why(KV, {**RX, "priority": 5}) == "priority" and why(KV, {**RX, "success_rate": 0}) == "parser_id" and why(KV, {**RX, "success_rate": 0, "schema_mapping_rate": 1}) == "schema_mapping_rate"


def test_source_contract(spark):
    print_ = spark.range(1).select(registry.format_fingerprint(*map(F.lit, ("s", "x", "key_value", "", ""))).alias("f")).first().f
    own = {**KV, "enforce_source_contract": True, "source_contract": {"source_id": "s", "source_type": "x", "format_fingerprint": print_}}
    assert registry.select_parser(rows(spark), [own]).where("parser IS NOT NULL").count() == 1
    for change in ({"source_id": "t"}, {"source_type": "y"}, {"format_fingerprint": "fmt_0"}, {"product": "p"}):
        assert registry.select_parser(rows(spark), [{**own, "source_contract": {**own["source_contract"], **change}}]).where("parser IS NOT NULL").isEmpty()


def test_extraction(spark):
    one = spark.createDataFrame([('{"a": 1, "b": {"c": null, "d": [1]}, "e": "x"}', "k=1 j=2 k=3")], "j string, t string")
    r = one.select(
        registry.extract(F.col("j"), {"parser_type": "json"}).alias("whole"), registry.extract(F.col("j"), {"parser_type": "json", "field_extractors": {"p": "b.d", "q": "b.c", "r": "e"}}).alias("paths"),
        registry.extract(F.col("t"), {"parser_type": "json"}).alias("none"), registry.extract(F.col("t"), {"parser_type": "regex", "field_extractors": {"pattern": r"k=(?P<k>\d)(?P<z>z)?"}}).alias("groups"),
        registry.extract(F.col("j"), {"parser_type": "regex", "field_extractors": {"pattern": "k=(?P<k>z)"}}).alias("nothing"), registry.extract(F.col("t"), {"parser_type": "key_value"}).alias("pairs"),
    ).first()
    assert r.whole == {"a": "1", "b": '{"c":null,"d":[1]}', "e": "x"} and r.paths == {"p": "[1]", "r": "x"} and r.none is None
    assert r.groups == {"k": "1", "z": None} and r.nothing == {} and r.pairs == {"j": "2", "k": "3"}
    for bad in ({"parser_type": "regex"}, {"parser_type": "xml"}):
        with pytest.raises(registry.RegistryError):
            registry.extract(F.col("t"), bad)


def test_events_of_active_parsers(spark):
    parser = {**KV, "success_rate": 1.0, "event_defaults": {"event.category": "network", "event.type": "api"}, "action_mapping": {"read": "file_read"}, "action_source_field": "action", "source_type": "app",
              "schema_mapping": {"user": "user.name", "action": "event.action", "code": "http.response.status_code", "when": "event.time", "node": "extensions.app.node"}}
    framed = spark.createDataFrame([("f", 1, 1, 1, "user=ana action=read code=404 when=2026-01-01T00:00:00Z node=n1"), ("f", 2, 2, 2, "user=bo action=drop code=x")], "path string, line_start int, line_end int, record_index int, raw_text string")
    good, unknown = parsing.routed(files.raw_records(framed, "main", "auto"), [parser])
    got = {e.user.name: e for e in good.collect()}
    a, b = got["ana"], got["bo"]
    assert (a.event.action, a.event.category, a.event.type, a.event.outcome, a.event.time, a.http.status_code) == ("file_read", "network", "api", "failure", "2026-01-01T00:00:00+00:00", 404)
    assert (a.parser.id, a.parser.confidence, a.parser.origin, a.raw.source_type) == ("kv", 0.9, "registry_active", "app") and a.extensions["app.node"] == "n1" and a.extensions["active_parser.user"] == "ana"
    assert (b.event.action, b.event.outcome, b.http.status_code) == ("drop", "unknown", None) and unknown.isEmpty()


def test_mapping_paths():
    assert registry.normalised({"a": "@timestamp", "b": "url.path", "c": "svn.op", "d": "extensions.svn.op", "e": "user.name", "f": 3}) == {"a": "event.time", "b": "http.url.path", "c": "extensions.svn.op", "d": "extensions.svn.op", "e": "user.name", "f": 3}
    assert registry.canonical_path("device.name") and not registry.canonical_path("svn.op") and not registry.canonical_path(None)


def test_life(spark):
    tests = spark.createDataFrame([("user=a action=b", {"user": "a"}), ("user=a action=b", {"user": "z", "none": "q"})], "raw_text string, expected map<string,string>")
    assert [(r.passed, sorted(r.wrong)) for r in registry.run_tests(tests, KV).collect()] == [(True, []), (False, ["none", "user"])]
    (draft,) = registry.registered([{"candidate_id": "c", "source": "llm", "samples": [{"raw_text": "user=a action=b"}], "suggested_parser": {"parser_type": "key_value", "field_candidates": {"user": "a", "action": "b"}, "schema_mapping": {"user": "user.name"}}}], [])
    assert registry.registered([{"candidate_id": "c"}], [draft]) == [draft] and (draft["status"], draft["approval_required"], draft["schema_mapping_rate"]) == ("draft", True, 0.5)

    def refused(parser, status):
        with pytest.raises(registry.RegistryError):
            registry.set_status(parser, status)

    for status in ("shadow", "active", "pending_approval"):
        refused(draft, status)
    testing = registry.set_status(draft, "testing")
    refused(testing, "shadow")
    ready = registry.tested(testing, tests)
    assert (ready["test_case_count"], ready["success_rate"]) == (1, 1.0)
    shadow = registry.set_status(ready, "shadow")
    refused(shadow, "blocked")
    passed = {**shadow, "shadow_replay_record_count": 3, "shadow_replay_success_rate": 1.0, "shadow_replay_schema_mapping_rate": 1.0}
    refused(passed, "active")  # it needs approval
    assert registry.set_status({**passed, "approval_required": False}, "active")["status"] == "active"
    refused({**shadow, "approval_required": False}, "active")
    active = registry.set_status(registry.set_status(passed, "pending_approval"), "active")
    assert registry.set_status(active, "deprecated")["status"] == "deprecated"
    refused(active, "testing")
    assert registry.set_status(draft, "blocked")["status"] == "blocked"
