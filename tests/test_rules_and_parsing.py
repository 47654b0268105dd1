import bz2
import gzip
import ipaddress
import json
import lzma
import random
import re
import zipfile

import pytest
from pyspark.sql import functions as F

from vigil.functions import parsing, text
from vigil.operators import cases, rules
from vigil.plans import preview
from vigil.sources import config, files
from vigil.sources.state import StateError, StateTable, in_step

CASES = [
    ("eq", "a", "a", True), ("eq", "a", None, False), ("neq", "a", "b", True), ("neq", "a", None, True), ("in", ["a", "b"], "b", True), ("in", ["a"], None, False), ("not_in", ["a"], None, True), ("not_in", ["a"], "a", False),
    ("exists", True, None, False), ("exists", False, None, True), ("contains", "B", "abc", False), ("starts_with", "ab", "abc", True), ("ends_with", "bc", "abc", True), ("cidr_contains", "10.1.2.3/16", "10.1.9.9", True),
    ("cidr_contains", "10.1.0.0/16", "10.2.0.1", False), ("cidr_contains", "10.1.0.0/16", "10.1.0.999", False), ("cidr_contains", "10.1.0.0/16", None, False), ("cidr_contains", "fd00::/8", "fd12::1", True), ("cidr_contains", "fd00::/8", "10.1.0.1", False),
]


@pytest.mark.parametrize(("operator", "value", "field", "expected"), CASES)
def test_conditions(spark, operator, value, field, expected):
    rows = spark.createDataFrame([(field,)], "f string")
    assert rows.select(rules.condition(F.col("f"), operator, value).alias("hit")).first().hit is expected


RULE = {
    "rule_id": "r", "version": 1, "name": "n", "scope": "event", "status": "draft", "score": 50, "match": "all", "source_types": ["sso"], "conditions": [{"field": "http.response.status_code", "operator": "gte", "value": 400}],
    "tests": [
        {"name": "yes", "input": {"http.response.status_code": 404, "raw.source_type": "sso"}, "expected_match": True}, {"name": "null", "input": {"raw.source_type": "sso"}, "expected_match": False},
        {"name": "nested", "input": {"http": {"response": {"status_code": 500}}, "raw": {"source_type": "sso"}}, "expected_match": True}, {"name": "source", "input": {"http.response.status_code": 404, "raw.source_type": "svn"}, "expected_match": False},
    ],
}


def test_own_tests(spark):
    assert all(t["passed"] for t in rules.run_tests(spark, rules.validate_rule(RULE)))
    rules.validate_rule({**RULE, "status": "active"})
    window = {"rule_id": "w", "version": 1, "name": "n", "scope": "window", "window_size": 3600, "status": "active", "score": 1, "match": "any", "conditions": [{"field": "event_count", "operator": "gt", "value": 3}]}
    window["tests"] = [{"name": "a", "input": {"event_count": 4}, "expected_match": True}, {"name": "b", "input": {"event_count": 3}, "expected_match": False}]
    assert rules.validate_rule(window)["window_size"] == 3600
    with pytest.raises(rules.RuleError):
        rules.validate_rule({**window, "tests": window["tests"][:1]})
    with pytest.raises(rules.RuleError):
        rules.validate_rule({**window, "tests": [*window["tests"], {"name": "c", "input": {"event_count": 9}, "expected_match": False}]})


def condition(field, operator, *value):
    return {"conditions": [{"field": field, "operator": operator, **({"value": value[0]} if value else {})}]}


BAD = [
    {"rule_id": "a b"}, {"rule_id": "x" * 81}, {"version": 0}, {"version": True}, {"name": " "}, {"name": "n" * 121}, {"description": 5}, {"status": "retired"}, {"scope": "user"}, {"match": "none"}, {"score": 101}, {"score": 1.5},
    {"source_types": [""]}, {"tags": "x"}, {"conditions": []}, {"window_size": 3600}, {"scope": "window"}, {"colour": 1}, {"tests": {}}, {"tests": [{"name": "x"}]},
    condition("network.bytes", "gt", 1), condition("event_count", "gt", 1), condition("user.name", "gt", 1), condition("user.name", "eq", 1), condition("http.response.status_code", "eq", "1"), condition("user.name", "in", []),
    condition("user.name", "in", [1]), condition("user.name", "exists", 1), condition("user.name", "cidr_contains", "10.0.0.0/8"), condition("source.ip", "cidr_contains", "x"), condition("user.name", "matches", "x"), condition("user.name", "eq"),
    condition("http.response.status_code", "contains", "4"),
]


@pytest.mark.parametrize("change", BAD)
def test_rules_that_are_refused(change):
    with pytest.raises(rules.RuleError):
        rules.validate_rule({**RULE, **change})


def test_life_of_rules(spark):
    one = rules.add_version([], RULE)
    with pytest.raises(rules.RuleError):
        rules.add_version(one, RULE)
    two = rules.add_version(one, {**RULE, "version": 2})
    for path in (["shadow", "active", "disabled", "active", "deprecated"], ["disabled", "shadow"], ["shadow", "deprecated"], ["deprecated"]):
        made = two
        for status in path:
            made = rules.set_status(made, "r", 1, status)
        assert made[0]["status"] == path[-1]
    with pytest.raises(rules.RuleError):
        rules.set_status(two, "r", 1, "active")
    with pytest.raises(rules.RuleError):
        rules.set_status(rules.set_status(two, "r", 1, "deprecated"), "r", 1, "draft")
    both = rules.set_status(rules.set_status(two, "r", 1, "shadow"), "r", 2, "shadow")
    assert [r["status"] for r in both] == ["disabled", "shadow"]


SVN = '10.0.0.9 - ana [01/Jan/2026:10:00:00 +0800] "PROPFIND /svn/core HTTP/1.1" 207 512 "SVN/1.14" get-file /trunk/a.c r42'
SSO = json.dumps({"shortName": "ana", "eventType": "authenticateSuccess", "ctime": "2026-01-01 10:00:00", "status": "0", "userIp": "10.0.0.1", "casServer": "10.0.0.2", "appUrl": "https://portal"})
GITLAB = json.dumps({"time": "2026-01-01T10:00:00Z", "username": "bo", "user_id": 7, "remote_ip": "10.0.0.3, 10.0.0.4", "host": "git", "method": "GET", "path": "/api/v4/projects/1", "route": "/projects/:id", "status": 200, "ua": "curl"})
HIKLINK = '{\n  uid: "cy",\n  path: "loginByPasswd",\n  createTime: "2026-01-01 10:00:00",\n  attribute2: "10.0.0.5",\n  attribute3: "SUCCESS",\n  device: "phone",\n}'


def records(spark, rows):
    framed = spark.createDataFrame([(f"f{i}", i + 1, i + 1, 1, t) for i, t in enumerate(rows)], "path string, line_start int, line_end int, record_index int, raw_text string")
    return files.raw_records(framed, "main", "auto")


def test_parsers(spark):
    good, unknown = parsing.routed(records(spark, [SVN, SSO, GITLAB, HIKLINK, "level=INFO user=alice bytes=123", '{"a": 1}', "[1, 2]"]))
    got = {e.raw.source_type: e for e in good.collect()}
    assert set(got) == {"svn", "sso", "gitlab", "hiklink"}
    assert (got["svn"].event.time, got["svn"].event.action, got["svn"].user.name, got["svn"].http.bytes, got["svn"].resource.name) == ("2026-01-01T10:00:00+08:00", "repo_read", "ana", 512, "/trunk/a.c")
    assert (got["sso"].event.action, got["sso"].event.outcome, got["sso"].destination.ip) == ("user_login", "success", "10.0.0.2")
    assert (got["gitlab"].event.action, got["gitlab"].source.ip, got["gitlab"].user.id) == ("repo_api_read", "10.0.0.3", "7")
    assert (got["hiklink"].event.type, got["hiklink"].user.name, got["hiklink"].parser.confidence) == ("login", "cy", 0.86)
    assert {(u.detected_format, u.reason) for u in unknown.collect()} == {("key_value", "no_parser"), ("json", "no_parser"), ("text", "no_parser")}


def test_what_fails_is_routed(spark):
    bad = records(spark, [SSO.replace("10.0.0.1", "no address"), SVN.replace("Jan", "Foo")]).withColumn("source_type", F.when(F.startswith("raw_text", F.lit("{")), "sso").otherwise("svn"))
    good, unknown = parsing.routed(bad)
    assert good.count() == 0
    assert {(u.reason, tuple(u.schema_errors)) for u in unknown.collect()} == {("schema_validation_failed", ("source.ip must be a valid IP address",)), ("parse_error:svn", ())}


def test_text_functions(spark):
    rows = [None, " ", "{}", "{a", "x y=1", SVN, "plain", "{} junk"]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, t string").select("i", text.detect_format(F.col("t")).alias("f")).orderBy("i").collect()
    assert [r.f for r in got] == ["empty", "empty", "json", "json_like", "key_value", "apache_access", "text", "json_like"]
    one = spark.createDataFrame([(" from 10.0.0.1 id 123 k=v n=7 ", "a=1 b=2 a=3", "user=x api_key = abc; Token=1")], "a string, b string, c string")
    r = one.select(text.template_hint(F.col("a")).alias("a"), text.key_values(F.col("b")).alias("b"), text.redact(F.col("c")).alias("c")).first()
    assert (r.a, r.b, r.c) == ("from <IP> id <NUM> k=<VAR> n=<VAR>", {"a": "3", "b": "2"}, "user=x api_key=<REDACTED>; Token=<REDACTED>")


ADDRESSES = ["::", "::1", "1::", "fe80::1%eth0", "::ffff:1.2.3.4", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:1.2.3.4", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "2001:db8::1:0:0:1", "10.0.0.1", "255.255.255.255", "::1.2.3.4", "a::b:1.2.3.4",
             "::::::", "1:2:3:4:5:6:7", "1:2:3:4:5:6:7:8:9", "1::2::3", ":1", "1:", "12345::", "g::", "1.2.3", "256.1.1.1", "01.2.3.4", "1.2.3.4.5", "::1.2.3.256", "1:2:3:4:5:6:7:1.2.3.4", "", "x", "1::2:3:4:5:6:7:8", "fe80::1%"]


def test_addresses():
    r = random.Random(1)
    some = ADDRESSES + ["".join(r.choice(["::", ":", "1", "ab", "0", "1.2.3.4", "ffff"]) for _ in range(r.randint(1, 12))) for _ in range(4000)]

    def is_one(x):
        try:
            ipaddress.ip_address(x)
            return True
        except ValueError:
            return False

    assert [x for x in some if bool(re.match(parsing.ADDRESS, x)) != is_one(x)] == []


def test_redaction_of_objects(spark):
    rows = ['{"user": "a", "Token": 1, "deep": {"x_password": {"a": 1}, "k": [{"secret": 2}]}}', "[1]", "token=5 a", "3", None, '{"a": 1} x token=7']
    got = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, t string").select("i", text.redact_any(F.col("t")).alias("t")).orderBy("i").collect()
    assert [r.t for r in got] == ['{"Token": "<REDACTED>", "deep": {"k": [{"secret": 2}], "x_password": "<REDACTED>"}, "user": "a"}', "[1]", "token=<REDACTED> a", "3", None, '{"a": 1} x token=<REDACTED>']


def test_large_files_are_read_in_splits(spark, tmp_path):
    """Lines are numbered the same however the file is cut."""
    rows = [f"line {i} {'x' * (i % 50)}" if i % 9 else "" for i in range(5000)]
    (tmp_path / "a.log").write_text("\n".join(rows) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        lines = files.read_lines(spark, [str(tmp_path / "a.log")])
        got = sorted((r.line, r.text) for r in lines.collect())
        index = sorted((r.line_start, r.record_index) for r in files.line_records(lines).collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == [(i + 1, t) for i, t in enumerate(rows)]
    kept = [i + 1 for i, t in enumerate(rows) if t]
    assert index == [(line, n + 1) for n, line in enumerate(kept)]


def test_sources_and_stores(spark, tmp_path):
    (tmp_path / "b.log").write_text("one\n\ntwo\n")
    (tmp_path / "a.log").write_text("three\n")
    sources = [{"source_id": "s", "source_type": "auto", "paths": [str(tmp_path / "*.log")], "product": "p"}, {"source_id": "o", "source_type": "sso", "record_mode": "object", "paths": [str(tmp_path / "none*")]}]
    assert [(f["unit_id"], f["path"].rpartition("/")[2]) for f in files.source_files(spark, sources)] == [("local:0:0:0", "a.log"), ("local:0:0:1", "b.log")]
    rows = files.source_records(spark, sources)
    assert sorted((r.file_path.rpartition("/")[2], r.line_start, r.record_index, r.raw_text, r.product, r.include_raw_text) for r in rows.collect()) == [("a.log", 1, 1, "three", "p", True), ("b.log", 1, 1, "one", "p", True), ("b.log", 3, 2, "two", "p", True)]
    files.write_raw_store(rows, str(tmp_path / "store"))
    assert sorted(files.read_raw_store(spark, str(tmp_path / "store")).collect()) == sorted(rows.collect())
    (tmp_path / "few.json").write_text('{"record_id": "r", "source_id": "s", "source_type": "x", "raw_text": "t", "checksum": "c", "size_bytes": 1, "storage_ref": "f"}\n\n')
    (r,) = files.read_raw_store(spark, str(tmp_path / "few.json")).collect()
    assert (r.file_path, r.line_start, r.include_raw_text, r.llm_enabled, r.kafka_offset) == ("", 0, True, False, None)
    with pytest.raises(files.SourceError):
        files.write_raw_store(spark.range(1), str(tmp_path / "bad"))


def test_peer_groups(spark, tmp_path):
    def read(body):
        (tmp_path / "p.csv").write_text(body)
        return sorted(tuple(r) for r in files.read_peer_groups(spark, str(tmp_path / "p.csv")).collect())

    assert read('user_name,group_id\nana,g1\n"b,o",g2\n') == [("ana", "g1"), ("b,o", "g2")]
    for bad in ("name,group\na,b\n", "user_name,group_id\nana,g\nana,h\n", "user_name,group_id\nana,\n", "user_name,group_id\n,g\n", ""):
        with pytest.raises(files.SourceError):
            read(bad)


def test_settings(tmp_path):
    path = tmp_path / "s.yaml"
    path.write_text("""# a comment
raw:
  include_text_in_event: true
sources:
  - source_id: one
    source_type: svn
    paths:
      - data/*.log
      - 'more: x/*.gz'
  - source_id: two
    include_raw_text: false
    paths:
    - b
fusion:
  alert_threshold: 70
  detector_family_bonus: 4
detection:
  p95_score: 61
  rare_share_threshold: 0.5
  source_type:
    svn:
      rare_event_count_max: 9
kafka:
  topics:
    - t1
  group_id: g
llm:
  timeout_seconds: 30
  model: m
""")
    one, two = config.sources(path)
    assert one == {"include_raw_text": True, "source_id": "one", "source_type": "svn", "paths": ["data/*.log", "more: x/*.gz"]} and two["include_raw_text"] is False and two["paths"] == ["b"]
    made = config.fusion(path)
    assert (made["alert_threshold"], made["family_bonus"], made["critical_threshold"]) == (70, 4, 90)
    defaults, overrides = config.detection(path)
    assert (defaults["p95_score"], defaults["rare_share_threshold"], defaults["p99_score"]) == (61, 0.5, 80) and overrides == {"svn": {"rare_event_count_max": 9}}
    assert config.kafka(path) == {"topics": ["t1"], "group_id": "g"} and config.provider(path) == {"timeout_seconds": 30, "model": "m"}
    path.write_text("fusion:\n  alert_threshold: high\n")
    with pytest.raises(config.ConfigError):
        config.fusion(path)
    good = config.validated_source({"source_id": "a.b", "path": "x/*.log"})
    assert good["paths"] == ["x/*.log"] and config.validated_source({"kind": "kafka", "source_id": "k", "bootstrap_servers": "h:1", "topics": "a, b", "group_id": "g"})["topics"] == ["a", "b"]
    for bad in ({"source_id": "a b", "path": "x"}, {"source_id": "a"}, {"source_id": "a", "path": "x", "source_type": "edr"}, {"kind": "ftp", "source_id": "a"}, {"kind": "kafka", "source_id": "a", "bootstrap_servers": "h"}, {"source_id": "a", "path": "x", "record_mode": "page"}):
        with pytest.raises(config.ConfigError):
            config.validated_source(bad)


def test_preview(spark):
    (r,) = preview.preview(spark, {"kind": "local", "source_id": "s", "source_type": "auto"}, "\n" + SVN + "\nmore").collect()
    assert r.ok and (r.detected_source_type, r.parser_id, r.field_coverage) == ("svn", "svn_apache_access", 1.0)
    (r,) = preview.preview(spark, {"kind": "local", "source_id": "s", "source_type": "auto"}, "what is this").collect()
    assert not r.ok and (r.parser_id, r.reason, r.field_coverage) == ("unknown", "no_parser", 0.0)


def test_framing(spark, tmp_path):
    body = '\n{\n "a": {\n  "b": 1\n }\n},\n\n{"c": 2}\n{"tail":\n'
    makers = {"t.log": lambda b: b, "t.log.gz": gzip.compress, "t.log.bz2": bz2.compress, "t.log.xz": lzma.compress}
    for name, pack in makers.items():
        (tmp_path / name).write_bytes(pack(body.encode()))
    with zipfile.ZipFile(tmp_path / "t.zip", "w") as z:
        z.writestr("b.log", "other")
        z.writestr("a.log", body)
    lines = files.read_lines(spark, [str(tmp_path)])
    for path in [*makers, "t.zip"]:
        own = lines.where(F.endswith("path", F.lit("/" + path)))
        got = files.object_records(own).orderBy("record_index").collect()
        assert [(r.line_start, r.raw_text) for r in got if r.raw_text.strip()][-1] == (8 if got[-1].line_start == 8 else got[-1].line_start, '{"c": 2}')
        assert '{\n "a": {\n  "b": 1\n }\n}' in [r.raw_text for r in got]
        assert [(r.line_start, r.record_index) for r in files.line_records(own).orderBy("line_start").collect()] == [(2, 1), (3, 2), (4, 3), (5, 4), (6, 5), (8, 6), (9, 7)]


def test_cases(spark):
    alert = lambda key, risk, incident: (key, "ana", risk, "high", 1, 2, incident)
    schema = "alert_key string, user_name string, risk_score int, severity string, first_seen bigint, last_seen bigint, incident_key string"
    raised = spark.createDataFrame([alert("k", 80, "i1"), alert("k", 90, "i2")], schema)
    one = cases.sync(cases.empty(spark), raised, 0)
    (c,) = one.collect()
    assert (c.status, c.risk_score, c.current_incident_key, c.requires_review) == ("new", 90, "i2", False)
    assert cases.sync(one, raised, 0).collect() == [c] and cases.sync_log(one, raised, 0).isEmpty()
    assert [(r.kind, r.actor) for r in cases.sync_log(cases.empty(spark), raised, 0).collect()] == [("created", "system")]
    log = cases.transition(one, c.case_id, "resolved", "bo", now_ms=5).union(cases.assign(one, c.case_id, " cy ", "bo", now_ms=6)).union(cases.set_tags(one, c.case_id, ["b", "a", "b "], "bo", now_ms=7)).union(cases.comment(one, c.case_id, "bo", "seen", now_ms=8))
    done = cases.folded(one, log)
    (d,) = done.collect()
    assert (d.status, d.owner, list(d.tags)) == ("resolved", "cy", ["a", "b"])
    news = spark.createDataFrame([alert("k", 95, "i3")], schema)
    (e,) = cases.sync(done, news, 10).collect()
    assert e.requires_review and e.status == "resolved"
    assert [r.kind for r in cases.sync_log(done, news, 10).collect()] == ["risk_alert_refreshed"]
    again = cases.folded(cases.sync(done, news, 10), cases.transition(done, c.case_id, "acknowledged", "bo", now_ms=11).union(cases.assign(done, c.case_id, " ", "bo", now_ms=12)))
    (f,) = again.collect()
    assert (f.status, f.owner, f.requires_review) == ("acknowledged", None, False)
    held = cases.folded(one, cases.transition(one, c.case_id, "suppressed", "bo", until_ms=100, now_ms=5))
    assert cases.suppressions(held).collect()[0].suppression_until == 100
    back = cases.sync(held, raised.limit(0), 100).first()
    assert (back.status, back.suppression_until) == ("new", None) and cases.sync_log(held, raised.limit(0), 100).first().kind == "suppression_expired"
    refused = [
        lambda: cases.transition(one, c.case_id, "open", "bo"), lambda: cases.transition(one, c.case_id, "suppressed", "bo"), lambda: cases.transition(one, c.case_id, "suppressed", "bo", until_ms=5, now_ms=5),
        lambda: cases.transition(one, c.case_id, "resolved", "bo", until_ms=9), lambda: cases.transition(one, c.case_id, "resolved", " "), lambda: cases.transition(one, "none", "resolved", "bo"), lambda: cases.comment(one, c.case_id, "bo", " "),
        lambda: cases.set_tags(one, c.case_id, [" "], "bo"), lambda: cases.search(one, status="open"), lambda: cases.search(one, severity="worst"), lambda: cases.search(one, page=0), lambda: cases.search(one, page_size=201),
    ]
    for call in refused:
        with pytest.raises(cases.CaseError):
            call()


def test_case_search(spark):
    rows = [(f"c{i}", f"k{i}", f"us_er{i % 3}%", "new" if i % 2 else "resolved", None if i % 4 else "bo", [], i, "high" if i > 5 else "low", 0, i % 5, None, i == 3, "i") for i in range(12)]
    made = spark.createDataFrame(rows, cases.CASE)
    ids = lambda **f: [r.case_id for r in cases.search(made, **f).collect()]
    assert ids()[:2] == ["c3", "c11"] and ids(page=2, page_size=5) == ids()[5:10]
    assert set(ids(user_name="S_ER1%")) == {"c1", "c4", "c7", "c10"} and ids(user_name="s%") == []
    assert set(ids(status="resolved", severity="high")) == {"c6", "c8", "c10"} and set(ids(owner="bo")) == {"c0", "c4", "c8"} and len(ids(owner=cases.UNASSIGNED)) == 9 and ids(requires_review=True) == ["c3"]
    r = cases.counts(made).first()
    assert (r.new, r.resolved, r.total, r.unassigned, r.requires_review) == (6, 6, 12, 9, 1)


def test_state_table(spark, tmp_path):
    folder = str(tmp_path / "s")
    table = StateTable(spark, folder, 1, {"a": 1})
    assert table.current() == (0, None)
    assert table.commit(spark.range(3)) == 1 and table.commit(spark.range(5), {"at": 7}) == 2
    rev, df = StateTable(spark, folder, 1, {"a": 1}).current()
    assert rev == 2 and df.count() == 5 and table.notes() == {"at": 7}
    assert table.append(spark.range(5, 7)) == 3 and table.current()[1].count() == 7 and table.notes() == {"at": 7}
    assert table.note({"at": 8}) == 4 and table.notes() == {"at": 8} and table.current()[1].count() == 7
    for _ in range(3):
        table.append(spark.range(1), most_parts=3)
    assert len(table.manifest()["parts"]) <= 3 and table.current()[1].count() == 10
    with pytest.raises(StateError):
        StateTable(spark, folder, 1, {"a": 2}).current()
    rev = table.manifest()["rev"]
    (tmp_path / "s/manifests" / f"{rev + 1:012d}.json").write_text('{"rev":')  # a writer that was lost
    assert table.manifest()["rev"] == rev and table.current()[1].count() == 10
    assert table.append(spark.range(2)) == rev + 2 and table.current()[1].count() == 12  # the table is not locked
    (tmp_path / "s/manifests" / f"{rev + 3:012d}.json").write_text("")
    assert table.note({"at": 9}) == rev + 4 and table.notes() == {"at": 9}


def test_state_table_of_two_writers(spark, tmp_path, monkeypatch):
    """Of writers that pass one another over, none reports what the other hides."""
    table = StateTable(spark, str(tmp_path / "s"), 1, {})
    table.commit(spark.range(1))
    manifests, read = tmp_path / "s/manifests", StateTable._read
    with monkeypatch.context() as m:  # the other takes the next number first
        m.setattr(StateTable, "_numbers", lambda self: [1])
        (manifests / f"{2:012d}.json").write_text("")
        with pytest.raises(StateError):
            table.note({"at": 1})
    held = table.manifest()
    (manifests / f"{2:012d}.json").write_text(json.dumps({**held, "rev": 2, "notes": {"at": 2}}))  # and is done meanwhile
    with monkeypatch.context() as m:
        m.setattr(StateTable, "manifest", lambda self: held)
        with pytest.raises(StateError):
            table.note({"at": 3})
    assert table.notes() == {"at": 2}

    def passed(self, rev):
        (manifests / f"{9:012d}.json").write_text("")
        return read(self, rev)

    with monkeypatch.context() as m:
        m.setattr(StateTable, "_read", passed)
        numbers = iter([[3, 2, 1], [3, 2, 1], [4, 3, 2, 1], [9, 4, 3]])
        m.setattr(StateTable, "_numbers", lambda self: next(numbers))
        with pytest.raises(StateError):
            table.note({"at": 4})


def test_stages_are_in_step():
    in_step("detection", 3, 3)
    with pytest.raises(StateError):
        in_step("detection", 2, 3)
