"""Registered queries of sources, parsers, admission and versions, and their SQL.

Raw records are written from the events table in each system's own form; the SQL says what must come out from the same
events, without any parsing.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import oracle as o
from .functions import parsing, registry
from .functions import text as text_ops
from .operators import detection, features, fusion, quality, rules
from .operators import sessions as session_ops
from .queries import ALL, PRINTS, chain, full, query
from .sources import files
from .sources.state import settle, shared_dir
from .sources.tables import canonical_events, read, spread

TIME = "strftime(make_timestamp((t // 1000) * 1000000), '%Y-%m-%dT%H:%M:%S')"
#: The events with their numbers: i, k (of the resource) and a time to the second.
NUMBERED = """,
nv AS (SELECT *, CAST(substr(event_id, 5) AS BIGINT) AS i, CAST(substr(shown, 5) AS INT) AS k, substr(user_name, 6) AS u FROM ev)
"""


#: Events of a task that writes and parses their records.
ROWS_A_TASK = 100_000


def numbered(spark, sf_dir) -> DataFrame:
    """i, k, u, user_name, source_ip, bytes, iso, plain and log (its time in three forms) of every event."""
    rows = spread(read(spark, sf_dir, "events"), "event_id", rows_a_task=ROWS_A_TASK)
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("int")
    return rows.select(
        F.col("event_id").alias("i"), k.alias("k"), F.col("user_id").cast("string").alias("u"), F.concat(F.lit("user-"), "user_id").alias("user_name"), F.concat(F.lit("10.0."), F.pmod("user_id", F.lit(256)), F.lit("."), F.pmod(k, F.lit(4))).alias("source_ip"),
        F.floor(F.col("value") * 100).cast("long").alias("bytes"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("iso"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("plain"), F.date_format("ts", "dd/MMM/yyyy:HH:mm:ss").alias("log"),
    )


def text(*parts: str | Column) -> Column:
    """Columns joined to text; strings are themselves."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


c = F.col
def forms() -> dict[str, Column]:
    """Raw records of each system from the columns of numbered; mixed is one of six by number."""
    status = F.element_at(F.array(*map(F.lit, (200, 302, 404, 500))), (F.pmod("i", F.lit(4)) + 1).cast("int"))
    verb = F.element_at(F.array(*map(F.lit, ("get-file", "put", "status", "LOCK"))), (F.pmod("i", F.lit(4)) + 1).cast("int"))
    method = F.element_at(F.array(*map(F.lit, ("GET", "post", "DELETE"))), (F.pmod("i", F.lit(3)) + 1).cast("int"))
    svn = text(c("source_ip"), " - ", c("user_name"), " [", c("log"), ' +0200] "PROPFIND /svn/r', c("k"), ' HTTP/1.1" ', status, " ", c("bytes"), ' "cli/1"')
    svn = F.when(c("i") % 5 == 0, svn).otherwise(F.concat(svn, F.lit(" "), verb, F.lit(" /trunk/f"), c("k"), F.lit(" r"), c("i")))
    sso = F.to_json(F.struct(c("user_name").alias("shortName"), F.when(c("i") % 3 == 0, "authenticateSuccess").otherwise("ticket").alias("eventType"), c("plain").alias("ctime"), F.when(c("i") % 4 == 0, "1").otherwise("0").alias("status"), c("source_ip").alias("userIp"), F.lit("10.9.9.9").alias("casServer"), text("https://app/", c("k")).alias("appUrl")))
    gitlab = F.to_json(F.struct(text(c("iso"), "Z").alias("time"), c("user_name").alias("username"), c("u").cast("long").alias("user_id"), text(c("source_ip"), ", 10.8.8.8").alias("remote_ip"), F.lit("git").alias("host"), method.alias("method"), text(F.when(c("k") % 2 == 0, "/api/projects/").otherwise("/health/"), c("k")).alias("path"), F.lit("/r").alias("route"), status.alias("status"), F.lit("ua").alias("ua")))
    hiklink = text("{\n  uid: \"", c("user_name"), '",\n  path: "', F.when(c("i") % 3 == 0, "loginByPasswd").otherwise("openDoor"), '",\n  createTime: "', c("plain"), '",\n  attribute2: ', c("source_ip"), ",\n  attribute3: ", F.when(c("i") % 4 == 0, "FAIL").otherwise("SUCCESS"), ',\n  device: "d', c("k"), '",\n  action: phone,\n  platformName: "os",\n  platformVersion: null\n}')
    keys = text("level=INFO user=", c("user_name"), " status=", status, " bytes=", c("bytes"), " op=o", c("k"), " user=", c("user_name"), "x")
    other = text('{"a": ', c("i"), "}")
    #: One of six forms by number; every seventh of the first is broken.
    broken = F.when(c("i") % 7 == 0, F.regexp_replace(svn, r"/[A-Z][a-z]{2}/", "/Foo/")).otherwise(svn)
    mixed = F.when(F.pmod("i", F.lit(6)) == 0, broken)  # by branches, of which a row works out its own alone
    for n, one in enumerate((sso, gitlab, hiklink, keys, other), 1):
        mixed = mixed.when(F.pmod("i", F.lit(6)) == n, one)
    secrets = F.to_json(F.struct(c("user_name").alias("user"), F.struct(c("u").alias("api_key"), c("k").alias("n")).alias("inner"), F.lit("pw").alias("Password")))
    return {"svn": svn, "sso": sso, "gitlab": gitlab, "hiklink": hiklink, "keys": keys, "other": other, "mixed": mixed, "secrets": secrets}


IS = "i % 6"


def records(spark, sf_dir, form: str, source_type: str = "auto") -> DataFrame:
    """Raw records of a form for each event, with its number i."""
    framed = numbered(spark, sf_dir).select("i", F.lit("f").alias("path"), c("i").cast("int").alias("line_start"), c("i").cast("int").alias("line_end"), c("i").cast("int").alias("record_index"), forms()[form].alias("raw_text"))
    made = files.raw_records(framed, "main", source_type)
    return made.withColumn("i", c("line_start").cast("long"))


SVN_SQL = "source_ip || ' - ' || user_name || ' [' || strftime(make_timestamp((t // 1000) * 1000000), '%d/%b/%Y:%H:%M:%S') || ' +0200] \"PROPFIND /svn/r' || k || ' HTTP/1.1\" ' || [200, 302, 404, 500][i % 4 + 1] || ' ' || bytes || ' \"cli/1\"' || CASE WHEN i % 5 = 0 THEN '' ELSE ' ' || ['get-file', 'put', 'status', 'LOCK'][i % 4 + 1] || ' /trunk/f' || k || ' r' || i END"


@query(o.sql("SELECT i, ['svn', 'sso', 'gitlab', 'hiklink', 'unknown', 'unknown'][i % 6 + 1] AS source_type FROM nv", NUMBERED))
def p01_detect(spark, sf_dir):
    return numbered(spark, sf_dir).select("i", text_ops.detect_source(forms()["mixed"]).alias("source_type"))


@query(o.sql(f"""SELECT i, CASE WHEN {IS} = 0 AND i % 7 = 0 THEN 'parse_error:svn' WHEN {IS} > 3 THEN 'no_parser' END AS reason, CASE WHEN {IS} = 0 AND i % 7 = 0 THEN NULL ELSE ['svn_apache_access', 'sso_json', 'gitlab_jsonl', 'hiklink_json_like'][{IS} + 1] END AS parser_id,
  CASE WHEN {IS} = 0 AND i % 7 = 0 THEN NULL ELSE [0.95, 0.98, 0.98, 0.86][{IS} + 1]::DOUBLE END AS confidence FROM nv""", NUMBERED))
def p02_route(spark, sf_dir):
    return parsing.parse(records(spark, sf_dir, "mixed")).select("i", "reason", c("event.parser.id").alias("parser_id"), c("event.parser.confidence").alias("confidence"))


def _event(spark, sf_dir, form: str, kind: str, *paths: str) -> DataFrame:
    made = parsing.parse(records(spark, sf_dir, form, kind))
    return made.select("i", *[c(f"event.{p}").alias(p.replace(".", "_")) for p in paths])


@query(o.sql(f"""SELECT i, {TIME} || '+02:00' AS event_time, CASE WHEN i % 5 = 0 THEN 'repo_read' ELSE ['repo_read', 'repo_write', 'repo_status', 'repo_lock'][i % 4 + 1] END AS event_action, ['success', 'success', 'failure', 'failure'][i % 4 + 1] AS event_outcome, user_name AS user_name, source_ip AS source_ip,
  'PROPFIND' AS http_method, [200, 302, 404, 500][i % 4 + 1]::BIGINT AS http_status_code, bytes AS http_bytes, '/svn/r' || k AS http_path, CASE WHEN i % 5 = 0 THEN '/svn/r' || k ELSE '/trunk/f' || k END AS resource_name, 'cli/1' AS http_user_agent FROM nv""", NUMBERED))
def p03_svn(spark, sf_dir):
    return _event(spark, sf_dir, "svn", "svn", "event.time", "event.action", "event.outcome", "user.name", "source.ip", "http.method", "http.status_code", "http.bytes", "http.path", "resource.name", "http.user_agent")


@query(o.sql(f"""SELECT i, {TIME} AS event_time, CASE WHEN i % 3 = 0 THEN 'login' ELSE 'redirect' END AS event_type, CASE WHEN i % 3 = 0 THEN 'user_login' ELSE 'sso_redirect' END AS event_action, CASE WHEN i % 4 = 0 THEN 'failure' ELSE 'success' END AS event_outcome, user_name, source_ip, '10.9.9.9' AS destination_ip,
  'https://app/' || k AS resource_name FROM nv""", NUMBERED))
def p04_sso(spark, sf_dir):
    return _event(spark, sf_dir, "sso", "sso", "event.time", "event.type", "event.action", "event.outcome", "user.name", "source.ip", "destination.ip", "resource.name")


@query(o.sql(f"""SELECT i, {TIME} || 'Z' AS event_time, CASE WHEN i % 3 > 0 THEN 'repo_api_write' WHEN k % 2 = 0 THEN 'repo_api_read' ELSE 'repo_api_access' END AS event_action, ['success', 'success', 'failure', 'failure'][i % 4 + 1] AS event_outcome, user_name, u AS user_id, source_ip, 'git' AS host_name,
  [200, 302, 404, 500][i % 4 + 1]::BIGINT AS http_status_code, CASE WHEN k % 2 = 0 THEN '/api/projects/' ELSE '/health/' END || k AS http_path FROM nv""", NUMBERED))
def p05_gitlab(spark, sf_dir):
    return _event(spark, sf_dir, "gitlab", "gitlab", "event.time", "event.action", "event.outcome", "user.name", "user.id", "source.ip", "host.name", "http.status_code", "http.path")


@query(o.sql(f"""SELECT i, {TIME} AS event_time, CASE WHEN i % 3 = 0 THEN 'authentication' ELSE 'application' END AS event_category, CASE WHEN i % 3 = 0 THEN 'login' ELSE 'behavior' END AS event_type, CASE WHEN i % 3 = 0 THEN 'user_login' ELSE 'openDoor' END AS event_action, CASE WHEN i % 4 = 0 THEN 'failure' ELSE 'success' END AS event_outcome,
  user_name, source_ip, 'd' || k AS device_name, 'phone' AS device_type, 'os' AS device_os_name, NULL::VARCHAR AS device_os_version FROM nv""", NUMBERED))
def p06_hiklink(spark, sf_dir):
    return _event(spark, sf_dir, "hiklink", "hiklink", "event.time", "event.category", "event.type", "event.action", "event.outcome", "user.name", "source.ip", "device.name", "device.type", "device.os_name", "device.os_version")


def _shown(fields: Column) -> Column:
    """A map as sorted text."""
    return F.array_join(F.array_sort(F.transform(F.map_entries(fields), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("null"))))), ";")


RX = {"parser_id": "rx", "parser_type": "regex", "field_extractors": {"pattern": r"user=(?P<user>\S+) .*op=o(?P<op>[0-9]+)"}}
JS = {"parser_id": "js", "parser_type": "json", "field_extractors": {"who": "username", "code": "status", "none": "a.b"}}


@query(o.sql("""SELECT i, 'bytes=' || bytes || ';level=INFO;op=o' || k || ';status=' || [200, 302, 404, 500][i % 4 + 1] || ';user=' || user_name || 'x' AS pairs, 'op=' || k || ';user=' || user_name AS groups, 'code=' || [200, 302, 404, 500][i % 4 + 1] || ';who=' || user_name AS paths, 'a=' || i AS whole FROM nv""", NUMBERED))
def p09_extract(spark, sf_dir):
    f, of = forms(), lambda raw, parser: _shown(registry.extract(raw, parser))
    return numbered(spark, sf_dir).select("i", of(f["keys"], {"parser_type": "key_value"}).alias("pairs"), of(f["keys"], RX).alias("groups"), of(f["gitlab"], JS).alias("paths"), of(f["other"], {"parser_type": "json"}).alias("whole"))


ACTIVE = [
    {"parser_id": "pairs", "status": "active", "parser_type": "key_value", "priority": 20, "success_rate": 0.8, "field_candidates": {"user": "", "status": "", "bytes": ""}, "event_defaults": {"event.category": "network"},
     "schema_mapping": {"user": "user.name", "status": "http.response.status_code", "bytes": "network.bytes", "level": "extensions.app.level"}},
    {**RX, "status": "active", "priority": 20, "success_rate": 1.0, "field_candidates": {"op": "", "user": ""}, "schema_mapping": {"user": "user.name", "op": "event.action"}, "action_mapping": {"0": "zero", "1": "one"}},
    {"parser_id": "off", "status": "deprecated", "parser_type": "key_value", "priority": 1, "field_candidates": {"user": ""}, "schema_mapping": {}},
    {"parser_id": "object", "status": "active", "parser_type": "json", "priority": 5, "success_rate": 0.5, "field_candidates": {"a": 1}, "schema_mapping": {"a": "resource.id"}},
]


@query(o.sql(f"""SELECT i, CASE {IS} WHEN 4 THEN 'rx' WHEN 5 THEN 'object' END AS parser_id, CASE {IS} WHEN 4 THEN 2 END AS candidate_count, CASE {IS} WHEN 4 THEN 'pairs' END AS competing, CASE {IS} WHEN 4 THEN 'success_rate' END AS resolution FROM nv""", NUMBERED))
def p10_select(spark, sf_dir):
    rows = registry.select_parser(records(spark, sf_dir, "mixed"), ACTIVE)
    return rows.select("i", c("parser.id").alias("parser_id"), c("parser.conflict.candidate_count").alias("candidate_count"), F.array_join("parser.conflict.competing_parser_ids", ",").alias("competing"), c("parser.conflict.resolution").alias("resolution"))


@query(o.sql(f"""SELECT i, CASE {IS} WHEN 4 THEN 'rx' ELSE 'object' END AS parser_id, CASE {IS} WHEN 4 THEN 0.9 ELSE 0.5 END::DOUBLE AS confidence, 'application' AS category, CASE WHEN {IS} = 5 THEN 'unknown' WHEN k = 0 THEN 'zero' WHEN k = 1 THEN 'one' ELSE CAST(k AS VARCHAR) END AS action, 'unknown' AS outcome,
  CASE {IS} WHEN 4 THEN user_name END AS user_name, CASE {IS} WHEN 5 THEN CAST(i AS VARCHAR) END AS resource_id, 'registry_active' AS origin FROM nv WHERE {IS} > 3""", NUMBERED))
def p11_registry_event(spark, sf_dir):
    """Of all records, those that a registered parser took."""
    rows = settle(parsing.parse(records(spark, sf_dir, "mixed"), ACTIVE)).where("event.parser.origin = 'registry_active'")
    e = lambda path: c(f"event.{path}")
    return rows.select("i", e("parser.id").alias("parser_id"), e("parser.confidence").alias("confidence"), e("event.category").alias("category"), e("event.action").alias("action"), e("event.outcome").alias("outcome"), e("user.name").alias("user_name"), e("resource.id").alias("resource_id"), e("parser.origin").alias("origin"))


@query(o.sql("""SELECT i, [200, 302, 404, 500][i % 4 + 1]::BIGINT AS status, 'network' AS category, ['success', 'success', 'failure', 'failure'][i % 4 + 1] AS outcome, bytes AS bytes, 'INFO' AS level FROM nv""", NUMBERED))
def p11_defaults(spark, sf_dir):
    rows = parsing.parse(records(spark, sf_dir, "keys"), ACTIVE[:1])
    return rows.select("i", c("event.http.status_code").alias("status"), c("event.event.category").alias("category"), c("event.event.outcome").alias("outcome"), c("event.network.bytes").alias("bytes"), F.try_element_at("event.extensions", F.lit("app.level")).alias("level"))


@query(o.sql("""SELECT i, array_to_string(list_filter([CASE WHEN i % 5 = 0 THEN 'event.action is required' END, CASE WHEN i % 3 = 0 THEN 'event.outcome must be one of: failure, success, unknown' END, CASE WHEN i % 7 = 0 THEN 'event.time must be ISO-8601' END,
    CASE WHEN i % 4 = 0 THEN 'source.ip must be a valid IP address' END, CASE WHEN i % 11 = 0 THEN 'raw.checksum must match sha256:<64 hex chars>' END], lambda x: x IS NOT NULL), '; ') AS errors FROM nv""", NUMBERED))
def p12_errors(spark, sf_dir):
    made = parsing.parse(records(spark, sf_dir, "sso", "sso"))
    e = c("event")
    put = lambda event, group, field, holds, value: event.withField(group, event[group].withField(field, F.when(holds, F.lit(value)).otherwise(event[group][field])))
    e = put(e, "event", "action", c("i") % 5 == 0, "")
    e = put(e, "event", "outcome", c("i") % 3 == 0, "maybe")
    e = put(e, "event", "time", c("i") % 7 == 0, "yesterday")
    e = put(e, "source", "ip", c("i") % 4 == 0, "10.0.0.256")
    e = put(e, "raw", "checksum", c("i") % 11 == 0, "md5:0")
    return made.withColumn("event", e).select("i", F.array_join(parsing.validation_errors(), "; ").alias("errors"))


OUTCOME = f"CASE WHEN {IS} = 0 AND i % 7 = 0 THEN 'parse_error:svn' WHEN {IS} > 3 THEN 'no_parser' END"


@query(o.sql(f"""SELECT sha256(sha256('main:f:' || i || ':' || i || ':' || CASE {IS} WHEN 5 THEN '{{"a": ' || i || '}}' ELSE 'level=INFO user=' || user_name || ' status=' || [200, 302, 404, 500][i % 4 + 1] || ' bytes=' || bytes || ' op=o' || k || ' user=' || user_name || 'x' END) || ':no_parser') AS unknown_id,
  CASE {IS} WHEN 5 THEN 'json' ELSE 'key_value' END AS detected_format, 'unknown' AS suggested_source_type FROM nv WHERE {IS} > 3""", NUMBERED))
def p14_unknown(spark, sf_dir):
    unknown = parsing.routed(records(spark, sf_dir, "mixed"))[1]
    return unknown.where("reason = 'no_parser'").select("unknown_id", "detected_format", "suggested_source_type")


@query(o.sql(f"""SELECT coalesce({OUTCOME}, 'normalized') AS outcome, count(*) AS n FROM nv GROUP BY ALL""", NUMBERED))
def p13_outcomes(spark, sf_dir):
    good, unknown = parsing.routed(records(spark, sf_dir, "mixed"))
    return good.select(F.lit("normalized").alias("outcome")).unionByName(unknown.select(c("reason").alias("outcome"))).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))




@query(o.sql("""SELECT i, '{"Password": "<REDACTED>", "inner": {"api_key": "<REDACTED>", "n": ' || k || '}, "user": "' || user_name || '"}' AS object, 'user=' || user_name || ' token=<REDACTED>' AS pairs FROM nv""", NUMBERED))
def p21_redact_objects(spark, sf_dir):
    return numbered(spark, sf_dir).select("i", text_ops.redact_any(forms()["secrets"]).alias("object"), text_ops.redact_any(text("user=", c("user_name"), " token=", c("u"))).alias("pairs"))


@query(o.sql(f"""SELECT sha256('main:f:' || i || ':' || i || ':' || {SVN_SQL}) AS record_id, 'sha256:' || sha256({SVN_SQL}) AS checksum, CAST(strlen({SVN_SQL}) AS BIGINT) AS size_bytes, 'file://f#L' || i || '-L' || i AS storage_ref, true AS include_raw_text, false AS llm_enabled, NULL::VARCHAR AS product FROM nv""", NUMBERED))
def s08_raw_store(spark, sf_dir):
    """Raw records written as JSON lines and read again with what was left out."""
    path = f"{shared_dir(spark)}/raw-{uuid.uuid4().hex}"
    files.write_raw_store(records(spark, sf_dir, "svn"), path)
    return files.read_raw_store(spark, path).select("record_id", "checksum", "size_bytes", "storage_ref", "include_raw_text", "llm_enabled", "product")


@query(o.sql(f"""SELECT sha256('k:topic:' || i % 3 || ':' || i) AS record_id, {SVN_SQL} AS raw_text, 'kafka://topic/' || i % 3 || '/' || i AS storage_ref, i AS kafka_offset FROM nv""", NUMBERED))
def s11_kafka(spark, sf_dir):
    rows = numbered(spark, sf_dir).select(F.lit("topic").alias("topic"), (c("i") % 3).cast("int").alias("partition"), c("i").alias("offset"), F.lit(0).cast("timestamp").alias("timestamp"), forms()["svn"].cast("binary").alias("value"))
    return files.kafka_records(rows, "k", "svn").select("record_id", "raw_text", "storage_ref", "kafka_offset")


CANONICAL = "event struct<id:string,time:string,action:string,outcome:string>, user struct<name:string>, source struct<ip:string>, resource struct<type:string,id:string,name:string>, network struct<bytes:long>, raw struct<source_type:string,source_id:string>"


def _canonical(spark, sf_dir) -> DataFrame:
    """Nested events, some of which lack a user, a time or an action, or have a negative size."""
    some = lambda holds, value: F.when(holds, value)
    i = c("i")
    event = F.struct(text("e", i).alias("id"), F.when(i % 7 == 0, "soon").when(i % 5 == 0, text(c("iso"), "+02:00")).otherwise(text(c("iso"), ".25Z")).alias("time"), some(i % 11 > 0, F.lit("x")).alias("action"), F.lit("success").alias("outcome"))
    resource = F.struct(some(i % 2 == 0, F.lit("page")).alias("type"), some(i % 3 == 0, text("id", c("k"))).alias("id"), some(i % 5 > 0, text("name", c("k"))).alias("name"))
    size = F.when(i % 13 == 0, -c("bytes") - 1).otherwise(c("bytes"))
    return numbered(spark, sf_dir).select(event.alias("event"), F.struct(F.when(i % 17 == 0, "").otherwise(c("user_name")).alias("name")).alias("user"), F.struct(c("source_ip").alias("ip")).alias("source"), resource.alias("resource"), F.struct(size.alias("bytes")).alias("network"), F.struct(F.lit("app").alias("source_type"), F.lit("main").alias("source_id")).alias("raw"))


ADMIT = """SELECT 'e' || i AS event_id, CASE WHEN i % 7 = 0 THEN 'invalid_event_time' WHEN i % 17 = 0 THEN 'missing_user_name' WHEN i % 11 = 0 THEN 'missing_event_action' WHEN i % 13 = 0 THEN 'network.bytes must be a non-negative int64' END AS reason,
  CASE WHEN i % 7 = 0 THEN NULL WHEN i % 5 = 0 THEN (t // 1000) * 1000 - 7200000 ELSE (t // 1000) * 1000 + 250 END AS event_time_ms,
  CASE WHEN i % 2 = 0 OR i % 3 = 0 OR i % 5 > 0 THEN CASE WHEN i % 2 = 0 THEN 'page' ELSE '<unknown_type>' END || ':' || CASE WHEN i % 3 = 0 THEN 'id' || k WHEN i % 5 > 0 THEN 'name' || k ELSE '<unknown_resource>' END END AS resource_key FROM nv"""


@query(o.sql(ADMIT, NUMBERED))
def f15_admit(spark, sf_dir):
    return features.admit(_canonical(spark, sf_dir)).select("event_id", "reason", "event_time_ms", "resource_key")


@query(o.sql(ADMIT, NUMBERED))
def s13_canonical_lines(spark, sf_dir):
    """The same through JSON lines."""
    path = f"{shared_dir(spark)}/canonical-{uuid.uuid4().hex}"
    _canonical(spark, sf_dir).write.json(path)
    return features.admit(files.read_canonical(spark, path, CANONICAL)).select("event_id", "reason", "event_time_ms", "resource_key")


@query(o.sql("SELECT user_name, group_id FROM peers"))
def s15_peer_groups(spark, sf_dir):
    path = f"{shared_dir(spark)}/peers-{uuid.uuid4().hex}"
    chain(spark, sf_dir).peers.coalesce(1).write.csv(path, header=True)
    return files.read_peer_groups(spark, path)


#: The events that a first run knew: all but those of the last ten days and every 97th.
EARLY = "t < as_of - 864000000 AND CAST(substr(event_id, 5) AS BIGINT) % 97 > 0"
TWO_RUNS = f""",
early AS (SELECT ev.* FROM ev, newest WHERE {EARLY}),
d1 AS (SELECT user_name, t - t % 86400000 AS window_start, count(*) AS n, count(*) FILTER (action = 'repo_write') AS w, sum(bytes) AS b FROM early GROUP BY ALL),
d2 AS (SELECT user_name, t - t % 86400000 AS window_start, count(*) AS n, count(*) FILTER (action = 'repo_write') AS w, sum(bytes) AS b FROM ev GROUP BY ALL)
"""


def _two_runs(spark, sf_dir):
    """The events of a first run, and all."""
    events = settle(canonical_events(spark, sf_dir))
    newest = events.agg(F.max("event_time_ms")).first()[0] or 0
    return events.where((c("event_time_ms") < newest - 864_000_000) & (F.substring("event_id", 5, 20).cast("long") % 97 > 0)), events, newest


@query(o.sql("SELECT DISTINCT user_name FROM d2 LEFT JOIN d1 USING (user_name, window_start) WHERE d1.n IS NULL OR d1.n <> d2.n", TWO_RUNS))
def u01_changed_users(spark, sf_dir):
    """Users whose windows or values of a day changed between two runs; both runs' tables are stamped with revisions."""
    first, events, _ = _two_runs(spark, sf_dir)
    day = (86_400,)
    old, new = features.window_parts(first, day), settle(features.window_parts(events, day))
    rest = [*features.KEYS, "value_type", "value_key"]
    values = features.stamped(features.values_in(new), features.stamped(features.values_in(old), None, rest, 1), rest, 2)
    windows = features.stamped(features.windows_in(new, day), features.stamped(features.windows_in(old, day), None, features.KEYS, 1), features.KEYS, 2)
    return features.changed_users(windows, values, 1)


#: A rule over days, for both runs.
DAY_RULE = {"rule_id": "busy-day", "version": 1, "name": "busy day", "scope": "window", "window_size": 86400, "status": "active", "score": 70, "match": "any", "conditions": [{"field": "event_count", "operator": "gte", "value": 2}, {"field": "write_action_count", "operator": "gt", "value": 0}]}
DAY_PRINT = {"day_print": rules.fingerprint(DAY_RULE)}


@query(o.sql("""SELECT user_name, window_start, revision, status, supersedes IS NOT NULL AS supersedes FROM (
  SELECT user_name, window_start, 1 AS revision, CASE WHEN d2.n <> d1.n OR d2.b <> d1.b THEN 'superseded' ELSE 'active' END AS status, NULL AS supersedes FROM d1 JOIN d2 USING (user_name, window_start) WHERE d1.n >= 2 OR d1.w > 0
  UNION ALL SELECT user_name, window_start, 2, 'active', CASE WHEN d1.n >= 2 OR d1.w > 0 THEN 1 END FROM d2 LEFT JOIN d1 USING (user_name, window_start) WHERE (d2.n >= 2 OR d2.w > 0) AND (d1.n IS NULL OR d1.n <> d2.n OR d1.b <> d2.b))""", TWO_RUNS))
def d07_superseded(spark, sf_dir):
    """Candidates of a rule over days after a second run, which looks only at the windows that changed."""
    first, events, _ = _two_runs(spark, sf_dir)
    day, numbers = (86_400,), ["event_count", "network_bytes_total"]
    runs = []
    for e in (first, events):
        parts = settle(features.window_parts(e, day))
        runs.append((e, settle(features.windows_in(parts, day)), features.values_in(parts)))
    found = [detection.rule_candidates(e, w, v, [DAY_RULE]) for e, w, v in runs]
    old = runs[0][1].select(*features.KEYS, *numbers)
    stamped = features.stamped(runs[1][1].select(*features.KEYS, *numbers), features.stamped(old, None, features.KEYS, 1), features.KEYS, 2)
    touched = settle(stamped.where("updated_revision > 1"))
    again = found[1].join(touched.select(*features.KEYS), features.KEYS, "left_semi")
    rows = detection.superseded(settle(detection.first_versions(found[0], 1)), again, 2, touched)
    return rows.select("user_name", "window_start", c("revision").cast("int").alias("revision"), "status", c("supersedes").isNotNull().alias("supersedes"))


@query(o.sql("""SELECT user_name, detector_id, window_size, window_start, score, candidate_key FROM rulec""", o.METRICS, o.VALUES, o.SCOPED, o.CANDIDATES, o.RULED, **PRINTS))
def o01_report(spark, sf_dir):
    """A report of all candidates of rules; its order and top are tested on a fixture."""
    from .queries import EVENT_RULE, WINDOW_RULE

    return detection.reported(chain(spark, sf_dir, rules=[EVENT_RULE, WINDOW_RULE]).ruled).select("user_name", "detector_id", "window_size", "window_start", "score", "candidate_key")


@query(o.sql("""SELECT revision, status, policy_action, count(*) AS n, CAST(count(*) FILTER (replaces) AS BIGINT) AS replaces FROM (
  SELECT 1 AS revision, 'superseded' AS status, policy_action, false AS replaces FROM risk
  UNION ALL SELECT 2, 'active', CASE WHEN risk_score < 95 THEN 'below_threshold' WHEN row_number() OVER (PARTITION BY user_name, day, risk_score >= 95 ORDER BY risk_score DESC, first_seen, incident_key) > 3 THEN 'suppressed_budget' ELSE 'alert' END, true FROM risk) GROUP BY ALL""", *ALL, o.RISK, **PRINTS))
def r04_versions(spark, sf_dir):
    """Assessments under two policies, one after the other."""
    from .settings import FUSION

    made = full(spark, sf_dir).rated
    first = fusion.versioned(None, fusion.assessments(made, now_ms=0), 1)
    rows = fusion.versioned(first, fusion.assessments(made, config=FUSION | {"alert_threshold": 95}, now_ms=0), 2)
    return rows.groupBy(c("revision").cast("int").alias("revision"), "status", "policy_action").agg(F.count(F.lit(1)).alias("n"), F.count("supersedes").alias("replaces"))


@query(o.sql("""SELECT alert_key, incident_key, policy_action FROM (SELECT *, CASE WHEN risk_score < 80 THEN 'below_threshold' WHEN held THEN 'suppressed_by_case_policy' WHEN row_number() OVER (PARTITION BY user_name, day, risk_score >= 80 AND NOT held ORDER BY risk_score DESC, first_seen, incident_key) > 3 THEN 'suppressed_budget' ELSE 'alert' END AS policy_action
  FROM (SELECT risk1.*, substr(alert_key, 1, 1) IN ('0', '1', '2', '3') AS held FROM risk1))""", *ALL, o.RISK, **PRINTS))
def j07_suppressed(spark, sf_dir):
    """Assessments where cases of some alerts (by the first digit of their keys) hold them back, and others did so once."""
    made = full(spark, sf_dir).rated
    keys = fusion.assessments(made, now_ms=0).select("alert_key").distinct()
    until = F.when(F.substring("alert_key", 1, 1).isin("0", "1", "2", "3"), 2000).when(F.substring("alert_key", 1, 1).isin("4", "5"), 500)
    held = keys.select("alert_key", until.cast("long").alias("suppression_until")).where("suppression_until IS NOT NULL")
    return fusion.assessments(made, held, now_ms=1000).select("alert_key", "incident_key", "policy_action")


@query(o.sql("""SELECT count(*) AS total_records, count(*) FILTER (kind = 'unchanged') AS unchanged, count(*) FILTER (kind = 'unknown_resolved') AS unknown_resolved, count(*) FILTER (kind = 'new_unknown') AS new_unknown, count(*) FILTER (kind IN ('parser_changed', 'unknown_resolved', 'new_unknown')) AS parser_changed, 0 AS event_changed, 0 AS new_record, 0 AS removed_record,
  count(*) FILTER (a) AS baseline_normalized_records, count(*) FILTER (NOT a) AS baseline_unknown_records, count(*) FILTER (b) AS current_normalized_records, count(*) FILTER (NOT b) AS current_unknown_records
  FROM (SELECT i % 6 < 4 AND NOT (i % 6 = 0 AND i % 7 = 0) AS a, i % 6 > 0 OR i % 7 > 0 AS b, CASE WHEN i % 6 > 3 THEN 'unknown_resolved' ELSE 'unchanged' END AS kind FROM nv)""", NUMBERED))
def a25_change_counts(spark, sf_dir):
    """A replay of the same records with active parsers added."""
    rows = settle(records(spark, sf_dir, "mixed"))
    of = lambda parsers: settle(parsing.parse(rows, parsers).select("record_id", F.when(c("event").isNotNull(), "normalized").otherwise("unknown").alias("kind"), c("event.parser.id").alias("parser_id"), F.to_json("event.event").alias("projection")))
    before, after = of(None), of(ACTIVE)
    same = lambda df: df.withColumn("projection", F.regexp_replace("projection", '"time":"[^"]*"', ""))
    return quality.change_counts(quality.replay_changes(same(before), same(after)), before, after)


LATE = f""",
early AS (SELECT ev.* FROM ev, newest WHERE {EARLY}),
g1 AS (SELECT *, CASE WHEN t - lag(t) OVER q <= 1800000 THEN 0 ELSE 1 END AS opens FROM early WINDOW q AS (PARTITION BY user_name ORDER BY t, event_id)),
s1 AS (SELECT user_name, min(t) AS start_time, max(t) AS last_event_time, list(event_id) AS ids FROM (SELECT *, sum(opens) OVER (PARTITION BY user_name ORDER BY t, event_id) AS s FROM g1) GROUP BY user_name, s),
done AS (SELECT s1.* FROM s1, newest WHERE last_event_time + 1800000 < as_of - 864000000),
pool AS (SELECT * FROM ev WHERE event_id NOT IN (SELECT unnest(ids) FROM done)),
g2 AS (SELECT *, CASE WHEN t - lag(t) OVER q <= 1800000 THEN 0 ELSE 1 END AS opens FROM pool WINDOW q AS (PARTITION BY user_name ORDER BY t, event_id)),
s2 AS (SELECT user_name, min(t) AS start_time, max(t) AS last_event_time, list(event_id) AS ids FROM (SELECT *, sum(opens) OVER (PARTITION BY user_name ORDER BY t, event_id) AS s FROM g2) GROUP BY user_name, s)
"""


@query(o.sql("SELECT user_name, start_time, last_event_time, len(ids) AS event_count, 'watermark' AS close_reason FROM done UNION ALL SELECT user_name, start_time, last_event_time, len(ids), 'end_of_input' FROM s2", LATE))
def t06_late_sessions(spark, sf_dir):
    """Sessions that a watermark closed stay as they are; what comes late begins its own, and the end of input closes it."""
    first, events, newest = _two_runs(spark, sf_dir)
    done, pool, _ = session_ops.advance(session_ops.none_closed(events), first.limit(0), first, newest - 864_000_000)
    rest = pool.unionByName(events.join(first.select("event_id"), "event_id", "left_anti").select(*pool.columns))
    return session_ops.flushed(settle(done), settle(rest)).select("user_name", "start_time", "last_event_time", "event_count", "close_reason")
