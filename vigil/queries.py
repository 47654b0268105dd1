"""Registered queries and their SQL. Each query runs an operator over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracle as o
from .functions import registry
from .functions import text as text_ops
from .operators import baseline, cases, evaluation, features, fusion, investigation, models, quality, readiness, rules
from .operators import sessions as session_ops
from .plans.chain import Chain
from .settings import BASELINE
from .sources import files
from .sources.state import settle
from .sources.tables import canonical_events, peer_groups, read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

#: Rules of the registered queries.
EVENT_RULE = {
    "rule_id": "failed-read", "version": 1, "name": "failure at some resources", "scope": "event", "status": "active", "score": 65, "source_types": ["svn", "waf"], "match": "all",
    "conditions": [{"field": "event.outcome", "operator": "eq", "value": "failure"}, {"field": "resource.name", "operator": "ends_with", "value": "7"}],
}
WINDOW_RULE = {
    "rule_id": "busy-hour", "version": 2, "name": "busy hour", "scope": "window", "window_size": 3600, "status": "active", "score": 70, "match": "any",
    "conditions": [{"field": "event_count", "operator": "gte", "value": 3}, {"field": "write_action_count", "operator": "gt", "value": 1}],
}
PRINTS = {"event_print": rules.fingerprint(EVENT_RULE), "window_print": rules.fingerprint(WINDOW_RULE)}
#: Lets rare values show in users with few events.
RARE = {"svn": {"rare_share_threshold": 0.05}}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def chain(spark: SparkSession, sf_dir: str, **options) -> Chain:
    events = canonical_events(spark, sf_dir)
    return Chain(events, peer_groups(events), **options)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c, t in df.dtypes if t == "double"})


@query(o.sql("SELECT * FROM win"))
def a01_user_windows(spark, sf_dir):
    return chain(spark, sf_dir).windows


@query(o.sql("SELECT user_name, window_size, window_start, source_type_distinct_count, source_ip_distinct_count, resource_distinct_count, action_distinct_count FROM win"))
def a03_window_distincts(spark, sf_dir):
    return chain(spark, sf_dir).windows.select("user_name", "window_size", "window_start", *[f"{k}_distinct_count" for k in ("source_type", "source_ip", "resource", "action")])


@query(o.sql("SELECT * FROM wv"))
def a04_window_values(spark, sf_dir):
    return chain(spark, sf_dir).values


@query(o.sql("SELECT user_name, value_type, value_key, count(*) AS event_count, min(t) AS first_time_ms, arg_min(event_id, (t, event_id)) AS first_event_id, max(t) AS last_time_ms, arg_max(event_id, (t, event_id)) AS last_event_id FROM vals GROUP BY ALL"))
def a05_value_stats(spark, sf_dir):
    return features.value_stats(canonical_events(spark, sf_dir))


@query(o.sql("SELECT user_name, window_size, window_start, ip AS first_seen_ip_count, res AS first_seen_resource_count, act AS first_seen_action_count FROM fw"))
def a06_first_seen(spark, sf_dir):
    return features.first_seen_counts(features.value_stats(canonical_events(spark, sf_dir)))


@query(o.sql("SELECT user_name, min(t) AS first_time_ms, arg_min(event_id, (t, event_id)) AS first_event_id, max(t) AS last_time_ms, arg_max(event_id, (t, event_id)) AS last_event_id FROM ev GROUP BY ALL"))
def a07_bounds(spark, sf_dir):
    return chain(spark, sf_dir).bounds


@query(o.sql("SELECT user_name, start_time, first_event_id, last_event_time, last_event_id, event_count, session_id, array_to_string(source_types[:64], ',') AS source_types, array_to_string(source_ips[:64], ',') AS source_ips, array_to_string(resources[:64], ',') AS resources, array_to_string(actions[:64], ',') AS first_actions, array_to_string(actions[-64:], ',') AS last_actions FROM sessions", o.SESSIONS))
def t03_sessions(spark, sf_dir):
    names = {"source_type": "source_types", "source_ip": "source_ips", "resource_display": "resources"}
    acts = [F.array_join(F.transform(c, lambda x: x["action"]), ",").alias(c) for c in ("first_actions", "last_actions")]
    return chain(spark, sf_dir).sessions.select("user_name", "start_time", "first_event_id", "last_event_time", "last_event_id", "event_count", "session_id", *[F.array_join(f"{k}_samples", ",").alias(v) for k, v in names.items()], *acts)


@query(o.sql("SELECT session_id, CASE WHEN last_event_time + 1800000 < as_of - 300000 THEN 'closed' ELSE 'provisional' END AS status FROM sessions, newest", o.SESSIONS))
def t04_watermark(spark, sf_dir):
    c = chain(spark, sf_dir)
    return session_ops.closed(c.sessions, c.as_of - 300_000).select("session_id", "status")


STATS = "sample_count, round(mean, 6) AS mean, round(std, 6) AS std, min, max, round(p50, 6) AS p50, round(p95, 6) AS p95, round(p99, 6) AS p99, round(mad, 6) AS mad, active_days, status"


STAT = ("sample_count", "mean", "std", "min", "max", "p50", "p95", "p99", "mad", "active_days", "status")


@query(o.sql(f"SELECT window_size, metric, {STATS} FROM whole", o.METRICS))
def a11_global_metrics(spark, sf_dir):
    return rounded(baseline.by_metric(chain(spark, sf_dir).groups.where("scope = 'global'")).select("window_size", "metric", *STAT))


@query(o.sql(f"SELECT user_name, window_size, metric, {STATS} FROM personal", o.METRICS))
def a10_personal_metrics(spark, sf_dir):
    return rounded(baseline.by_metric(chain(spark, sf_dir).personal).select("user_name", "window_size", "metric", *STAT))


@query(o.sql(f"SELECT group_id, window_size, metric, member_count, {STATS} FROM peer", o.METRICS))
def a12_peer_metrics(spark, sf_dir):
    rows = baseline.by_metric(chain(spark, sf_dir).groups.where("scope = 'peer_group'"))
    return rounded(rows.select(F.col("subject").alias("group_id"), "window_size", "metric", "member_count", *STAT))


@query(o.sql("SELECT 'personal' AS scope, user_name AS subject, value_type, value_key, first_seen, round(share, 9) AS share, event_count FROM pv UNION ALL SELECT 'peer_group', group_id, value_type, value_key, first_seen, round(share, 9), event_count FROM rv UNION ALL SELECT 'global', '', value_type, value_key, first_seen, round(share, 9), event_count FROM gv", o.METRICS, o.VALUES))
def a13_value_share(spark, sf_dir):
    return rounded(chain(spark, sf_dir).value_baselines.select("scope", "subject", "value_type", "value_key", "first_seen", "share", "event_count"), 9)


CAND = "user_name, window_size, window_start, detector_id, metric, value_type, value_key, scope AS baseline_scope, group_id, candidate_key"
SHOW = ("user_name", "window_size", "window_start", "detector_id", "metric", "value_type", "value_key", "baseline_scope", "group_id", "candidate_key")
NUMERIC = (o.METRICS, o.VALUES, o.SCOPED, o.CANDIDATES)


@query(o.sql(f"SELECT {CAND} FROM cand WHERE detector_id LIKE 'numeric%'", *NUMERIC))
def d01_numeric(spark, sf_dir):
    return chain(spark, sf_dir).numeric.select(*SHOW)


@query(o.sql(f"SELECT {CAND} FROM cand WHERE detector_id LIKE 'numeric%'", *NUMERIC, days=28))
def j01_scope_fallback(spark, sf_dir):
    return chain(spark, sf_dir, baseline_config=BASELINE | {"min_active_days": 28}).numeric.select(*SHOW)


@query(o.sql(f"SELECT {CAND} FROM cand WHERE detector_id = 'new_value_30d'", *NUMERIC))
def d02_new_value(spark, sf_dir):
    return chain(spark, sf_dir).valued.where("detector_id = 'new_value_30d'").select(*SHOW)


@query(o.sql(f"SELECT {CAND} FROM cand WHERE detector_id = 'rare_value'", *NUMERIC, rare=0.05))
def d03_rare_value(spark, sf_dir):
    return chain(spark, sf_dir, overrides=RARE).valued.where("detector_id = 'rare_value'").select(*SHOW)


RULE_SELECT = "SELECT user_name, window_size, window_start, detector_id, score, event_id, candidate_key FROM rulec WHERE window_size {}"


@query(o.sql(RULE_SELECT.format("= 0"), *NUMERIC, o.RULED, **PRINTS))
def d06_event_rule(spark, sf_dir):
    return chain(spark, sf_dir, rules=[EVENT_RULE]).ruled.select("user_name", "window_size", "window_start", "detector_id", "score", "event_id", "candidate_key")


@query(o.sql(RULE_SELECT.format("> 0"), *NUMERIC, o.RULED, **PRINTS))
def d06_window_rule(spark, sf_dir):
    return chain(spark, sf_dir, rules=[WINDOW_RULE]).ruled.select("user_name", "window_size", "window_start", "detector_id", "score", "event_id", "candidate_key")


ALL = (*NUMERIC, o.RULED, o.SESSIONS, o.INCIDENTS)


def full(spark, sf_dir) -> Chain:
    return chain(spark, sf_dir, rules=[EVENT_RULE, WINDOW_RULE])


@query(o.sql("SELECT candidate_key, count(*) AS event_count, count(*) > 20 AS truncated, string_agg(event_id, ',' ORDER BY r) FILTER (r <= 20) AS event_ids FROM members GROUP BY ALL", *ALL, **PRINTS))
def j04_evidence_top20(spark, sf_dir):
    return full(spark, sf_dir).evidence.select("candidate_key", "event_count", "truncated", F.array_join(F.transform("evidence", lambda e: e["event_id"]), ",").alias("event_ids"))


@query(o.sql("SELECT candidate_key, session_id, correlation_key FROM keyed", *ALL, **PRINTS))
def j05_session_overlap(spark, sf_dir):
    return full(spark, sf_dir).keyed.select("candidate_key", "session_id", "correlation_key")


@query(o.sql("SELECT incident_key, user_name, correlation_key, first_seen, last_seen, incident_type, aggregation_score, severity, candidate_count, detector_count, families AS detector_family_count, coalesce(source_types, '') AS source_types, coalesce(source_ips, '') AS source_ips, coalesce(resources, '') AS resources FROM inc", *ALL, **PRINTS))
def c02_incidents(spark, sf_dir):
    sets = [F.array_join(c, ",").alias(c) for c in ("source_types", "source_ips", "resources")]
    return full(spark, sf_dir).incidents.select("incident_key", "user_name", "correlation_key", "first_seen", "last_seen", "incident_type", "aggregation_score", "severity", "candidate_count", "detector_count", "detector_family_count", *sets)


@query(o.sql("SELECT incident_key, sha256(incident_key) AS assessment_key, alert_key, user_name, risk_score, risk_severity, policy_action FROM risk", *ALL, o.RISK, **PRINTS))
def r01_risk(spark, sf_dir):
    return full(spark, sf_dir).assessments.select("incident_key", "assessment_key", "alert_key", "user_name", "risk_score", "risk_severity", "policy_action")


@query(o.sql("SELECT alert_key, incident_key, user_name, incident_type, first_seen, last_seen, risk_score, risk_severity AS severity FROM risk WHERE policy_action = 'alert'", *ALL, o.RISK, **PRINTS))
def w01_alert_budget(spark, sf_dir):
    return full(spark, sf_dir).alerts.drop("assessment_key", "policy_reason")


#: name: (conditions, all or any, the same as SQL over ev)
CONDITIONS = {
    "f05_neq": ([("event.outcome", "neq", "success")], "all", "outcome <> 'success'"),
    "f05_neq_missing": ([("host.name", "neq", "x")], "all", "true"),
    "f06_not_in": ([("event.action", "not_in", ["repo_read", "user_login"])], "all", "action NOT IN ('repo_read', 'user_login')"),
    "f06_in": ([("source.ip", "in", ["10.0.1.1", "10.0.2.2"])], "all", "source_ip IN ('10.0.1.1', '10.0.2.2')"),
    "f08_exists": ([("host.name", "exists", False), ("user.name", "exists", True)], "all", "true"),
    "f09_text": ([("event.action", "starts_with", "repo_"), ("resource.name", "ends_with", "7"), ("resource.name", "contains", "s-1")], "all", "action LIKE 'repo\\_%' ESCAPE '\\' AND shown LIKE '%7' AND shown LIKE '%s-1%'"),
    "f10_cidr": ([("source.ip", "cidr_contains", "10.0.8.1/21")], "all", "CAST(string_split(source_ip, '.')[3] AS INT) BETWEEN 8 AND 15"),
    "f11_any": ([("event.outcome", "eq", "failure"), ("resource.name", "ends_with", "3")], "any", "outcome = 'failure' OR shown LIKE '%3'"),
}


def _condition_query(name: str, conditions: list, match: str):
    def run(spark, sf_dir):
        events = canonical_events(spark, sf_dir)
        rule = {"match": match, "conditions": [{"field": f, "operator": p, "value": v} for f, p, v in conditions]}
        return events.where(rules.compile_rule(rule, rules.event_fields(events.columns))).select("event_id", "user_name")

    run.__name__ = name
    return run


for _name, (_conditions, _match, _sql) in CONDITIONS.items():
    query(o.sql(f"SELECT event_id, user_name FROM ev WHERE {_sql}"))(_condition_query(_name, _conditions, _match))


@query(o.sql("SELECT user_name, window_start FROM win WHERE window_size = 86400 AND event_count > 1 AND network_bytes_total <= 20000"))
def f07_compare(spark, sf_dir):
    rule = {"match": "all", "conditions": [{"field": "event_count", "operator": "gt", "value": 1}, {"field": "network_bytes_total", "operator": "lte", "value": 20000}]}
    return chain(spark, sf_dir).windows.where("window_size = 86400").where(rules.compile_rule(rule, rules.window_fields())).select("user_name", "window_start")


@query(o.sql("SELECT * FROM win WHERE window_size = 3600 AND window_start < 1704412800000 AND window_end > 1704326400000"))
def f01_time_overlap(spark, sf_dir):
    return features.overlapping(chain(spark, sf_dir).windows.where("window_size = 3600"), 1704326400000, 1704412800000)


STRIPPED = r"regexp_replace(regexp_replace(text, '^[\s\p{Z}\x0b\x1c-\x1f\x85]+', ''), '[\s\p{Z}\x0b\x1c-\x1f\x85]+$', '')"
FORMAT = rf"""SELECT doc_id, CASE WHEN t = '' THEN 'empty' WHEN starts_with(t, '{{') AND json_valid(t) THEN 'json' WHEN starts_with(t, '{{') THEN 'json_like' WHEN regexp_matches(t, '[\p{{L}}\p{{N}}_]=') THEN 'key_value'
  WHEN regexp_matches(t, '^\d+\.\d+\.\d+\.\d+ - \S+ \[[^\]]+\] "\S+ ') THEN 'apache_access' ELSE 'text' END AS format FROM (SELECT doc_id, {STRIPPED} AS t FROM documents)"""
HINT = rf"""SELECT doc_id, left(regexp_replace(regexp_replace(regexp_replace({STRIPPED}, '\b\d+\.\d+\.\d+\.\d+\b', '<IP>', 'g'), '\b\d{{2,}}\b', '<NUM>', 'g'), '=[^<\s]\S*', '=<VAR>', 'g'), 500) AS hint FROM documents"""


@query(FORMAT)
def p15_format(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", text_ops.detect_format(F.col("text")).alias("format"))


@query(HINT)
def p16_template(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", text_ops.template_hint(F.col("text")).alias("hint"))


@query(r"SELECT doc_id, regexp_replace(text, '(?i)\b(\w*(?:password|passwd|token|authorization|api[_-]?key|secret)\w*)\s*=\s*[^\s,;]+', '\1=<REDACTED>', 'g') AS text FROM documents")
def p21_redact(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", text_ops.redact(F.col("text")).alias("text"))


@query(f"SELECT hint AS template_hint, count(*) AS n FROM ({HINT}) GROUP BY ALL ORDER BY n DESC, hint LIMIT 10")
def a20_template_top10(spark, sf_dir):
    return quality.top_templates(read(spark, sf_dir, "documents").select(text_ops.template_hint(F.col("text")).alias("template_hint")))


def _unknown(spark, sf_dir):
    """Chat messages as records that no parser takes."""
    rows = read(spark, sf_dir, "conversations")
    ident = F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string"), "role")
    return rows.select(F.sha2(ident, 256).alias("unknown_id"), ident.alias("record_id"), F.col("role").alias("suggested_source_type"), text_ops.detect_format(F.col("text")).alias("detected_format"), text_ops.template_hint(F.col("text")).alias("template_hint"), F.col("text").alias("raw_text"))


@query(rf"""WITH u AS (SELECT sha256(conv_id || ':' || turn || ':' || role) AS id, role, CASE WHEN t = '' THEN 'empty' WHEN starts_with(t, '{{') AND json_valid(t) THEN 'json' WHEN starts_with(t, '{{') THEN 'json_like' WHEN regexp_matches(t, '[\p{{L}}\p{{N}}_]=') THEN 'key_value'
    WHEN regexp_matches(t, '^\d+\.\d+\.\d+\.\d+ - \S+ \[[^\]]+\] "\S+ ') THEN 'apache_access' ELSE 'text' END AS format,
    left(regexp_replace(regexp_replace(regexp_replace(t, '\b\d+\.\d+\.\d+\.\d+\b', '<IP>', 'g'), '\b\d{{2,}}\b', '<NUM>', 'g'), '=[^<\s]\S*', '=<VAR>', 'g'), 500) AS hint FROM (SELECT *, {STRIPPED} AS t FROM conversations))
  SELECT 'candidate_' || left(sha256(role || ':' || format || ':' || hint), 16) AS candidate_id, role AS suggested_source_type, format AS detected_format, hint AS template_hint, count(*) AS sample_count, array_to_string(list_sort(list(id))[:5], ',') AS samples FROM u GROUP BY ALL""")
def a24_candidates(spark, sf_dir):
    rows = quality.parser_candidates(_unknown(spark, sf_dir))
    return rows.select("candidate_id", "suggested_source_type", "detected_format", "template_hint", "sample_count", F.array_join(F.transform("samples", lambda x: x["unknown_id"]), ",").alias("samples"))


@query(o.sql("""SELECT coalesce(b.event_id, a.event_id) AS record_id, CASE WHEN b.event_id IS NULL THEN 'new_record' WHEN a.event_id IS NULL THEN 'removed_record' WHEN b.kind = 'unknown' AND a.kind = 'normalized' THEN 'unknown_resolved' WHEN b.kind = 'normalized' AND a.kind = 'unknown' THEN 'new_unknown'
    WHEN b.parser <> a.parser THEN 'parser_changed' WHEN b.p <> a.p THEN 'event_changed' ELSE 'unchanged' END AS change_type FROM
  (SELECT event_id, CASE WHEN source_type = 'waf' THEN 'unknown' ELSE 'normalized' END AS kind, source_type AS parser, action AS p FROM ev WHERE bytes % 10 <> 0) b FULL JOIN
  (SELECT event_id, CASE WHEN source_type = 'sso' THEN 'unknown' ELSE 'normalized' END AS kind, CASE WHEN action = 'repo_write' THEN 'v2' ELSE source_type END AS parser, CASE WHEN action = 'repo_clone' THEN 'repo_read' ELSE action END AS p FROM ev WHERE bytes % 10 <> 1) a USING (event_id)"""))
def j10_replay_compare(spark, sf_dir):
    ev = canonical_events(spark, sf_dir).withColumnRenamed("event_id", "record_id")
    kind = lambda source: F.when(F.col("source_type") == source, "unknown").otherwise("normalized").alias("kind")
    before = ev.where("network_bytes % 10 <> 0").select("record_id", kind("waf"), F.col("source_type").alias("parser_id"), F.col("action").alias("projection"))
    after = ev.where("network_bytes % 10 <> 1").select("record_id", kind("sso"), F.when(F.col("action") == "repo_write", "v2").otherwise(F.col("source_type")).alias("parser_id"), F.when(F.col("action") == "repo_clone", "repo_read").otherwise(F.col("action")).alias("projection"))
    return quality.replay_changes(before, after).select("record_id", "change_type")


VECTOR = """,
vec AS (SELECT user_name, peer_id, window_start, ln(1 + event_count) AS event_count_log, failure_count / event_count AS failure_rate, other_outcome_count / event_count AS other_outcome_rate, ln(1 + source_type_distinct_count) AS source_type_distinct_log,
  ln(1 + source_ip_distinct_count) AS source_ip_distinct_log, ln(1 + resource_distinct_count) AS resource_distinct_log, ln(1 + action_distinct_count) AS action_distinct_log, read_action_count / event_count AS read_rate, write_action_count / event_count AS write_rate,
  ln(1 + network_bytes_total) AS network_bytes_log, first_seen_ip_count / greatest(source_ip_distinct_count, 1) AS first_seen_ip_rate, first_seen_resource_count / greatest(resource_distinct_count, 1) AS first_seen_resource_rate,
  first_seen_action_count / greatest(action_distinct_count, 1) AS first_seen_action_rate FROM win JOIN (SELECT user_name, group_id AS peer_id FROM peers) USING (user_name) WHERE window_size = 86400)
"""


@query(o.sql("SELECT user_name, window_start, round(COLUMNS(* EXCLUDE (user_name, peer_id, window_start)), 9) FROM vec", VECTOR))
def m01_features(spark, sf_dir):
    return rounded(models.features(chain(spark, sf_dir).windows.where("window_size = 86400"), ("user_name", "window_start")), 9)


def _vectors(spark, sf_dir):
    c = chain(spark, sf_dir)
    return models.features(c.windows.where("window_size = 86400").join(c.peers, "user_name"), ("user_name", "group_id", "window_start"))


HBOS = VECTOR + """,
lv AS (UNPIVOT vec ON COLUMNS(* EXCLUDE (user_name, peer_id, window_start)) INTO NAME feature VALUE v),
ns AS (SELECT peer_id, count(*) AS n, greatest(5, least(20, CAST(ceil(sqrt(count(*))) AS INT))) AS bins FROM vec GROUP BY ALL HAVING count(*) >= 100),
qs AS (SELECT peer_id, feature, n, list_sort(list(v)) AS vs, any_value(bins) AS bins FROM lv JOIN ns USING (peer_id) GROUP BY ALL),
ed AS (SELECT peer_id, feature, n, vs[1] AS low, vs[-1] AS high, list_sort(list_distinct(list_transform(range(1, bins), lambda i: vs[CAST(floor((n - 1) * (i / bins)) AS INT) + 1] + (vs[CAST(ceil((n - 1) * (i / bins)) AS INT) + 1] - vs[CAST(floor((n - 1) * (i / bins)) AS INT) + 1]) * ((n - 1) * (i / bins) - floor((n - 1) * (i / bins)))))) AS edges FROM qs)
"""


@query(o.sql("SELECT peer_id AS group_id, feature, n, round(low, 9) AS low, round(high, 9) AS high, len(edges) >= 1 AS has_edges, round(list_min(edges), 6) AS first_edge, round(list_max(edges), 6) AS last_edge FROM ed", HBOS))
def m02_hbos_bins(spark, sf_dir):
    rows = models.fit_histograms(_vectors(spark, sf_dir), "group_id")
    return rows.select("group_id", "feature", "n", F.round("low", 9).alias("low"), F.round("high", 9).alias("high"), (F.size("edges") >= 1).alias("has_edges"), F.round(F.array_min("edges"), 6).alias("first_edge"), F.round(F.array_max("edges"), 6).alias("last_edge"))


SCORED = HBOS + """,
bc AS (SELECT peer_id, feature, len(list_filter(edges, lambda e: e <= v)) AS bin, count(*) AS c FROM lv JOIN ed USING (peer_id, feature) GROUP BY ALL),
pt AS (SELECT x.peer_id, user_name, window_start, feature, -ln(CASE WHEN v < low OR v > high THEN 1 ELSE coalesce(c, 0) + 1 END / (n + len(edges) + 1)) AS part
  FROM (SELECT lv.*, n, low, high, edges, len(list_filter(edges, lambda e: e <= v)) AS bin FROM lv JOIN ed USING (peer_id, feature)) x LEFT JOIN bc USING (peer_id, feature, bin)),
sc AS (SELECT peer_id AS group_id, user_name, window_start, round(sum(part), 9) AS raw FROM pt GROUP BY ALL),
lim AS (SELECT group_id, quantile_cont(raw, 0.995) AS threshold FROM sc GROUP BY ALL),
jd AS (SELECT *, count(*) OVER (PARTITION BY group_id ORDER BY raw RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / count(*) OVER (PARTITION BY group_id) AS percentile FROM sc JOIN lim USING (group_id))
"""


@query(o.sql("SELECT group_id, user_name, window_start, round(raw, 6) AS raw, round(threshold, 6) AS threshold, round(percentile, 9) AS percentile, CAST(round_even(60 + 40 * greatest(0, least(1, (percentile - 0.995) / (1 - 0.995))), 0) AS INT) AS score, raw >= threshold AS fires FROM jd", SCORED))
def m03_hbos_score(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    rows = models.scored(v, v, "group_id", ["user_name", "window_start"])
    return rows.select("group_id", "user_name", "window_start", F.round("raw", 6).alias("raw"), F.round("threshold", 6).alias("threshold"), F.round("percentile", 9).alias("percentile"), "score", "fires")


@query()
def m05_isolation_forest(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    return rounded(models.forest_scored(v, v, "group_id", ["user_name", "window_start"]))


@query(o.sql("""SELECT sha256(alert_key) AS case_id, alert_key, user_name, 'new' AS status, risk_score, risk_severity AS severity FROM
  (SELECT *, row_number() OVER (PARTITION BY alert_key ORDER BY risk_score DESC, first_seen, incident_key DESC) AS best FROM risk WHERE policy_action = 'alert') WHERE best = 1""", *ALL, o.RISK, **PRINTS))
def k01_cases(spark, sf_dir):
    return cases.sync(cases.empty(spark), full(spark, sf_dir).alerts, 0).select("case_id", "alert_key", "user_name", "status", "risk_score", "severity")


@query(o.sql("""SELECT window_size, count(*) AS windows, count(DISTINCT user_name) AS users, count(DISTINCT window_start // 86400000) AS days FROM win GROUP BY ALL"""))
def a22_readiness(spark, sf_dir):
    day = F.col("window_start") - F.pmod("window_start", F.lit(86_400_000))
    return chain(spark, sf_dir).windows.groupBy("window_size").agg(F.count(F.lit(1)).alias("windows"), F.count_distinct("user_name").alias("users"), F.count_distinct(day).alias("days"))


@query(o.sql("""SELECT count(*) FILTER (a AND b) AS both, count(*) AS either, round(count(*) FILTER (a AND b) / count(*), 6) AS jaccard FROM (SELECT user_name, t // 86400000 AS d, bool_or(outcome = 'failure') AS a, bool_or(bytes > 20000) AS b FROM ev GROUP BY ALL) WHERE a OR b"""))
def u02_jaccard(spark, sf_dir):
    ev = canonical_events(spark, sf_dir).withColumn("eval_day", F.floor(F.col("event_time_ms") / 86_400_000))
    return rounded(evaluation.compare(ev.where("outcome = 'failure'"), ev.where("network_bytes > 20000")).select("both", "either", "jaccard"))


def _days(c: Chain) -> tuple[int, int]:
    """From the UTC midnight before the first event to that after the newest."""
    first = c.bounds.agg(F.min("first_time_ms")).first()[0] or 0
    return first // features.DAY_MS * features.DAY_MS, _until(c)


def _until(c: Chain) -> int:
    return (c.as_of // features.DAY_MS + 1) * features.DAY_MS


EVALS = """,
evals AS (SELECT unnest(generate_series(a // 86400000 * 86400000, b // 86400000 * 86400000, 86400000)) AS eval_day FROM (SELECT min(t) AS a, max(t) AS b FROM ev))
"""
#: Percentiles with the empty slots of a history counted, not made: of n values sorted and z zeros before them.
RANK = "(CASE WHEN {i} < z THEN 0 ELSE vs[CAST({i} - z AS INT) + 1] END)"
LERP = "{lo} + ({hi} - {lo}) * ({p} * (n - 1) - floor({p} * (n - 1)))"


def _at(p: float) -> str:
    lo, hi = (RANK.replace("{i}", f"least(floor({p} * (n - 1)) + {k}, n - 1)") for k in (0, 1))
    return LERP.format(lo=lo, hi=hi, p=p)


BACKTEST = EVALS + f""",
long AS (UNPIVOT (SELECT user_name, window_size, window_start, CAST(COLUMNS(* EXCLUDE (user_name, window_size, window_start, window_end)) AS DOUBLE) FROM win WHERE window_size >= 3600)
  ON COLUMNS(* EXCLUDE (user_name, window_size, window_start)) INTO NAME metric VALUE v),
lists AS (SELECT eval_day, user_name, window_size, metric, list_sort(list(v)) AS vs, count(*) AS observed, count(DISTINCT window_start // 86400000) AS active_days, 2592000 // window_size AS n, 2592000 // window_size - count(*) AS z
  FROM long JOIN evals ON window_start >= eval_day - 2592000000 AND window_start < eval_day GROUP BY eval_day, user_name, window_size, metric),
snap AS (SELECT eval_day, user_name, window_size, metric, observed, active_days, {_at(0.95)} AS p95, {_at(0.99)} AS p99, CASE WHEN active_days >= 14 AND observed >= 20 THEN 'ready' ELSE 'warming_up' END AS status FROM lists),
fired AS (SELECT eval_day, user_name, window_size, long.window_start, metric, CASE WHEN round(v, 9) > round(p99, 9) THEN 'numeric_p99' ELSE 'numeric_p95' END AS detector_id
  FROM long JOIN snap USING (user_name, window_size, metric) WHERE status = 'ready' AND long.window_start - long.window_start % 86400000 = eval_day AND round(v, 9) > round(p95, 9)),
judged AS (SELECT *, CASE detector_id WHEN 'numeric_p99' THEN 80 ELSE 60 END AS score, CASE detector_id WHEN 'numeric_p99' THEN 'high' ELSE 'medium' END AS severity FROM fired)
"""


def _fired(c: Chain) -> DataFrame:
    return evaluation.day_candidates(c.windows, evaluation.day_limits(c.windows, *_days(c)))


@query(o.sql("SELECT eval_day, user_name, window_size, metric, observed, active_days, round(p95, 6) AS p95, round(p99, 6) AS p99, status FROM snap", BACKTEST))
def e01_daily_snapshot(spark, sf_dir):
    c = chain(spark, sf_dir)
    return rounded(evaluation.day_snapshots(c.windows, *_days(c)))


@query(o.sql("SELECT * FROM judged", BACKTEST))
def e02_day_candidates(spark, sf_dir):
    return _fired(chain(spark, sf_dir))


def _metrics_sql(where: str) -> str:
    """The 14 metrics of an experiment whose candidates are those of judged for which where holds."""
    return f"""(SELECT CAST(sum(c) AS BIGINT) AS candidate_count, CAST(sum(p) AS BIGINT) AS predicted_user_days, (SELECT count(DISTINCT user_name) FROM judged WHERE {where}) AS unique_predicted_users, count(*) FILTER (p > 0) AS active_prediction_days,
  round(avg(p), 6) AS average_daily_predictions, round(avg(c), 6) AS average_daily_candidates, min(p) AS min_daily_predictions, max(p) AS max_daily_predictions, round(stddev_pop(p), 6) AS daily_prediction_stddev,
  round(CASE WHEN avg(p) > 0 THEN stddev_pop(p) / avg(p) ELSE 0 END, 6) AS daily_prediction_cv, CAST(sum(h) AS BIGINT) AS high_severity_candidates, max(s) AS max_candidate_score, min(c) AS min_daily_candidates, max(c) AS max_daily_candidates
  FROM (SELECT e.eval_day, count(user_name) AS c, count(DISTINCT user_name) AS p, count(*) FILTER (severity = 'high') AS h, coalesce(max(score), 0) AS s FROM evals e LEFT JOIN (SELECT * FROM judged WHERE {where}) USING (eval_day) GROUP BY ALL))"""


@query(o.sql(f"SELECT * FROM {_metrics_sql('true')}", BACKTEST))
def a21_experiment(spark, sf_dir):
    c = chain(spark, sf_dir)
    return rounded(evaluation.experiment_metrics(_fired(c), *_days(c)))


@query(o.sql("""SELECT user_name, eval_day, max(score) AS max_score, count(*) AS candidate_count, string_agg(DISTINCT detector_id, ',' ORDER BY detector_id) AS detectors, string_agg(DISTINCT severity, ',' ORDER BY severity) AS severities FROM judged GROUP BY ALL""", BACKTEST))
def a21_user_days(spark, sf_dir):
    rows = evaluation.user_days(_fired(chain(spark, sf_dir)))
    return rows.withColumns({c: F.array_join(c, ",") for c in ("detectors", "severities")})


HIGH = "detector_id = 'numeric_p99'"


@query(o.sql(f"""SELECT metric, round(r.v - l.v, 6) AS delta FROM (UNPIVOT (SELECT CAST(COLUMNS(*) AS DOUBLE) FROM {_metrics_sql('true')}) ON COLUMNS(*) INTO NAME metric VALUE v) l JOIN (UNPIVOT (SELECT CAST(COLUMNS(*) AS DOUBLE) FROM {_metrics_sql(HIGH)}) ON COLUMNS(*) INTO NAME metric VALUE v) r USING (metric)""", BACKTEST))
def e04_compare(spark, sf_dir):
    c = chain(spark, sf_dir)
    every, days = settle(_fired(c)), _days(c)
    made = [rounded(evaluation.experiment_metrics(x, *days)) for x in (every, every.where(HIGH))]
    return rounded(evaluation.deltas(*made))


TRAINING = EVALS + """,
tr AS (SELECT eval_day, window_size, user_name, unnest([{'scope': 'peer_group', 'subject': group_id}, {'scope': 'global', 'subject': ''}], recursive := true)
  FROM win JOIN peers USING (user_name) JOIN evals ON window_start >= eval_day - 2592000000 AND window_start < eval_day WHERE window_size >= 3600)
"""


@query(o.sql("""SELECT eval_day, window_size, scope, subject, count(*) AS sample_count, count(DISTINCT user_name) AS member_count,
  CASE WHEN count(*) >= 100 AND (scope = 'global' OR count(DISTINCT user_name) >= 5) THEN 'ready' ELSE 'model_not_ready' END AS status FROM tr GROUP BY eval_day, window_size, scope, subject""", TRAINING))
def e03_model_snapshots(spark, sf_dir):
    c = chain(spark, sf_dir)
    return evaluation.model_sizes(c.windows, c.peers, *_days(c))


@query()
def e04_hbos_days(spark, sf_dir):
    c = chain(spark, sf_dir)
    return rounded(evaluation.model_day_candidates(c.windows, c.peers, *_days(c)))


READY = """,
until AS (SELECT (as_of // 86400000 + 1) * 86400000 AS e FROM newest),
rw AS (SELECT win.*, group_id FROM win JOIN peers USING (user_name), until WHERE window_size >= 3600 AND window_start >= e - 2592000000 AND window_start < e),
rg AS (SELECT 'global' AS scope, '' AS group_id, NULL::BIGINT AS configured_members UNION ALL SELECT 'peer_group', group_id, count(*) FROM peers GROUP BY ALL),
rs AS (SELECT scope, group_id, configured_members, size AS window_size FROM rg, (VALUES (3600), (86400)) s(size)),
rc AS (SELECT rs.*, (SELECT count(*) FROM rw WHERE rw.window_size = rs.window_size AND (rs.scope = 'global' OR rw.group_id = rs.group_id)) AS sample_count,
  (SELECT count(DISTINCT user_name) FROM rw WHERE rw.window_size = rs.window_size AND (rs.scope = 'global' OR rw.group_id = rs.group_id)) AS user_count,
  (SELECT count(DISTINCT window_start // 86400000) FROM rw WHERE rw.window_size = rs.window_size AND (rs.scope = 'global' OR rw.group_id = rs.group_id)) AS active_days FROM rs)
"""


@query(o.sql("""SELECT *, CASE scope WHEN 'global' THEN active_days >= 14 AND sample_count >= 20 ELSE active_days >= 14 AND sample_count >= 100 AND user_count >= 5 END AS statistical_ready,
  sample_count >= 100 AND (scope = 'global' OR user_count >= 5) AS model_ready, greatest(0, CASE scope WHEN 'global' THEN 20 ELSE 100 END - sample_count) AS missing_samples, greatest(0, 14 - active_days) AS missing_active_days,
  CASE scope WHEN 'global' THEN 0 ELSE greatest(0, 5 - user_count) END AS missing_members, greatest(0, 100 - sample_count) AS missing_model_samples FROM rc""", READY))
def e05_readiness(spark, sf_dir):
    c = chain(spark, sf_dir)
    return readiness.window_readiness(c.windows, c.peers, _until(c))


@query(o.sql("""SELECT min(t) AS first_event_ms, max(t) AS latest_event_ms, (SELECT count(DISTINCT window_start) FROM win WHERE window_size = 86400 AND window_start >= e - 2592000000 AND window_start < e) AS active_utc_days,
  e // 86400000 - min(t) // 86400000 AS calendar_span_days, (e - greatest(min(t) // 86400000 * 86400000, e - 2592000000)) // 86400000 AS observed_days,
  greatest(0, 30 - (e - greatest(min(t) // 86400000 * 86400000, e - 2592000000)) // 86400000) AS missing_days, (e - greatest(min(t) // 86400000 * 86400000, e - 2592000000)) // 86400000 >= 30 AS ready FROM ev, until GROUP BY e""", READY))
def e05_history(spark, sf_dir):
    c = chain(spark, sf_dir)
    return readiness.history(c.bounds, c.windows, _until(c))


@query(o.sql("SELECT user_name, session_id FROM sessions WHERE start_time < 1704412800000 AND last_event_time >= 1704326400000", o.SESSIONS))
def f02_session_overlap(spark, sf_dir):
    return session_ops.overlapping(chain(spark, sf_dir).sessions, 1704326400000, 1704412800000).select("user_name", "session_id")


@query(o.sql("""SELECT event_id, t AS event_time_ms, source_type, n AS event_count, n > 20 AS truncated FROM (SELECT *, count(*) OVER () AS n, row_number() OVER (ORDER BY t, event_id) AS r FROM ev
  WHERE user_name = 'user-1' AND t >= 1704067200000 AND t < 1706745600000 AND source_type IN ('svn', 'waf')) WHERE r <= 20"""))
def f16_event_evidence(spark, sf_dir):
    rows = features.event_evidence(canonical_events(spark, sf_dir), "user-1", 1704067200000, 1706745600000, source_types=("svn", "waf"))
    return rows.select("event_id", "event_time_ms", "source_type", F.col("total").alias("event_count"), "truncated")


CASED = """,
cased AS (SELECT sha256(alert_key) AS case_id, * FROM (SELECT *, row_number() OVER (PARTITION BY alert_key ORDER BY risk_score DESC, first_seen, incident_key DESC) AS best FROM risk WHERE policy_action = 'alert') WHERE best = 1)
"""


@query(o.sql("SELECT case_id, user_name, risk_score FROM cased WHERE user_name LIKE '%ser-1%' ORDER BY risk_score DESC, last_seen DESC, case_id LIMIT 10 OFFSET 10", *ALL, o.RISK, CASED, **PRINTS))
def f13_case_search(spark, sf_dir):
    made = cases.sync(cases.empty(spark), full(spark, sf_dir).alerts, 0)
    return cases.search(made, user_name="ser-1", status="new", owner=cases.UNASSIGNED, page=2, page_size=10).select("case_id", "user_name", "risk_score")


@query(o.sql('SELECT count(*) AS "new", 0 AS acknowledged, 0 AS investigating, 0 AS resolved, 0 AS false_positive, 0 AS suppressed, count(*) AS total, count(*) AS unassigned, 0 AS requires_review FROM cased', *ALL, o.RISK, CASED, **PRINTS))
def a23_case_counts(spark, sf_dir):
    return cases.counts(cases.sync(cases.empty(spark), full(spark, sf_dir).alerts, 0))


@query(o.sql("""SELECT case_id, c.incident_key, c.risk_score, c.candidate_count, list_sum(list(coalesce(m.n, 0)))::BIGINT AS event_count, string_agg(k.candidate_key, ',' ORDER BY k.window_start, -k.score, k.candidate_key) AS candidates,
  'available' AS risk_status, 'available' AS detection_status FROM cased c JOIN keyed k USING (user_name, correlation_key) LEFT JOIN (SELECT candidate_key, count(*) AS n FROM members GROUP BY ALL) m USING (candidate_key) GROUP BY ALL""", *ALL, o.RISK, CASED, **PRINTS))
def j09_investigation(spark, sf_dir):
    c = full(spark, sf_dir)
    assessed = c.kept(c.assessments.drop("timeline"))  # read five times; the timeline is not shown
    alerts = fusion.alerts(assessed)
    made = c.kept(cases.sync(cases.empty(spark), alerts, 0))
    rows = investigation.investigations(made, alerts, assessed, assessed, investigation.with_incident(c.keyed), c.evidence)
    held = F.col("candidates")
    return rows.select("case_id", "incident_key", "risk_score", F.col("incident.candidate_count").alias("candidate_count"), F.aggregate(held, F.lit(0).cast("long"), lambda s, x: s + x["event_count"]).alias("event_count"),
                       F.array_join(F.transform(held, lambda x: x["candidate_key"]), ",").alias("candidates"), "risk_status", "detection_status")


def _outcomes(spark, sf_dir, remainder: int):
    """Events as normalized events (some without an address), those of one remainder by bytes as unknown ones."""
    ev = canonical_events(spark, sf_dir)
    lost = F.pmod("network_bytes", F.lit(10)) == remainder
    named = lambda **c: F.struct(*[F.lit(v).alias(k) if isinstance(v, str) else v.alias(k) for k, v in c.items()])
    ip = F.when(F.pmod("network_bytes", F.lit(7)) > 0, F.col("source_ip"))
    good = ev.where(~lost).select(
        named(category="repository", action=F.col("action"), outcome=F.col("outcome")).alias("event"), named(name=F.col("user_name")).alias("user"), named(ip=ip).alias("source"),
        named(checksum="x", storage_ref="y", source_type=F.col("source_type")).alias("raw"), named(id=F.col("source_type"), confidence=F.round(F.pmod("network_bytes", F.lit(101)) / 100, 2)).alias("parser"),
    )
    errors = F.when(F.col("source_ip").endswith(".1"), F.array(F.lit("event.id is required"))).otherwise(F.array().cast("array<string>"))
    return good, ev.where(lost).select("source_type", F.lit("no_parser").alias("reason"), F.col("resource_name").alias("template_hint"), errors.alias("schema_errors"))


SPLIT = """,
good AS (SELECT *, round(bytes % 101 / 100, 2) AS conf, bytes % 7 > 0 AS has_ip FROM ev WHERE bytes % 10 <> {rem}), lost AS (SELECT * FROM ev WHERE bytes % 10 = {rem})
"""
RATES = """SELECT g.n AS normalized_records, u.n AS unknown_records, g.n + u.n AS total_records, round(g.n / (g.n + u.n), 6) AS parse_success_rate, parser_confidence_avg, parser_confidence_min, parser_confidence_p50, missing_required_fields_count, unknown_template_count,
  1.0::DOUBLE AS event_category, round(ip / g.n, 6) AS source_ip FROM (SELECT count(*) AS n, round(avg(CAST(conf AS DECIMAL(20, 10))), 6) AS parser_confidence_avg, min(conf) AS parser_confidence_min, list_sort(list(conf))[count(*) // 2 + 1] AS parser_confidence_p50, count(*) FILTER (has_ip) AS ip FROM good) g,
  (SELECT count(*) AS n, count(DISTINCT shown) AS unknown_template_count, count(*) FILTER (source_ip LIKE '%.1') AS missing_required_fields_count FROM lost) u"""


@query(o.sql(RATES, SPLIT.replace("{rem}", "0")))
def a17_quality(spark, sf_dir):
    keep = ("normalized_records", "unknown_records", "total_records", "parse_success_rate", "parser_confidence_avg", "parser_confidence_min", "parser_confidence_p50", "missing_required_fields_count", "unknown_template_count", "event_category", "source_ip")
    return quality.summary(*_outcomes(spark, sf_dir, 0)).select(*keep)


@query(o.sql("""SELECT 'normalized' AS measure, '' AS key, count(*) AS n FROM good UNION ALL SELECT 'unknown', '', count(*) FROM lost UNION ALL SELECT 'source_type', source_type, count(*) FROM ev GROUP BY ALL UNION ALL SELECT 'parser', source_type, count(*) FROM good GROUP BY ALL
  UNION ALL SELECT 'reason', 'no_parser', count(*) FROM lost UNION ALL SELECT 'template', shown, count(*) FROM lost GROUP BY ALL UNION ALL SELECT 'missing', '', count(*) FROM lost WHERE source_ip LIKE '%.1' UNION ALL SELECT 'confidence', CAST(CAST(round(conf * 10000) AS BIGINT) AS VARCHAR), count(*) FROM good GROUP BY ALL
  UNION ALL SELECT 'present', 'source.ip', count(*) FROM good WHERE has_ip UNION ALL SELECT 'present', f, count(*) FROM good, (VALUES ('event.category'), ('event.action'), ('event.outcome'), ('user.name'), ('raw.checksum'), ('raw.storage_ref')) v(f) GROUP BY ALL""", SPLIT.replace("{rem}", "0")))
def q01_snapshot(spark, sf_dir):
    """Two halves' snapshots merged are the whole's."""
    good, lost = _outcomes(spark, sf_dir, 0)
    of = lambda even: quality.snapshot(good.where((F.col("parser.confidence") < 0.5) == even), lost.where((F.size("schema_errors") > 0) == even))
    return quality.merged(of(True), of(False))


@query(o.sql("""SELECT flag, round(delta, 6) AS delta, triggered FROM (SELECT 'parse_success_rate_drop' AS flag, round(round(b.n / e.n, 6) - round(a.n / e.n, 6), 6) AS delta, round(round(b.n / e.n, 6) - round(a.n / e.n, 6), 6) >= 0.1 AS triggered
    FROM (SELECT count(*) FILTER (bytes % 10 <> 0) AS n FROM ev) b, (SELECT count(*) FILTER (bytes % 10 <> 3) AS n FROM ev) a, (SELECT count(*) AS n FROM ev) e
  UNION ALL SELECT 'unknown_template_count_spike', a.n - b.n, a.n - b.n >= 3 AND a.n >= 2 * b.n FROM (SELECT count(DISTINCT shown) AS n FROM ev WHERE bytes % 10 = 0) b, (SELECT count(DISTINCT shown) AS n FROM ev WHERE bytes % 10 = 3) a)"""))
def q02_drift(spark, sf_dir):
    before, after = (quality.summary(*_outcomes(spark, sf_dir, r)) for r in (0, 3))
    return rounded(quality.drift(before, after).where("flag IN ('parse_success_rate_drop', 'unknown_template_count_spike')"))


def _lines(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), F.posexplode(F.split("text", "\n")))
    return rows.select("path", (F.col("pos") + 1).alias("line"), F.col("col").alias("text"))


@query(r"""SELECT path, line AS line_start, CAST(row_number() OVER (PARTITION BY path ORDER BY line) AS INT) AS record_index, text AS raw_text
  FROM (SELECT CAST(doc_id AS VARCHAR) AS path, unnest(string_split(text, chr(10))) AS text, CAST(unnest(range(1, len(string_split(text, chr(10))) + 1)) AS INT) AS line FROM documents) WHERE regexp_matches(text, '[^ \t\n\x0b\f\r]')""")
def s03_line_records(spark, sf_dir):
    return files.line_records(_lines(spark, sf_dir)).select("path", "line_start", "record_index", "raw_text")


@query(o.sql("SELECT event_id, 'fmt_' || left(sha256(source_type || '-main:' || source_type || ':' || action || '::'), 16) AS fingerprint FROM ev"))
def p18_fingerprints(spark, sf_dir):
    none = F.lit(None).cast("string")
    return canonical_events(spark, sf_dir).select("event_id", registry.format_fingerprint(F.col("source_id"), F.col("source_type"), F.col("action"), none, none).alias("fingerprint"))


#: A parser in shadow over the events' own properties.
SHADOW = {"parser_id": "props", "status": "shadow", "parser_type": "regex", "field_extractors": {"pattern": '"k": ?(?P<k>[0-9]+)'}, "field_candidates": {"k": "7"}, "schema_mapping": {"k": "resource.id"}}


@query("""SELECT count(*) AS replay_record_count, count(*) FILTER (k = '7') AS matched_count, count(*) FILTER (k <> '7') AS unmatched_count, round(count(*) FILTER (k = '7') / count(*), 6) AS success_rate, 1.0::DOUBLE AS schema_mapping_rate
  FROM (SELECT regexp_extract(props, '"k": ?([0-9]+)', 1) AS k FROM events)""")
def l04_shadow_replay(spark, sf_dir):
    rows = read(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("unknown_id"), F.col("event_id").cast("string").alias("record_id"), F.col("props").alias("raw_text"))
    return registry.shadow_report(registry.shadow_replay(rows, SHADOW), SHADOW)
