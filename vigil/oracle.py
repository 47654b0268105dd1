"""SQL for DuckDB that says what the queries return, written apart from the operators."""

EV = """
ev AS (SELECT 'evt-' || event_id AS event_id, epoch_us(ts) // 1000 AS t, 'user-' || user_id AS user_name, user_id % 3 AS peer,
  CASE event_type WHEN 'signup' THEN 'sso' WHEN 'error' THEN 'waf' WHEN 'purchase' THEN 'gitlab' ELSE 'svn' END AS source_type,
  CASE event_type WHEN 'view' THEN 'repo_read' WHEN 'click' THEN 'repo_clone' WHEN 'purchase' THEN 'repo_write' WHEN 'signup' THEN 'user_login' ELSE 'repo_status' END AS action,
  CASE event_type WHEN 'error' THEN 'failure' WHEN 'signup' THEN 'unknown' ELSE 'success' END AS outcome,
  '10.0.' || (user_id % 256) || '.' || (k % 4) AS source_ip, 'page:res-' || k AS resource, 'res-' || k AS shown, CAST(floor(value * 100) AS BIGINT) AS bytes
  FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k FROM events)),
sized AS (SELECT ev.*, size AS window_size, t - t % (size * 1000) AS window_start FROM ev, (VALUES (60), (300), (3600), (86400)) s(size)),
vals AS (SELECT user_name, event_id, t, u.value_type, u.value_key, u.shown FROM (SELECT *, unnest([
    {'value_type': 'source_type', 'value_key': source_type, 'shown': source_type}, {'value_type': 'action', 'value_key': action, 'shown': action},
    {'value_type': 'source_ip', 'value_key': source_ip, 'shown': source_ip}, {'value_type': 'resource', 'value_key': resource, 'shown': shown}]) AS u FROM ev)),
wv AS (SELECT user_name, size AS window_size, t - t % (size * 1000) AS window_start, value_type, value_key, count(*) AS event_count, max(shown) AS display_value
  FROM vals, (VALUES (60), (300), (3600), (86400)) s(size) GROUP BY ALL),
firsts AS (SELECT user_name, value_type, value_key, min(t) AS t FROM vals WHERE value_type <> 'source_type' GROUP BY ALL),
fw AS (SELECT user_name, size AS window_size, t - t % (size * 1000) AS window_start, count(*) FILTER (value_type = 'source_ip') AS ip, count(*) FILTER (value_type = 'resource') AS res, count(*) FILTER (value_type = 'action') AS act
  FROM firsts, (VALUES (60), (300), (3600), (86400)) s(size) GROUP BY ALL),
w0 AS (SELECT user_name, window_size, window_start, count(*) AS event_count, count(*) FILTER (outcome = 'success') AS success_count, count(*) FILTER (outcome = 'failure') AS failure_count,
  count(*) FILTER (outcome NOT IN ('success', 'failure')) AS other_outcome_count, count(DISTINCT source_type) AS source_type_distinct_count, count(DISTINCT source_ip) AS source_ip_distinct_count,
  count(DISTINCT resource) AS resource_distinct_count, count(DISTINCT action) AS action_distinct_count, count(*) FILTER (action IN ('repo_read', 'repo_clone')) AS read_action_count,
  count(*) FILTER (action = 'repo_write') AS write_action_count, CAST(sum(bytes) AS BIGINT) AS network_bytes_total FROM sized GROUP BY ALL),
win AS MATERIALIZED (SELECT w0.user_name, w0.window_size, w0.window_start, w0.window_start + w0.window_size * 1000 AS window_end, w0.* EXCLUDE (user_name, window_size, window_start),
  coalesce(ip, 0) AS first_seen_ip_count, coalesce(res, 0) AS first_seen_resource_count, coalesce(act, 0) AS first_seen_action_count FROM w0 LEFT JOIN fw USING (user_name, window_size, window_start)),
bounds AS (SELECT user_name, min(t) AS a, max(t) AS b FROM ev GROUP BY ALL),
newest AS (SELECT max(t) AS as_of FROM ev),
peers AS (SELECT DISTINCT user_name, 'g' || peer AS group_id FROM ev)
"""

SESSIONS = """,
gaps AS (SELECT *, CASE WHEN t - lag(t) OVER o <= 1800000 THEN 0 ELSE 1 END AS opens FROM ev WINDOW o AS (PARTITION BY user_name ORDER BY t, event_id)),
numbered AS (SELECT *, sum(opens) OVER (PARTITION BY user_name ORDER BY t, event_id) AS s FROM gaps),
sess AS (SELECT user_name, min(t) AS start_time, arg_min(event_id, (t, event_id)) AS first_event_id, max(t) AS last_event_time, arg_max(event_id, (t, event_id)) AS last_event_id, count(*) AS event_count,
  list_sort(list(DISTINCT source_type)) AS source_types, list_sort(list(DISTINCT source_ip)) AS source_ips, list_sort(list(DISTINCT shown)) AS resources, list(action ORDER BY t, event_id) AS actions
  FROM numbered GROUP BY user_name, s),
sessions AS MATERIALIZED (SELECT *, sha256(user_name || ':' || start_time || ':' || first_event_id) AS session_id FROM sess)
"""

METRICS = """,
long AS (UNPIVOT (SELECT user_name, window_size, window_start, CAST(COLUMNS(* EXCLUDE (user_name, window_size, window_start, window_end)) AS DOUBLE) FROM win WHERE window_size >= 3600)
  ON COLUMNS(* EXCLUDE (user_name, window_size, window_start)) INTO NAME metric VALUE v),
spans AS (SELECT user_name, greatest(as_of - 2592000000, a) AS f, least(as_of, b) AS l FROM bounds, newest),
slots AS (SELECT user_name, size AS window_size, unnest(generate_series(f - f % (size * 1000), l - l % (size * 1000), size * 1000)) AS window_start FROM spans, (VALUES (3600), (86400)) s(size)),
filled AS (SELECT s.user_name, s.window_size, s.window_start, m.metric, coalesce(l.v, 0) AS v, l.v IS NOT NULL AS seen FROM slots s CROSS JOIN (SELECT DISTINCT metric FROM long) m LEFT JOIN long l USING (user_name, window_size, window_start, metric)),
stat0 AS (SELECT user_name, window_size, metric, count(*) AS sample_count, avg(v) AS mean, stddev_pop(v) AS std, min(v) AS min, max(v) AS max, quantile_cont(v, 0.5) AS p50, quantile_cont(v, 0.95) AS p95, quantile_cont(v, 0.99) AS p99, mad(v) AS mad,
  count(DISTINCT CASE WHEN seen THEN window_start // 86400000 END) AS active_days FROM filled GROUP BY ALL),
personal AS (SELECT *, CASE WHEN active_days >= {days} AND sample_count >= 20 THEN 'ready' ELSE 'warming_up' END AS status FROM stat0),
hist AS (SELECT long.* FROM long, newest WHERE window_start >= as_of - 2592000000 AND window_start <= as_of),
whole AS (SELECT window_size, metric, count(*) AS sample_count, avg(v) AS mean, stddev_pop(v) AS std, min(v) AS min, max(v) AS max, quantile_cont(v, 0.5) AS p50, quantile_cont(v, 0.95) AS p95, quantile_cont(v, 0.99) AS p99, mad(v) AS mad,
  count(DISTINCT window_start // 86400000) AS active_days, CASE WHEN count(DISTINCT window_start // 86400000) >= {days} AND count(*) >= 20 THEN 'ready' ELSE 'warming_up' END AS status FROM hist GROUP BY ALL),
peer AS (SELECT group_id, window_size, metric, count(*) AS sample_count, avg(v) AS mean, stddev_pop(v) AS std, min(v) AS min, max(v) AS max, quantile_cont(v, 0.5) AS p50, quantile_cont(v, 0.95) AS p95, quantile_cont(v, 0.99) AS p99, mad(v) AS mad,
  count(DISTINCT window_start // 86400000) AS active_days, count(DISTINCT user_name) AS member_count,
  CASE WHEN count(DISTINCT user_name) >= 5 AND count(DISTINCT window_start // 86400000) >= 14 AND count(*) >= 100 THEN 'ready' ELSE 'warming_up' END AS status FROM hist JOIN peers USING (user_name) GROUP BY ALL)
"""

VALUES = """,
pv0 AS (SELECT user_name, value_type, value_key, max(display_value) AS display_value, CAST(sum(event_count) AS BIGINT) AS event_count, count(*) AS window_count, min(window_start) AS first_seen, max(window_start) AS last_seen
  FROM wv JOIN spans USING (user_name) WHERE window_size = 3600 AND window_start >= f AND window_start <= l GROUP BY ALL),
pv AS (SELECT *, event_count / sum(event_count) OVER (PARTITION BY user_name, value_type) AS share FROM pv0),
hv AS (SELECT wv.* FROM wv, newest WHERE window_size = 3600 AND window_start >= as_of - 2592000000 AND window_start <= as_of),
gv0 AS (SELECT value_type, value_key, max(display_value) AS display_value, CAST(sum(event_count) AS BIGINT) AS event_count, count(*) AS window_count, count(DISTINCT user_name) AS user_count, min(window_start) AS first_seen, max(window_start) AS last_seen FROM hv GROUP BY ALL),
gv AS (SELECT *, event_count / sum(event_count) OVER (PARTITION BY value_type) AS share FROM gv0),
rv0 AS (SELECT group_id, value_type, value_key, max(display_value) AS display_value, CAST(sum(event_count) AS BIGINT) AS event_count, count(*) AS window_count, count(DISTINCT user_name) AS user_count, min(window_start) AS first_seen, max(window_start) AS last_seen FROM hv JOIN peers USING (user_name) GROUP BY ALL),
rv AS (SELECT *, event_count / sum(event_count) OVER (PARTITION BY group_id, value_type) AS share FROM rv0)
"""

SCOPED = """,
readyp AS (SELECT user_name, window_size FROM personal WHERE metric = 'event_count' AND status = 'ready'),
readyr AS (SELECT group_id, window_size FROM peer WHERE metric = 'event_count' AND status = 'ready'),
readyg AS (SELECT window_size FROM whole WHERE metric = 'event_count' AND status = 'ready'),
scoped AS MATERIALIZED (SELECT win.*, p.group_id, CASE WHEN (user_name, window_size) IN (SELECT (user_name, window_size) FROM readyp) THEN 'personal'
    WHEN (p.group_id, window_size) IN (SELECT (group_id, window_size) FROM readyr) THEN 'peer_group' WHEN window_size IN (SELECT window_size FROM readyg) THEN 'global' END AS scope,
  svn FROM win LEFT JOIN (SELECT DISTINCT user_name, window_size, window_start, 'svn' AS svn FROM wv WHERE value_type = 'source_type' AND value_key = 'svn') USING (user_name, window_size, window_start) LEFT JOIN peers p USING (user_name) WHERE window_size >= 3600),
refs AS (SELECT 'personal' AS scope, user_name AS subject, window_size, metric, p95, p99 FROM personal UNION ALL SELECT 'peer_group', group_id, window_size, metric, p95, p99 FROM peer UNION ALL SELECT 'global', '', window_size, metric, p95, p99 FROM whole),
num AS (SELECT s.user_name, s.window_size, s.window_start, s.window_end, s.scope, CASE WHEN s.scope = 'peer_group' THEN s.group_id END AS group_id, l.metric, CASE WHEN round(l.v, 9) > round(p99, 9) THEN 'numeric_p99' ELSE 'numeric_p95' END AS detector_id
  FROM scoped s JOIN long l USING (user_name, window_size, window_start) JOIN refs r ON r.scope = s.scope AND r.subject = CASE s.scope WHEN 'personal' THEN s.user_name WHEN 'peer_group' THEN s.group_id ELSE '' END AND r.window_size = s.window_size AND r.metric = l.metric
  WHERE round(l.v, 9) > round(p95, 9)),
vrefs AS (SELECT 'personal' AS scope, user_name AS subject, value_type, value_key, first_seen, share, event_count FROM pv UNION ALL SELECT 'peer_group', group_id, value_type, value_key, first_seen, share, event_count FROM rv UNION ALL SELECT 'global', '', value_type, value_key, first_seen, share, event_count FROM gv),
met AS (SELECT s.user_name, s.window_size, s.window_start, s.window_end, s.scope, CASE WHEN s.scope = 'peer_group' THEN s.group_id END AS group_id, x.value_type, x.value_key, r.first_seen, r.share, r.event_count, s.svn
  FROM scoped s JOIN wv x USING (user_name, window_size, window_start) JOIN vrefs r ON r.scope = s.scope AND r.subject = CASE s.scope WHEN 'personal' THEN s.user_name WHEN 'peer_group' THEN s.group_id ELSE '' END AND r.value_type = x.value_type AND r.value_key = x.value_key),
valc AS (SELECT * EXCLUDE (first_seen, share, event_count, svn), 'new_value_30d' AS detector_id FROM met WHERE first_seen = window_start
  UNION ALL SELECT * EXCLUDE (first_seen, share, event_count, svn), 'rare_value' FROM met WHERE share <= CASE WHEN svn IS NULL THEN 0.01 ELSE {rare} END AND event_count <= 3)
"""

CANDIDATES = """,
cand0 AS (SELECT user_name, window_size, window_start, window_end, 'statistical' AS family, detector_id, metric, NULL AS value_type, NULL AS value_key, scope, group_id, NULL AS event_id, CASE detector_id WHEN 'numeric_p99' THEN 80 ELSE 60 END AS score FROM num
  UNION ALL SELECT user_name, window_size, window_start, window_end, 'statistical', detector_id, NULL, value_type, value_key, scope, group_id, NULL, CASE detector_id WHEN 'new_value_30d' THEN 75 ELSE 55 END FROM valc),
cand AS (SELECT *, sha256(user_name || ':' || window_size || ':' || window_start || ':' || detector_id || ':' || coalesce(metric, '') || ':' || coalesce(value_type, '') || ':' || coalesce(value_key, '')) AS candidate_key FROM cand0)
"""

RULED = """,
rulec AS (SELECT user_name, 0 AS window_size, t AS window_start, t + 1 AS window_end, 'rule' AS family, 'failed-read' AS detector_id, NULL AS metric, NULL AS value_type, NULL AS value_key, NULL AS scope, NULL AS group_id, event_id, 65 AS score,
    sha256('rule:event:failed-read:1:{event_print}:' || event_id) AS candidate_key FROM ev WHERE source_type IN ('waf', 'svn') AND outcome = 'failure' AND shown LIKE '%7'
  UNION ALL SELECT user_name, window_size, window_start, window_end, 'rule', 'busy-hour', NULL, NULL, NULL, NULL, NULL, NULL, 70, sha256('rule:window:busy-hour:2:{window_print}:' || user_name || ':' || window_size || ':' || window_start)
  FROM win WHERE window_size = 3600 AND (event_count >= 3 OR write_action_count >= 2)),
allc AS MATERIALIZED (SELECT * FROM cand UNION ALL SELECT * FROM rulec)
"""

INCIDENTS = """,
pairs AS (SELECT c.candidate_key, s.session_id, least(last_event_time + 1, window_end) - greatest(start_time, window_start) AS overlap, start_time, first_event_id
  FROM allc c JOIN sessions s ON s.user_name = c.user_name AND start_time < window_end AND last_event_time >= window_start WHERE window_size <= 3600),
best AS (SELECT candidate_key, session_id FROM (SELECT *, row_number() OVER (PARTITION BY candidate_key ORDER BY overlap DESC, start_time, first_event_id DESC) AS r FROM pairs) WHERE r = 1),
keyed AS MATERIALIZED (SELECT allc.*, session_id, CASE WHEN session_id IS NOT NULL THEN 'session:' || session_id WHEN window_size = 86400 THEN 'day:' || window_start ELSE 'bucket:' || (window_start - window_start % 3600000) END AS correlation_key FROM allc LEFT JOIN best USING (candidate_key)),
members AS (SELECT c.candidate_key, e.event_id, e.source_type, e.source_ip, 'page:' || e.shown AS resource, row_number() OVER (PARTITION BY c.candidate_key ORDER BY e.t, e.event_id) AS r
  FROM allc c JOIN ev e ON e.user_name = c.user_name AND e.t >= c.window_start AND e.t < c.window_end WHERE c.event_id IS NULL OR c.event_id = e.event_id),
top20 AS (SELECT * FROM members WHERE r <= 20),
things AS (SELECT user_name, correlation_key, 's' AS k, source_type AS v FROM top20 JOIN keyed USING (candidate_key) UNION SELECT user_name, correlation_key, 'i', source_ip FROM top20 JOIN keyed USING (candidate_key)
  UNION SELECT user_name, correlation_key, 'r', resource FROM top20 JOIN keyed USING (candidate_key)
  UNION SELECT user_name, correlation_key, 's', x.value_key FROM keyed JOIN wv x USING (user_name, window_size, window_start) WHERE x.value_type = 'source_type'
  UNION SELECT user_name, correlation_key, CASE value_type WHEN 'source_ip' THEN 'i' ELSE 'r' END, value_key FROM keyed WHERE value_type IN ('source_ip', 'resource')
  UNION SELECT k.user_name, k.correlation_key, 's', unnest(source_types) FROM keyed k JOIN sessions s ON s.session_id = k.session_id UNION SELECT k.user_name, k.correlation_key, 'i', unnest(source_ips) FROM keyed k JOIN sessions s ON s.session_id = k.session_id
  UNION SELECT k.user_name, k.correlation_key, 'r', unnest(resources) FROM keyed k JOIN sessions s ON s.session_id = k.session_id),
sets AS (SELECT user_name, correlation_key, count(*) FILTER (k = 's') AS n_sources, string_agg(v, ',' ORDER BY v) FILTER (k = 's') AS source_types, string_agg(v, ',' ORDER BY v) FILTER (k = 'i') AS source_ips, string_agg(v, ',' ORDER BY v) FILTER (k = 'r') AS resources FROM things GROUP BY ALL),
inc0 AS (SELECT user_name, correlation_key, min(window_start) AS first_seen, max(window_end) AS last_seen, count(*) AS candidate_count, count(DISTINCT family || '/' || detector_id) AS detector_count, count(DISTINCT family) AS families,
  CAST(least(100, max(score) + least(20, 5 * (count(*) - 1))) AS INT) AS aggregation_score FROM keyed GROUP BY ALL),
inc AS (SELECT inc0.*, source_types, source_ips, resources, n_sources, sha256(user_name || ':' || correlation_key) AS incident_key,
  CASE WHEN n_sources > 1 THEN 'cross_system_behavior_anomaly' WHEN families > 1 THEN 'compound_behavior_anomaly' ELSE 'user_behavior_anomaly' END AS incident_type,
  CASE WHEN aggregation_score >= 80 THEN 'high' WHEN aggregation_score >= 60 THEN 'medium' ELSE 'low' END AS severity FROM inc0 LEFT JOIN sets USING (user_name, correlation_key))
"""

RISK = """,
risk0 AS (SELECT *, CAST(least(100, aggregation_score + CASE WHEN n_sources > 1 THEN 10 ELSE 0 END + least(10, 3 * (families - 1))) AS INT) AS risk_score, first_seen // 86400000 AS day FROM inc),
risk1 AS (SELECT *, sha256(user_name || ':' || incident_type || ':' || day) AS alert_key, row_number() OVER (PARTITION BY user_name, day, risk_score >= 80 ORDER BY risk_score DESC, first_seen, incident_key) AS r FROM risk0),
risk AS (SELECT *, CASE WHEN risk_score < 80 THEN 'below_threshold' WHEN r > 3 THEN 'suppressed_budget' ELSE 'alert' END AS policy_action,
  CASE WHEN risk_score >= 90 THEN 'critical' WHEN risk_score >= 80 THEN 'high' WHEN risk_score >= 60 THEN 'medium' ELSE 'low' END AS risk_severity FROM risk1)
"""


def sql(select: str, *parts: str, days: int = 14, rare: float = 0.01, **names: str) -> str:
    """parts are the clauses after EV that select needs."""
    text = "".join(parts).replace("{days}", str(days)).replace("{rare}", str(rare))
    for k, v in names.items():
        text = text.replace(f"{{{k}}}", v)
    return f"WITH {EV}{text} {select}"
