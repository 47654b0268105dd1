"""Scenarios on small event tables."""

import random

import pytest

from vigil.operators import baseline, features, sessions

HOUR = 3_600_000
T0 = 1_767_225_600_000  # 2026-01-01
SCHEMA = "event_id string, event_time_ms long, user_name string, source_type string, source_id string, action string, outcome string, source_ip string, resource_type string, resource_name string, resource_key string, resource_display string, network_bytes long"


def event(i, t, user="ana", source="sso", action="repo_read", ip="10.0.0.1", resource="core", size=1, outcome="success"):
    return (i, T0 + t, user, source, f"{source}-main", action, outcome, ip, "git_repo", resource, f"git_repo:{resource}", resource, size)


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_two_sources_in_an_hour(spark):
    ev = frame(spark, [event("a", 9 * HOUR + 1000, size=5), event("b", 9 * HOUR + 300_000, source="svn", ip="10.0.0.2", action="repo_write", size=7, outcome="Failure")])
    (w,) = features.user_windows(ev).where("window_size = 3600").collect()
    assert (w.event_count, w.source_type_distinct_count, w.source_ip_distinct_count, w.action_distinct_count, w.resource_distinct_count) == (2, 2, 2, 2, 1)
    assert (w.network_bytes_total, w.success_count, w.failure_count, w.read_action_count, w.write_action_count) == (12, 1, 1, 1, 1)
    assert (w.first_seen_ip_count, w.first_seen_resource_count, w.first_seen_action_count) == (2, 1, 2)
    assert w.window_end - w.window_start == HOUR and w.window_start == T0 + 9 * HOUR


def test_late_first_sighting_moves(spark):
    rows = [event("a", 10 * HOUR), event("b", 9 * HOUR)]
    for order in (rows, rows[::-1]):
        got = {w.window_start: w.first_seen_ip_count for w in features.user_windows(frame(spark, order)).where("window_size = 3600").collect()}
        assert got == {T0 + 9 * HOUR: 1, T0 + 10 * HOUR: 0}


def test_windows_before_1970(spark):
    ev = frame(spark, [event("a", -T0 - 1)])
    assert features.user_windows(ev).where("window_size = 60").first().window_start == -60_000


def test_byte_overflow_fails_the_job(spark):
    with pytest.raises(Exception, match="(?i)overflow"):
        features.user_windows(frame(spark, [event("a", 0, size=2**63 - 2), event("b", 1, size=10)])).collect()


def plain_sessions(times, gap):
    out = []
    for t in sorted(times):
        if out and t - out[-1][-1] <= gap:
            out[-1].append(t)
        else:
            out.append([t])
    return [(s[0], s[-1], len(s)) for s in out]


@pytest.mark.parametrize("seed", range(3))
def test_sessions_in_any_order(spark, seed):
    r = random.Random(seed)
    times = {r.randrange(0, 4 * 86_400_000, 1000) for _ in range(250)} | {86_400_000 - 1000, 86_400_000 + 1_799_000}
    rows = [event(f"e{t}", t, action="a" if t % 2 else "b", ip=f"10.0.0.{t % 90}") for t in times]
    r.shuffle(rows)
    got = sessions.sessions(frame(spark, rows)).collect()
    assert sorted((s.start_time - T0, s.last_event_time - T0, s.event_count) for s in got) == plain_sessions(times, 1_800_000)
    for s in got:
        assert s.first_actions[0].time_ms == s.start_time and s.last_actions[-1].time_ms == s.last_event_time
        assert len(s.source_ip_samples) <= 64 and list(s.source_ip_samples) == sorted(s.source_ip_samples)


def test_session_gap_is_inclusive_and_bridges_merge(spark):
    assert sessions.sessions(frame(spark, [event("a", 0), event("b", 1_800_000)])).count() == 1
    assert sessions.sessions(frame(spark, [event("a", 0), event("b", 1_800_001)])).count() == 2
    bridge = [event("a", 0), event("b", 31 * 60_000), event("c", 29 * 60_000)]
    one = {tuple(sessions.sessions(frame(spark, order)).select("session_id", "event_count").collect()) for order in (bridge, bridge[::-1])}
    assert len(one) == 1 and next(iter(one))[0].event_count == 3


def test_watermark_is_strict(spark):
    s = sessions.sessions(frame(spark, [event("a", 0)]))
    assert sessions.closed(s, T0 + 1_800_000).first().status == "provisional"
    assert sessions.closed(s, T0 + 1_800_001).first().status == "closed"


CANONICAL = "event struct<id:string,time:string,action:string,outcome:string>, user struct<name:string>, source struct<ip:string>, resource struct<type:string,id:string,name:string>, network struct<bytes:long>, raw struct<source_type:string,source_id:string>"


def canonical(id="a", time="2026-01-01T09:00:00Z", user="ana", action="x", source="sso", size=None, resource=("git_repo", "core", None)):
    return ((id, time, action, "success"), (user,), ("",), resource, (size,), (source, "main"))


def test_admission(spark):
    rows = [canonical(), canonical("b", user=""), canonical("c", time="yesterday"), canonical("d", time=None, user=None), canonical("e", size=-1), canonical("f", resource=(None, None, None)), canonical("g", resource=(None, None, "n")), canonical("h", time="2026-01-01T10:00:00.5+01:00"), canonical("i", time="2026-01-01 09:00:00")]
    got = {r.event_id: r for r in features.admit(spark.createDataFrame(rows, CANONICAL)).collect()}
    assert {k: v.reason for k, v in got.items()} == {"a": None, "b": "missing_user_name", "c": "invalid_event_time", "d": "missing_event_time", "e": "network.bytes must be a non-negative int64", "f": None, "g": None, "h": None, "i": None}
    assert (got["a"].event_time_ms, got["h"].event_time_ms, got["i"].event_time_ms) == (T0 + 9 * HOUR, T0 + 9 * HOUR + 500, T0 + 9 * HOUR)
    assert (got["a"].resource_key, got["f"].resource_key, got["g"].resource_key, got["a"].source_ip) == ("git_repo:core", None, "<unknown_type>:n", None)


def test_accepted_once(spark):
    fields = features.admit(spark.createDataFrame([canonical(), canonical(), canonical("b", user="")], CANONICAL))
    assert [r.event_id for r in features.accepted(fields).collect()] == ["a"]
    assert features.accepted(fields, spark.createDataFrame([("a",)], "event_id string")).count() == 0


def plain_percentile(values, p):
    values = sorted(values)
    at = p * (len(values) - 1)
    lo = int(at)
    hi = min(lo + 1, len(values) - 1)
    return values[lo] + (values[hi] - values[lo]) * (at - lo)


def test_large_statistics_against_plain(spark):
    r = random.Random(1)
    data = {"a": [float(r.choice([0, 1, 1, 2, 5, 900])) for _ in range(301)], "b": [r.random() * 1e6 for _ in range(50)], "c": [7.0], "d": [0.0] * 9}
    rows = spark.createDataFrame([(k, v, n) for k, vs in data.items() for v, n in [(v, 1) for v in vs]], "k string, value double, n long")
    for f in (baseline.large_statistics, baseline.statistics):
        got = {x.k: x for x in f(rows, ["k"]).collect()}
        for k, vs in data.items():
            mean = sum(vs) / len(vs)
            p50 = plain_percentile(vs, 0.5)
            want = (len(vs), mean, (sum((v - mean) ** 2 for v in vs) / len(vs)) ** 0.5, min(vs), max(vs), p50, plain_percentile(vs, 0.95), plain_percentile(vs, 0.99), plain_percentile([abs(v - p50) for v in vs], 0.5))
            x = got[k]
            assert (x.sample_count, x.mean, x.std, x.min, x.max, x.p50, x.p95, x.p99, x.mad) == pytest.approx(want, rel=1e-9, abs=1e-9)
