"""Anomaly candidates from baselines and rules, and their evidence."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..settings import DETECTION, EVIDENCE_LIMIT, METRICS
from . import rules as rule_ops
from .features import by_window

SIZES = (3600, 86400)
COLUMNS = (
    "candidate_key", "user_name", "window_size", "window_start", "window_end", "detector_family", "detector_id", "detector_version", "detector_mode", "metric", "value_type", "value_key", "score", "severity",
    "baseline_scope", "group_id", "event_id",
)


def severity(score: Column) -> Column:
    return F.when(score >= 80, "high").when(score >= 60, "medium").otherwise("low")


def key_of(*parts: str | Column) -> Column:
    """SHA-256 of the parts joined by colons, nulls as empty."""
    return F.sha2(F.concat_ws(":", *[F.coalesce((F.col(p) if isinstance(p, str) else p).cast("string"), F.lit("")) for p in parts]), 256)


def scopes(windows: DataFrame, personal: DataFrame, groups: DataFrame, peers: DataFrame) -> DataFrame:
    """windows with group_id, scope (personal, peer_group, global or null), subject (whose baseline it is) and limits
    (p95 and p99 of each metric there).

    The first of the three baselines that is ready counts. Users' and groups' rows are joined by user and size.
    """
    limits = F.transform("stats", lambda x: F.struct(x["metric"].alias("metric"), x["p95"].alias("p95"), x["p99"].alias("p99")))
    ready = lambda df, *keys: df.where("status = 'ready'").select(*keys, "window_size")
    user = ready(personal.withColumn("_user", limits), "user_name", "_user")
    group = ready(groups.where("scope = 'peer_group'").withColumn("_group", limits), F.col("subject").alias("group_id"), "_group")
    whole = ready(groups.where("scope = 'global'").withColumn("_whole", limits), "_whole")
    rows = windows.join(peers.select("user_name", "group_id"), "user_name", "left").join(user, ["user_name", "window_size"], "left")
    rows = rows.join(group, ["group_id", "window_size"], "left").join(F.broadcast(whole), "window_size", "left")  # a row a size
    scope = F.when(F.col("_user").isNotNull(), "personal").when(F.col("_group").isNotNull(), "peer_group").when(F.col("_whole").isNotNull(), "global")
    subject = F.when(scope == "personal", F.col("user_name")).when(scope == "peer_group", F.col("group_id")).otherwise("")
    return rows.withColumns({"scope": scope, "subject": subject, "limits": F.coalesce("_user", "_group", "_whole")}).drop("_user", "_group", "_whole")


def window_policy(windows: DataFrame, values: DataFrame, overrides: dict[str, dict] | None = None, defaults: dict = DETECTION) -> DataFrame:
    """windows with policy: the defaults, updated by the override of the first (by name) source type that has one."""
    names = [*defaults]
    kind = lambda v: "double" if isinstance(v, float) else "int"
    made = lambda p: F.struct(*[F.lit(p[n]).cast(kind(defaults[n])).alias(n) for n in names])
    if not overrides:
        return windows.withColumns({"policy": made(defaults), "policy_id": F.lit("default")})
    keys = ["user_name", "window_size", "window_start"]
    first = values.where((F.col("value_type") == "source_type") & F.col("value_key").isin(*overrides)).groupBy(*keys).agg(F.min("value_key").alias("_by"))
    rows = windows.join(first, keys, "left")
    policy = made(defaults)
    for name, change in overrides.items():
        policy = F.when(F.col("_by") == name, made({**defaults, **change})).otherwise(policy)
    return rows.withColumns({"policy": policy, "policy_id": F.coalesce(F.concat(F.lit("source_type:"), F.col("_by")), F.lit("default"))}).drop("_by")


def _candidate(rows: DataFrame, detector: Column, score: Column) -> DataFrame:
    rows = rows.withColumns({"detector_id": detector, "score": score})
    for c in ("metric", "value_type", "value_key"):
        if c not in rows.columns:
            rows = rows.withColumn(c, F.lit(None).cast("string"))
    key = key_of("user_name", "window_size", "window_start", "detector_id", "metric", "value_type", "value_key")
    fixed = {"candidate_key": key, "detector_family": F.lit("statistical"), "detector_version": F.lit("1"), "detector_mode": F.lit("active"), "severity": severity(F.col("score")), "baseline_scope": F.col("scope"), "event_id": F.lit(None).cast("string")}
    return rows.withColumns(fixed).withColumn("group_id", F.when(F.col("scope") == "peer_group", F.col("group_id"))).select(*COLUMNS)


def numeric_candidates(scoped: DataFrame) -> DataFrame:
    """numeric_p99 or numeric_p95 of every metric that lies above its scope's percentile (strictly). A window's metrics
    are compared in place; only those that lie above become rows."""
    limit = lambda i, p: F.get("limits", F.lit(i))[p]
    value = lambda m: F.col(m).cast("double")
    above = lambda i, m: F.when(value(m) > limit(i, "p99"), "numeric_p99").when(value(m) > limit(i, "p95"), "numeric_p95")
    hits = F.array(*[F.when(above(i, m).isNotNull(), F.struct(limit(i, "metric").alias("metric"), above(i, m).alias("d"))) for i, m in enumerate(METRICS)])  # no lambda: those are not compiled
    rows = scoped.withColumn("_hit", F.explode(hits)).where("_hit IS NOT NULL").withColumn("metric", F.col("_hit.metric"))
    return _candidate(rows, F.col("_hit.d"), F.when(F.col("_hit.d") == "numeric_p99", F.col("policy.p99_score")).otherwise(F.col("policy.p95_score")))


def value_candidates(scoped: DataFrame, values: DataFrame, own_values: DataFrame | None, group_values: DataFrame | None) -> DataFrame:
    """new_value_30d where a value's first sighting is this window, rare_value where its share and count are low.

    Values of users with baselines of their own (own_values: those of scope personal) are looked up by user; only the
    others meet those of groups and everyone (group_values). With None in the place of either, the rows of the other alone.
    """
    keys = ["user_name", "window_size", "window_start"]
    own = scoped.where(F.col("scope").isNotNull()).select(*keys, "window_end", "scope", "subject", "group_id", "policy")
    known = lambda df, *subject: df.select(*subject, "value_type", "value_key", "first_seen", "share", F.col("event_count").alias("known_count"))
    held = lambda scope, df, *subject: own.where(scope).join(values.select(*keys, "value_type", "value_key"), keys).join(df, [*subject, "value_type", "value_key"])
    found = []
    if own_values is not None:  # sides that are dealt by user stay so
        found.append(held("scope = 'personal'", known(own_values.where("scope = 'personal'"), F.col("subject").alias("user_name")), "user_name"))
    if group_values is not None:
        found.append(held("scope <> 'personal'", known(group_values.where("scope <> 'personal'"), "scope", "subject"), "scope", "subject"))
    rows = found[0] if len(found) == 1 else found[0].unionByName(found[1])
    new = F.when(F.col("first_seen") == F.col("window_start"), F.struct(F.lit("new_value_30d").alias("d"), F.col("policy.new_value_score").alias("s")))
    rare = F.when((F.col("share") <= F.col("policy.rare_share_threshold")) & (F.col("known_count") <= F.col("policy.rare_event_count_max")), F.struct(F.lit("rare_value").alias("d"), F.col("policy.rare_value_score").alias("s")))
    rows = rows.withColumn("_hit", F.explode(F.array(new, rare))).where("_hit IS NOT NULL")
    return _candidate(rows, F.col("_hit.d"), F.col("_hit.s"))


def rule_candidates(events: DataFrame, windows: DataFrame, values: DataFrame, rules: list[dict[str, Any]]) -> DataFrame:
    """Candidates of shadow and active rules: an event for itself, a window for its size."""
    live = [r for r in rules if r["status"] in ("shadow", "active")]
    fixed = lambda rows: rows.select(
        "candidate_key", "user_name", "window_size", "window_start", "window_end", F.lit("rule").alias("detector_family"), F.col("rule.rule_id").alias("detector_id"), F.col("rule.version").cast("string").alias("detector_version"), F.col("rule.mode").alias("detector_mode"),
        *[F.lit(None).cast("string").alias(c) for c in ("metric", "value_type", "value_key")], F.col("rule.score").alias("score"), severity(F.col("rule.score")).alias("severity"), F.lit(None).cast("string").alias("baseline_scope"), F.lit(None).cast("string").alias("group_id"), "event_id",
    )
    one = rule_ops.matches(events, [r for r in live if r["scope"] == "event"], rule_ops.event_fields(events.columns), F.array("source_type"))
    one = one.withColumns({"window_size": F.lit(0), "window_start": F.col("event_time_ms"), "window_end": F.col("event_time_ms") + 1, "candidate_key": key_of(F.lit("rule:event"), "rule.rule_id", "rule.version", "rule.fingerprint", "event_id")})
    keys = ["user_name", "window_size", "window_start"]
    many = [r for r in live if r["scope"] == "window"]
    rows = windows.where(F.col("window_size").isin(*[r["window_size"] for r in many] or [-1]))
    kinds = values.where("value_type = 'source_type'").groupBy(*keys).agg(F.collect_list("value_key").alias("source_types"))  # a window's source types
    rows = rows.join(kinds, keys, "left")
    rows = rule_ops.matches(rows, many, rule_ops.window_fields(), F.col("source_types"))
    rows = rows.withColumns({"event_id": F.lit(None).cast("string"), "candidate_key": key_of(F.lit("rule:window"), "rule.rule_id", "rule.version", "rule.fingerprint", *keys)})
    return fixed(one).unionByName(fixed(rows))


ITEMS = ("event_time_ms", "event_id", "source_type", "source_ip", "resource_type", "resource_name")
PARTS = 16


def window_evidence(windows: DataFrame, events: DataFrame, sizes: tuple[int, ...], limit: int = EVIDENCE_LIMIT) -> DataFrame:
    """user_name, window_size, window_start, event_count and evidence, the first limit events (time, id), of the windows.

    A window's events are found by its own key, derived from each event's time and size: no range join. Events are
    ranked in PARTS of a window, of which limit each go on, so that no window is gathered.
    """
    keys = ["user_name", "window_size", "window_start"]
    member = by_window(events.select("user_name", *ITEMS), sizes).join(windows.select(*keys).distinct(), keys)
    part = Window.partitionBy(*keys, "_part")
    rows = member.withColumn("_part", F.pmod(F.xxhash64("event_id"), F.lit(PARTS)))
    rows = rows.withColumns({"_i": F.row_number().over(part.orderBy("event_time_ms", "event_id")), "_n": F.count(F.lit(1)).over(part)}).where(F.col("_i") <= limit)
    tops = rows.groupBy(*keys).agg(F.sum(F.when(F.col("_i") == 1, F.col("_n"))).alias("event_count"), F.array_sort(F.collect_list(F.struct(*ITEMS))).alias("_e"))
    numbered = F.transform(F.slice("_e", 1, limit), lambda x, i: F.struct((i + 1).alias("evidence_order"), *[x[c].alias(c) for c in ITEMS]))
    return tops.select(*keys, "event_count", numbered.alias("evidence"))


def event_items(candidates: DataFrame, events: DataFrame) -> DataFrame:
    """user_name, candidate_key and evidence of the candidates that are an event."""
    one = candidates.where("event_id IS NOT NULL").select("user_name", "candidate_key", "event_id").join(events.select("user_name", *ITEMS), ["user_name", "event_id"])
    return one.select("user_name", "candidate_key", F.array(F.struct(F.lit(1).alias("evidence_order"), *ITEMS)).alias("evidence"))


def evidence(candidates: DataFrame, tops: DataFrame, own: DataFrame, limit: int = EVIDENCE_LIMIT) -> DataFrame:
    """user_name, candidate_key, event_count, truncated and evidence of each candidate, from those of windows (tops) and of single
    events (own). Windows are looked through once, however many candidates they have."""
    keys = ["user_name", "window_size", "window_start"]
    many = candidates.where("window_size > 0").select("candidate_key", *keys).join(tops, keys).select("user_name", "candidate_key", "event_count", (F.col("event_count") > limit).alias("truncated"), "evidence")
    return many.unionByName(own.select("user_name", "candidate_key", F.lit(1).cast("long").alias("event_count"), F.lit(False).alias("truncated"), "evidence"))


def reported(candidates: DataFrame, limit: int | None = None) -> DataFrame:
    """Candidates in the order of a report: by score, then latest window, then key; the first limit of them, if given."""
    rows = candidates.orderBy(F.col("score").desc(), F.col("window_start").desc(), "candidate_key")
    return rows if limit is None else rows.limit(limit)


def first_versions(found: DataFrame, revision: int) -> DataFrame:
    """What superseded starts from: all that a first run found."""
    return found.withColumns({"candidate_id": key_of("candidate_key", F.lit(revision)), "revision": F.lit(revision).cast("long"), "status": F.lit("active"), "supersedes": F.lit(None).cast("string")})


def superseded(previous: DataFrame, found: DataFrame, revision: int, touched: DataFrame | None = None) -> DataFrame:
    """The next versions of candidates: previous (candidate_key, candidate_id, revision, status, supersedes, ...) with what
    a run at revision found.

    touched (user_name, window_size, window_start) are the windows that the run looked at again, null all of them: what
    was active in them and older is superseded. What is found is active, under a new id that names the last version of
    its key; a run that comes again at a revision finds its versions there and only makes them active.
    """
    keys = ["user_name", "window_size", "window_start"]
    old = previous.withColumn("_again", F.lit(True)) if touched is None else previous.join(touched.select(*keys).distinct().withColumn("_again", F.lit(True)), keys, "left")
    ids = found.select(key_of("candidate_key", F.lit(revision)).alias("candidate_id"), F.lit(True).alias("_found"))
    again = F.coalesce("_again", F.lit(False)) & (F.col("status") == "active") & (F.col("revision") < revision)
    status = F.when(F.col("_found"), "active").when(again, "superseded").otherwise(F.col("status"))
    old = old.join(ids, "candidate_id", "left").withColumn("status", status).select(*previous.columns)
    last = previous.where(F.col("revision") < revision).groupBy("candidate_key").agg(F.max_by("candidate_id", "revision").alias("supersedes"))
    new = first_versions(found, revision).drop("supersedes").join(previous.select("candidate_id"), "candidate_id", "left_anti").join(last, "candidate_key", "left")
    return old.unionByName(new.select(*previous.columns))
