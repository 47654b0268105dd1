"""Analyst cases: alerts merged into a snapshot, and an append-only audit that decides their state."""

from __future__ import annotations

import json
import time
import uuid
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values
STATUSES = ("new", "acknowledged", "investigating", "resolved", "false_positive", "suppressed")
TERMINAL = ("resolved", "false_positive")
SEVERITIES = ("low", "medium", "high", "critical")
UNASSIGNED = "__unassigned__"
MAX_PAGE = 200

CASE = (
    "case_id string, alert_key string, user_name string, status string, owner string, tags array<string>, risk_score int, severity string, first_seen bigint, last_seen bigint, "
    "suppression_until bigint, requires_review boolean, current_incident_key string"
)
#: detail is a JSON object.
AUDIT = "case_id string, at_ms bigint, seq string, kind string, actor string, detail string"


class CaseError(ValueError):
    pass


def _need(holds: bool, message: str) -> None:
    if not holds:
        raise CaseError(message)


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], CASE)


def _best(alerts: DataFrame) -> DataFrame:
    news = F.struct("user_name", "risk_score", "severity", "first_seen", "last_seen", "incident_key")
    return alerts.groupBy("alert_key").agg(F.max_by(news, F.struct("risk_score", -F.col("first_seen"), "incident_key")).alias("n"))


def _ended(now_ms: int) -> Column:
    return F.coalesce((F.col("status") == "suppressed") & (F.col("suppression_until") <= now_ms), F.lit(False))


def sync(cases: DataFrame, alerts: DataFrame, now_ms: int) -> DataFrame:
    """The next snapshot: new alerts make cases, known ones refresh theirs, and a finished case with news asks for
    review. Of several alerts of a key the one with most risk counts, so that a second sync changes nothing.
    Suppressions that ended are new cases again."""
    rows = cases.alias("c").join(_best(alerts), "alert_key", "full_outer")
    ended, new = _ended(now_ms), F.col("case_id").isNull()
    news = F.col("n").isNotNull() & ~F.col("n.incident_key").eqNullSafe(F.col("current_incident_key"))
    status = F.when(new | ended, "new").otherwise(F.col("status"))
    review = F.when(new, False).when(news, status.isin(*TERMINAL)).otherwise(F.col("requires_review"))
    return rows.select(
        F.coalesce("case_id", F.sha2("alert_key", 256)).alias("case_id"), "alert_key", F.coalesce("n.user_name", "c.user_name").alias("user_name"), status.alias("status"), "owner",
        F.coalesce("tags", F.array().cast("array<string>")).alias("tags"), F.coalesce("n.risk_score", "c.risk_score").alias("risk_score"), F.coalesce("n.severity", "c.severity").alias("severity"),
        F.coalesce("c.first_seen", "n.first_seen").alias("first_seen"), F.coalesce("n.last_seen", "c.last_seen").alias("last_seen"), F.when(~ended, F.col("suppression_until")).alias("suppression_until"),
        review.alias("requires_review"), F.coalesce("n.incident_key", "current_incident_key").alias("current_incident_key"),
    )


def sync_log(cases: DataFrame, alerts: DataFrame, now_ms: int) -> DataFrame:
    """What sync does, as rows of the audit log: created, risk_alert_refreshed and suppression_expired, by system."""
    rows = cases.alias("c").join(_best(alerts), "alert_key", "full_outer")
    new, ended = F.col("case_id").isNull(), _ended(now_ms)
    news = F.col("n").isNotNull() & ~new & ~F.col("n.incident_key").eqNullSafe(F.col("current_incident_key"))
    one = lambda kind, holds, **detail: F.when(holds, F.struct(F.lit(kind).alias("kind"), F.to_json(F.struct(*[v.alias(k) for k, v in detail.items()])).alias("detail")))
    review = (F.when(ended, "new").otherwise(F.col("status"))).isin(*TERMINAL)
    incident = F.col("n.incident_key")
    done = F.array_compact(F.array(
        one("suppression_expired", ended, suppression_until=F.col("suppression_until")), one("created", new, incident_key=incident),
        one("risk_alert_refreshed", news, previous_incident_key=F.col("current_incident_key"), incident_key=incident, requires_review=review),
    ))
    case = F.coalesce("case_id", F.sha2("alert_key", 256)).alias("case_id")
    at = F.lit(now_ms).cast("bigint")
    return rows.select(case, F.explode(done).alias("x")).select("case_id", at.alias("at_ms"), F.concat(F.lit("system:"), "x.kind").alias("seq"), "x.kind", F.lit("system").alias("actor"), "x.detail")


def _entry(cases: DataFrame, case_id: str, kind: str, actor: str, detail: dict[str, Any], now_ms: int | None) -> DataFrame:
    _need(bool(actor.strip()), "an actor is required")
    _need(not cases.where(F.col("case_id") == case_id).isEmpty(), f"no case {case_id}")
    at = int(time.time() * 1000) if now_ms is None else now_ms
    return cases.sparkSession.createDataFrame([(case_id, at, uuid.uuid4().hex, kind, actor, json.dumps(detail, sort_keys=True, ensure_ascii=False))], AUDIT)


def transition(cases: DataFrame, case_id: str, status: str, actor: str, note: str | None = None, until_ms: int | None = None, now_ms: int | None = None) -> DataFrame:
    """A row of the audit log. Only a suppression has an end, which must lie ahead."""
    _need(status in STATUSES, f"unknown status {status}")
    now = int(time.time() * 1000) if now_ms is None else now_ms
    if status == "suppressed":
        _need(until_ms is not None and until_ms > now, "a suppression needs an end in the future")
    else:
        _need(until_ms is None, "only a suppression has an end")
    return _entry(cases, case_id, "status_changed", actor, {"to": status, "note": note, "suppression_until": until_ms}, now)


def assign(cases: DataFrame, case_id: str, owner: str | None, actor: str, note: str | None = None, now_ms: int | None = None) -> DataFrame:
    """A row of the audit log; a blank owner leaves the case to no one."""
    return _entry(cases, case_id, "owner_changed", actor, {"to": (owner or "").strip() or None, "note": note}, now_ms)


def comment(cases: DataFrame, case_id: str, actor: str, note: str, now_ms: int | None = None) -> DataFrame:
    _need(bool(note.strip()), "a note is required")
    return _entry(cases, case_id, "comment", actor, {"note": note}, now_ms)


def set_tags(cases: DataFrame, case_id: str, tags: list[str], actor: str, now_ms: int | None = None) -> DataFrame:
    _need(all(isinstance(t, str) and t.strip() for t in tags), "tags must not be empty")
    return _entry(cases, case_id, "tags_changed", actor, {"to": sorted({t.strip() for t in tags})}, now_ms)


def folded(cases: DataFrame, log: DataFrame) -> DataFrame:
    """cases with what analysts' rows of the audit log say last of each; every transition ends a review."""
    last = lambda kind: F.max_by(F.when(F.col("kind") == kind, F.col("detail")), F.when(F.col("kind") == kind, F.struct("at_ms", "seq")))
    state = log.groupBy("case_id").agg(last("status_changed").alias("_status"), last("owner_changed").alias("_owner"), last("tags_changed").alias("_tags"))
    rows = cases.join(state, "case_id", "left")
    said = lambda c, path, kind: F.from_json(c, f"struct<{path}:{kind}>")[path]
    moved, owned, tagged = (F.col(c).isNotNull() for c in ("_status", "_owner", "_tags"))
    changed = {
        "status": F.when(moved, said("_status", "to", "string")).otherwise(F.col("status")), "owner": F.when(owned, said("_owner", "to", "string")).otherwise(F.col("owner")),
        "tags": F.when(tagged, said("_tags", "to", "array<string>")).otherwise(F.col("tags")),
        "suppression_until": F.when(moved, said("_status", "suppression_until", "bigint")).otherwise(F.col("suppression_until")), "requires_review": F.col("requires_review") & ~moved,
    }
    return rows.withColumns(changed).select(*cases.columns)


def suppressions(cases: DataFrame) -> DataFrame:
    return cases.where("status = 'suppressed' AND suppression_until IS NOT NULL").select("alert_key", "suppression_until")


def search(cases: DataFrame, user_name: str | None = None, status: str | None = None, severity: str | None = None, owner: str | None = None, requires_review: bool | None = None, page: int = 1, page_size: int = 50) -> DataFrame:
    """A page of cases: those to review first, then by risk and recency. user_name is a part of it, taken literally;
    owner UNASSIGNED finds those of no one."""
    _need(status is None or status in STATUSES, f"unknown status {status}")
    _need(severity is None or severity in SEVERITIES, f"unknown severity {severity}")
    _need(page >= 1 and 1 <= page_size <= MAX_PAGE, "no such page")
    rows = cases
    if user_name:
        rows = rows.where(F.contains(F.lower("user_name"), F.lower(F.lit(user_name.strip()))))
    for column, value in (("status", status), ("severity", severity), ("requires_review", requires_review)):
        if value is not None:
            rows = rows.where(F.col(column) == value)
    if owner:
        rows = rows.where(F.col("owner").isNull() if owner == UNASSIGNED else F.col("owner") == owner.strip())
    order = F.col("requires_review").desc(), F.col("risk_score").desc(), F.col("last_seen").desc(), F.col("case_id")
    return rows.orderBy(*order).offset((page - 1) * page_size).limit(page_size)


def counts(cases: DataFrame) -> DataFrame:
    """One row: cases of each status, all, those of no one and those to review."""
    return cases.agg(*[F.count_if(F.col("status") == s).alias(s) for s in STATUSES], F.count(F.lit(1)).alias("total"), F.count_if(F.col("owner").isNull()).alias("unassigned"), F.count_if("requires_review").alias("requires_review"))
