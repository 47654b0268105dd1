"""Declarative rules compiled to columns: no code and no patterns of a rule's own are run."""

from __future__ import annotations

import hashlib
import ipaddress
import json
from functools import reduce
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..settings import METRICS, WINDOW_SIZES

# fixed values: what a rule may say
EVENT_FIELDS = (
    "event.category", "event.type", "event.action", "event.outcome", "user.name", "source.ip", "destination.ip", "host.name", "resource.type", "resource.name",
    "http.request.method", "http.response.status_code", "parser.id", "raw.source_type",
)
NUMBERS = (*METRICS, "http.response.status_code")
ADDRESSES = ("source.ip", "destination.ip")
OPERATORS = ("eq", "neq", "in", "not_in", "gt", "gte", "lt", "lte", "exists", "contains", "starts_with", "ends_with", "cidr_contains")
SCOPES = ("event", "window")
STATUSES = ("draft", "shadow", "active", "disabled", "deprecated")
TRANSITIONS = {
    "draft": {"shadow", "disabled", "deprecated"},
    "shadow": {"active", "disabled", "deprecated"},
    "active": {"disabled", "deprecated"},
    "disabled": {"shadow", "active", "deprecated"},
    "deprecated": set(),
}
KEYS = ("rule_id", "version", "name", "description", "status", "scope", "source_types", "window_size", "score", "match", "conditions", "tags", "tests")
REQUIRED = ("rule_id", "version", "name", "status", "scope", "score", "match", "conditions")
MAX_CONDITIONS, MAX_ID, MAX_NAME, MAX_DESCRIPTION = 20, 80, 120, 1000


class RuleError(ValueError):
    pass


def ipv4_number(ip: Column) -> Column:
    """An IPv4 address as a number; null for anything else."""
    parts = F.split(ip, r"\.")
    whole = F.aggregate(parts, F.lit(0).cast("long"), lambda s, x: s * 256 + F.coalesce(x.try_cast("int"), F.lit(0)).cast("long"))
    return F.when(F.regexp_like(ip, F.lit(r"^((25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(\.(?!$)|$)){4}$")), whole)


def cidr_contains(ip: Column, network: str) -> Column:
    """Whether ip lies in network (host bits allowed); false for what is no address of its kind."""
    net = ipaddress.ip_network(network, strict=False)
    if net.version == 4:
        number = ipv4_number(ip)
        return F.coalesce((number >= int(net.network_address)) & (number <= int(net.broadcast_address)), F.lit(False))
    @F.pandas_udf("boolean")
    def inside(values: pd.Series) -> pd.Series:
        def one(x: str | None) -> bool:
            try:
                return x is not None and ipaddress.ip_address(x) in net
            except ValueError:
                return False

        return values.map(one)

    return F.coalesce(inside(ip), F.lit(False))


def condition(field: Column, operator: str, value: Any) -> Column:
    """A condition that is never null. Negations hold for missing fields, everything else does not."""
    no = F.lit(False)
    if operator == "exists":
        return field.isNotNull() if value else field.isNull()
    if operator in ("eq", "neq"):
        same = field.eqNullSafe(F.lit(value))
        return same if operator == "eq" else ~same
    if operator in ("in", "not_in"):
        among = F.coalesce(field.isin(*value), no)
        return among if operator == "in" else ~among
    if operator == "cidr_contains":
        return cidr_contains(field, value)
    made = {"gt": lambda: field > value, "gte": lambda: field >= value, "lt": lambda: field < value, "lte": lambda: field <= value, "contains": lambda: F.contains(field, F.lit(value)), "starts_with": lambda: F.startswith(field, F.lit(value)), "ends_with": lambda: F.endswith(field, F.lit(value))}
    if operator not in made:
        raise RuleError(f"unknown operator {operator}")
    return F.coalesce(made[operator](), no)


def compile_rule(rule: dict[str, Any], fields: dict[str, Column], source_types: Column | None = None) -> Column:
    """Whether a row matches: all or any of the conditions, and one of the rule's source types if it names some."""
    tests = [condition(fields[c["field"]], c["operator"], c.get("value")) for c in rule["conditions"]]
    out = reduce(lambda a, b: a & b if rule.get("match", "all") == "all" else a | b, tests)
    if rule.get("source_types") and source_types is not None:
        out = F.coalesce(F.arrays_overlap(source_types, F.array(*map(F.lit, rule["source_types"]))), F.lit(False)) & out
    return out


def event_fields(columns: list[str]) -> dict[str, Column]:
    """Rule fields of flat events; a field that the events lack is null."""
    names = {"event.action": "action", "event.outcome": "outcome", "user.name": "user_name", "source.ip": "source_ip", "resource.type": "resource_type", "resource.name": "resource_name", "raw.source_type": "source_type"}
    names |= {f: f.replace(".", "_") for f in EVENT_FIELDS if f not in names}
    return {f: F.col(c) if c in columns else F.lit(None).cast("long" if f in NUMBERS else "string") for f, c in names.items()}


def window_fields() -> dict[str, Column]:
    return {m: F.col(m) for m in METRICS}


def fingerprint(rule: dict[str, Any]) -> str:
    return hashlib.sha256(json.dumps(rule, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def _need(holds: bool, message: str) -> None:
    if not holds:
        raise RuleError(message)


def _whole(value: Any) -> bool:
    return isinstance(value, int) and not isinstance(value, bool)


def _number(value: Any) -> bool:
    return isinstance(value, int | float) and not isinstance(value, bool)


def _names(value: Any) -> bool:
    return isinstance(value, list) and all(isinstance(x, str) and x for x in value)


def validate_condition(condition: Any, scope: str) -> dict[str, Any]:
    """The condition, with a value; RuleError names what is wrong."""
    _need(isinstance(condition, dict) and {"field", "operator"} <= set(condition) <= {"field", "operator", "value"}, "a condition has a field, an operator and a value")
    field, operator, value = condition["field"], condition["operator"], condition.get("value", True)
    _need(field in (EVENT_FIELDS if scope == "event" else METRICS), f"unknown field {field}")
    _need(operator in OPERATORS, f"unknown operator {operator}")
    _need("value" in condition or operator == "exists", f"{operator} needs a value")
    number, each = field in NUMBERS, value if isinstance(value, list) else [value]
    if operator in ("in", "not_in"):
        _need(isinstance(value, list) and bool(value), f"{operator} needs a list")
    if operator in ("eq", "neq", "in", "not_in"):
        _need(all(map(_number, each)) if number else all(isinstance(x, str) for x in each), f"{operator} needs values of the kind of {field}")
    elif operator in ("gt", "gte", "lt", "lte"):
        _need(number and _number(value), f"{operator} needs a numeric field and a number")
    elif operator == "exists":
        _need(isinstance(value, bool), "exists needs true or false")
    elif operator == "cidr_contains":
        _need(field in ADDRESSES, f"{operator} needs an address")
        try:
            ipaddress.ip_network(value, strict=False)
        except (ValueError, TypeError) as e:
            raise RuleError(f"{value} is no network") from e
    else:
        _need(not number and isinstance(value, str), f"{operator} needs a text field and a string")
    return {"field": field, "operator": operator, "value": value}


def validate_test(test: Any) -> dict[str, Any]:
    _need(isinstance(test, dict) and set(test) == {"name", "input", "expected_match"}, "a test has a name, an input and what is expected")
    _need(isinstance(test["name"], str) and bool(test["name"]) and isinstance(test["input"], dict) and isinstance(test["expected_match"], bool), "a test's parts are a string, an object and a truth value")
    return {**test, "name": test["name"][:MAX_NAME]}


def validate_rule(rule: Any) -> dict[str, Any]:
    """The rule with sorted tags and source types; RuleError names what is wrong. An active rule must have a test that
    matches and one that does not, and pass all its tests."""
    _need(isinstance(rule, dict) and set(rule) <= set(KEYS), "a rule is an object with known keys")
    for key in REQUIRED:
        _need(key in rule, f"missing {key}")
    name, text = rule["rule_id"], rule["name"]
    _need(isinstance(name, str) and 1 <= len(name) <= MAX_ID and all(c.isalnum() or c in "._-" for c in name), f"rule_id has 1 to {MAX_ID} letters, digits, dots, underscores and hyphens")
    _need(_whole(rule["version"]) and rule["version"] > 0, "version must be a positive integer")
    _need(isinstance(text, str) and bool(text.strip()) and len(text) <= MAX_NAME, f"name has 1 to {MAX_NAME} characters")
    _need(isinstance(rule.get("description", ""), str) and len(rule.get("description", "")) <= MAX_DESCRIPTION, f"description has up to {MAX_DESCRIPTION} characters")
    _need(rule["status"] in STATUSES and rule["scope"] in SCOPES and rule["match"] in ("all", "any"), "unknown status, scope or match")
    _need(_whole(rule["score"]) and 0 <= rule["score"] <= 100, "score must be an integer from 0 to 100")
    _need(_names(rule.get("source_types", [])) and _names(rule.get("tags", [])), "source_types and tags are lists of names")
    _need(isinstance(rule["conditions"], list) and 1 <= len(rule["conditions"]) <= MAX_CONDITIONS, f"a rule has 1 to {MAX_CONDITIONS} conditions")
    size = rule.get("window_size")
    _need(size in WINDOW_SIZES if rule["scope"] == "window" else size is None, f"window rules, and only they, have a window_size of {WINDOW_SIZES}")
    _need(isinstance(rule.get("tests", []), list), "tests are a list")
    out = {
        **{k: rule[k] for k in REQUIRED}, "name": text.strip(), "description": rule.get("description", ""), "source_types": sorted(set(rule.get("source_types", []))), "tags": sorted(set(rule.get("tags", []))),
        "conditions": [validate_condition(c, rule["scope"]) for c in rule["conditions"]], "tests": [validate_test(t) for t in rule.get("tests", [])], **({"window_size": size} if size else {}),
    }
    if out["status"] == "active":
        _need({t["expected_match"] for t in out["tests"]} == {True, False}, "an active rule has a test that matches and one that does not")
        _need(all(t["passed"] for t in run_tests(SparkSession.active(), out)), "an active rule passes its tests")
    return out


def validate_rules(document: dict[str, Any]) -> list[dict[str, Any]]:
    seen, out = set(), [validate_rule(r) for r in document.get("rules", [])]
    for rule in out:
        key = rule["rule_id"], rule["version"]
        _need(key not in seen, f"repeated rule {key}")
        seen.add(key)
    return out


def run_tests(spark: SparkSession, rule: dict[str, Any]) -> list[dict[str, Any]]:
    """Each of a rule's own tests with what the compiled rule says of its input. An input names fields with dots or
    nests them."""

    def value(document: dict[str, Any], path: str) -> Any:
        if path in document:
            return document[path]
        for part in path.split("."):
            document = document.get(part) if isinstance(document, dict) else None
        return document

    fields = EVENT_FIELDS if rule["scope"] == "event" else METRICS
    schema = ", ".join(f"`{f}` {'long' if f in NUMBERS else 'string'}" for f in fields) + ", source_types array<string>, _i int"
    tests, data = rule.get("tests", []), []
    for i, t in enumerate(tests):
        kind = value(t["input"], "raw.source_type") if rule["scope"] == "event" else t["input"].get("source_types")
        data.append(Row(*[value(t["input"], f) for f in fields], [kind] if isinstance(kind, str) else kind, i))
    if not data:
        return []
    rows = spark.createDataFrame(data, schema)
    hit = compile_rule(rule, {f: F.col(f"`{f}`") for f in fields}, F.col("source_types"))
    got = {r["_i"]: r.hit for r in rows.select("_i", hit.alias("hit")).collect()}
    return [{"name": t["name"], "expected": t["expected_match"], "matched": got[i], "passed": got[i] == t["expected_match"]} for i, t in enumerate(tests)]


def set_status(rules: list[dict[str, Any]], rule_id: str, version: int, status: str) -> list[dict[str, Any]]:
    """rules with one version's new status. A version that goes live disables the one that was: one at a time is."""
    rule = next((r for r in rules if (r["rule_id"], r["version"]) == (rule_id, version)), None)
    _need(rule is not None, f"no rule {rule_id} of version {version}")
    _need(status in TRANSITIONS[rule["status"]], f"no way from {rule['status']} to {status}")
    live = ("active", "shadow")
    changed = validate_rule({**rule, "status": status})
    retire = lambda r: {**r, "status": "disabled"} if status in live and r["rule_id"] == rule_id and r["status"] in live else r
    return [changed if r is rule else retire(r) for r in rules]


def add_version(rules: list[dict[str, Any]], rule: dict[str, Any]) -> list[dict[str, Any]]:
    """rules with a new version, which must follow the last one; the first is 1."""
    last = max((r["version"] for r in rules if r["rule_id"] == rule.get("rule_id")), default=0)
    made = validate_rule(rule)
    _need(made["version"] == last + 1, f"the next version of {made['rule_id']} is {last + 1}")
    return [*rules, made]


def matches(rows: DataFrame, rules: list[dict[str, Any]], fields: dict[str, Column], source_types: Column) -> DataFrame:
    """A row for each row and rule that matches it, with rule (rule_id, version, score, mode, fingerprint).

    All rules are tested in one pass over rows.
    """
    hit = []
    for r in rules:
        made = F.struct(F.lit(r["rule_id"]).alias("rule_id"), F.lit(r["version"]).alias("version"), F.lit(r["score"]).alias("score"), F.lit(r["status"]).alias("mode"), F.lit(fingerprint(r)).alias("fingerprint"))
        test = compile_rule(r, fields, source_types)
        if r["scope"] == "window":
            test = (F.col("window_size") == r["window_size"]) & test
        hit.append(F.when(test, made))
    if not hit:
        return rows.where("false").withColumn("rule", F.lit(None).cast("struct<rule_id:string,version:int,score:int,mode:string,fingerprint:string>"))
    return rows.withColumn("rule", F.explode(F.filter(F.array(*hit), lambda x: x.isNotNull())))
