"""Declarative parsers of a registry: fields by key=value pairs, JSON paths or named groups, and the choice among them."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as text_ops

# fixed values: names that drafts map, the life of a parser, and where mapped fields go
MAPPING = {"user": "user.name", "username": "user.name", "account": "user.name", "src_ip": "source.ip", "client_ip": "source.ip", "ip": "source.ip", "action": "event.action", "status": "event.outcome", "level": "event.severity", "bytes": "network.bytes"}
TRANSITIONS = {
    "draft": {"testing", "deprecated", "blocked"},
    "testing": {"shadow", "deprecated", "blocked"},
    "shadow": {"active", "pending_approval", "deprecated"},
    "pending_approval": {"active", "deprecated"},
    "active": {"deprecated"},
    "deprecated": set(),
    "blocked": set(),
}
ALIASES = {"@timestamp": "event.time", "url.path": "http.url.path"}
FAMILIES = ("svn", "git", "gitlab", "edr", "waf", "vpn", "sso", "hiklink", "database", "db")
ROOTS = ("event.", "user.", "source.", "destination.", "host.", "device.", "resource.", "http.", "network.", "extensions.")
DEFAULTS = ("event.category", "event.type", "event.action", "event.outcome")
#: Canonical paths and the fields of parsing.EVENT that hold them; other paths go to extensions.
PLACES = {
    "event.time": "event.time", "event.category": "event.category", "event.type": "event.type", "event.action": "event.action", "event.outcome": "event.outcome",
    "user.id": "user.id", "user.name": "user.name", "source.ip": "source.ip", "destination.ip": "destination.ip", "host.name": "host.name", "device.name": "device.name", "device.type": "device.type",
    "resource.type": "resource.type", "resource.id": "resource.id", "resource.name": "resource.name", "http.request.method": "http.method", "http.response.status_code": "http.status_code",
    "http.url.path": "http.path", "network.bytes": "network.bytes",
}


class RegistryError(ValueError):
    pass


def normalised(mapping: dict[str, Any]) -> dict[str, Any]:
    """A mapping of fields to canonical paths: known aliases by their own names, families of sources as extensions."""
    out = {}
    for field, path in mapping.items():
        path = ALIASES.get(path, path) if isinstance(path, str) else path
        family = isinstance(path, str) and path.partition(".")[0] in FAMILIES
        out[field] = f"extensions.{path}" if family else path
    return out


def canonical_path(path: Any) -> bool:
    return isinstance(path, str) and path.startswith(ROOTS)


def _shown(value: Column) -> Column:
    """A variant as text: a string as it is, anything else as JSON; null for JSON's null."""
    of = lambda v, kind: F.when(kind == "VOID", None).when(F.regexp_like(kind, F.lit("^(OBJECT|ARRAY)")), F.to_json(v)).otherwise(F.try_variant_get(v, "$", "string"))
    return text_ops.let(value, lambda v: text_ops.let(F.schema_of_variant(v), lambda kind: of(v, kind)))


def extract(text: Column, parser: dict[str, Any]) -> Column:
    """A parser's fields of a record as a map; null where the text is not of its kind, empty where a pattern does not
    match. A JSON parser without paths takes the whole object; paths that lead nowhere are left out."""
    kind, how = parser.get("parser_type"), parser.get("field_extractors") or {}
    if kind == "key_value":
        return text_ops.key_values(text)
    if kind == "json":
        document = F.when(text_ops.is_json(text), F.try_parse_json(text))
        quoted = lambda path: "$" + "".join("['" + part.replace("'", "") + "']" for part in path.split("."))

        def of(document: Column) -> Column:
            if not how:
                whole = F.transform_values(F.from_json(F.when(F.startswith(F.schema_of_variant(document), F.lit("OBJECT")), text), "map<string,variant>"), lambda k, v: _shown(v))
                return F.when(document.isNotNull(), F.coalesce(whole, F.create_map().cast("map<string,string>")))
            pairs = {field: _shown(F.try_variant_get(document, quoted(str(path)), "variant")) for field, path in how.items()}
            made = F.map_from_arrays(F.array(*map(F.lit, pairs)), F.array(*pairs.values()))
            return F.when(document.isNotNull(), F.map_filter(made, lambda k, v: v.isNotNull()))

        return text_ops.let(document, of)
    if kind == "regex":
        pattern = how.get("pattern")
        if not pattern:
            raise RegistryError("a regex parser needs field_extractors.pattern")
        groups, own = re.compile(pattern).groupindex, re.sub(r"\(\?P<", "(?<", pattern)
        made = F.map_from_arrays(F.array(*map(F.lit, groups)).cast("array<string>"), F.array(*[F.nullif(F.regexp_extract(text, own, i), F.lit("")) for i in groups.values()]).cast("array<string>"))
        return F.when(F.regexp_like(text, F.lit(own)), made).otherwise(F.create_map().cast("map<string,string>"))
    raise RegistryError(f"unknown kind of parser {kind}")


def _time(value: Column) -> Column:
    """An event time: ISO times as they are, with an offset for Z; access log times as ISO; anything else untouched."""
    zone = F.regexp_replace(F.regexp_extract(value, r"([+-]\d{4})$", 1), r"(\d{2})(\d{2})$", "$1:$2")
    log = F.date_format(F.try_to_timestamp(F.regexp_extract(value, r"^(\S+) [+-]\d{4}$", 1), F.lit("dd/MMM/yyyy:HH:mm:ss")), "yyyy-MM-dd'T'HH:mm:ss")
    iso = F.regexp_replace(F.regexp_replace(value, "Z$", "+00:00"), r"^(\d{4}-\d{2}-\d{2}) ", "$1T")
    return F.when(F.regexp_like(value, F.lit(r"^\d{4}-\d{2}-\d{2}")), iso).otherwise(F.coalesce(F.concat(log, zone), value))


def registry_fields(parser: dict[str, Any], fields: Column) -> dict[str, Column]:
    """Canonical paths and their values (strings) from a record's fields: the parser's defaults, then its mapping, then
    its action mapping, then the outcome of an HTTP status where nothing else gave one."""
    mapping, actions, source = parser.get("schema_mapping") or {}, parser.get("action_mapping") or {}, parser.get("action_source_field")
    values = {"event.category": F.lit("application"), "event.type": F.lit("activity"), "event.action": F.lit("unknown"), "event.outcome": F.lit("unknown")}
    values |= {k: F.lit(v) for k, v in (parser.get("event_defaults") or {}).items() if k in DEFAULTS}
    for field, path in mapping.items():
        held = F.try_element_at(fields, F.lit(field))
        held = _time(held) if path == "event.time" else held
        values[path] = F.when(F.map_contains_key(fields, field), held).otherwise(values.get(path, F.lit(None).cast("string")))
    if actions:
        named = [source] if source else []
        named += [f for f, path in mapping.items() if path == "event.action" and f != source]
        known = F.create_map(*[F.lit(str(x)) for pair in actions.items() for x in pair])
        for field in reversed(named):
            held = F.try_element_at(fields, F.lit(field))
            values["event.action"] = F.when(F.map_contains_key(fields, field), F.coalesce(F.try_element_at(known, held), held)).otherwise(values["event.action"])
    status = values.get("http.response.status_code", F.lit(None).cast("string")).try_cast("bigint")
    values["event.outcome"] = F.when((values["event.outcome"] == "unknown") & status.isNotNull(), F.when((status >= 200) & (status < 400), "success").otherwise("failure")).otherwise(values["event.outcome"])
    return values


def _contract(parser: dict[str, Any]) -> Column:
    """Whether a record is of the source and format that the parser was made for."""
    own = parser.get("source_contract") or {}
    if not parser.get("enforce_source_contract"):
        return F.lit(True)
    same = lambda c: F.col(c).eqNullSafe(F.lit(own.get(c)))
    print_ = format_fingerprint(F.col("source_id"), F.col("source_type"), text_ops.detect_format(F.col("raw_text")), F.col("product"), F.col("format_version"))
    out = same("source_id") & same("source_type") & print_.eqNullSafe(F.lit(own.get("format_fingerprint")))
    for c in ("product", "format_version"):
        out = out & same(c) if own.get(c) else out
    return out


def _with(body: Callable, p: dict[str, Any]) -> Callable[[Column], Column]:
    return lambda fields: body(fields, p)


#: What parsers of equal rank are told apart by, in this order; the least priority and the greatest rates win.
RANKS = ("priority", "success_rate", "schema_mapping_rate", "shadow_replay_success_rate")


def select_parser(records: DataFrame, parsers: list[dict[str, Any]], wanted: Column | None = None) -> DataFrame:
    """records (source_id, source_type, raw_text, product, format_version) with parser (null where none fits): id,
    version, confidence, fields, values (canonical path to value), and conflict where several fit.

    A parser fits where the record meets its source contract and all its field candidates are found. Among several the
    least priority wins, then the best rates, then the name; conflict says how many there were, their names and what
    told them apart. Parsers are few and are tried side by side in one pass, on the records that are wanted (default: all).
    """
    for c in ("product", "format_version"):
        records = records if c in records.columns else records.withColumn(c, F.lit(None).cast("string"))
    has_all = lambda fields, names: F.coalesce(F.forall(F.array(*map(F.lit, names)).cast("array<string>"), lambda f: F.map_contains_key(fields, f)), F.lit(False))
    tried = []

    def fitting(fields: Column, p: dict[str, Any]) -> Column:
        fits = fields.isNotNull() & has_all(fields, p.get("field_candidates") or {})
        values = registry_fields(p, fields)
        made = F.map_filter(F.map_from_arrays(F.array(*map(F.lit, values)), F.array(*values.values())), lambda k, v: v.isNotNull())
        ranks = [F.lit(int(p.get("priority", 100))).alias("priority"), *[F.lit(-float(p.get(r) or 0.0)).alias(r) for r in RANKS[1:]]]
        known = F.lit(min(float(p.get("success_rate") or 0.0), 0.9))
        return F.when(fits, F.struct(*ranks, F.lit(p["parser_id"]).alias("id"), F.lit(p.get("version", "0.1.0")).alias("version"), known.alias("confidence"), F.map_entries(fields).alias("fields"), F.map_entries(made).alias("values")))

    wanted = F.lit(True) if wanted is None else wanted
    for p in (p for p in parsers if p.get("status") == "active"):
        tried.append(F.when(wanted & _contract(p), text_ops.let(extract(F.col("raw_text"), p), _with(fitting, p))))
    shape = "struct<id:string,version:string,confidence:double,fields:map<string,string>,values:map<string,string>,conflict:struct<candidate_count:int,selected_parser_id:string,competing_parser_ids:array<string>,resolution:string>>"
    if not tried:
        return records.withColumn("parser", F.lit(None).cast(shape))
    rows = records.withColumn("_fit", F.array_sort(F.array_compact(F.array(*tried))))
    best, n = F.get("_fit", F.lit(0)), F.size("_fit")
    alone = lambda r: (best[r] == F.array_min(F.transform("_fit", lambda x: x[r]))) & (F.size(F.filter("_fit", lambda x: x[r] == best[r])) == 1)
    reason = F.coalesce(*[F.when(alone(r), r) for r in RANKS], F.lit("parser_id"))
    others = F.array_sort(F.transform(F.slice("_fit", 2, F.greatest(n, F.lit(1))), lambda x: x["id"]))
    conflict = F.when(n > 1, F.struct(n.alias("candidate_count"), best["id"].alias("selected_parser_id"), others.alias("competing_parser_ids"), reason.alias("resolution")))
    chosen = F.struct(best["id"].alias("id"), best["version"].alias("version"), best["confidence"].alias("confidence"), F.map_from_entries(best["fields"]).alias("fields"), F.map_from_entries(best["values"]).alias("values"), conflict.alias("conflict"))
    return rows.withColumn("parser", F.when(n > 0, chosen).cast(shape)).drop("_fit")


def run_tests(records: DataFrame, parser: dict[str, Any]) -> DataFrame:
    """records (raw_text, expected: map) with fields, what is missing or differs, and passed."""
    none = F.create_map().cast("map<string,string>")
    rows = records.withColumn("fields", F.coalesce(extract(F.col("raw_text"), parser), none))
    wrong = F.map_filter("expected", lambda k, v: ~F.try_element_at("fields", k).eqNullSafe(v))
    return rows.withColumn("wrong", wrong).withColumn("passed", F.size("wrong") == 0)


def format_fingerprint(*parts: Column) -> Column:
    """A short name of a source's format: of source, type, format and template, or product and version. Null is empty."""
    return F.concat(F.lit("fmt_"), F.left(F.sha2(F.concat_ws(":", *[F.coalesce(p, F.lit("")) for p in parts]), 256), F.lit(16)))


def suggested(candidates: DataFrame) -> DataFrame:
    """candidates (quality.parser_candidates) with a draft parser from the first sample: parser_type, field_candidates,
    schema_mapping and confidence. Of a JSON sample only plain values are fields; other formats need a person."""
    text = F.coalesce(F.get("samples", F.lit(0))["raw_text"], F.lit(""))
    value = F.try_parse_json(text)
    document = F.when(F.startswith(F.schema_of_variant(value), F.lit("OBJECT")), value)
    keys = F.coalesce(F.json_object_keys(F.when(document.isNotNull(), text)), F.array().cast("array<string>"))
    plain = F.map_filter(F.from_json(F.when(document.isNotNull(), text), "map<string,variant>"), lambda k, v: ~F.coalesce(F.regexp_like(F.schema_of_variant(v), F.lit("^(OBJECT|ARRAY)")), F.lit(False)))
    fields = F.when(F.col("detected_format") == "key_value", text_ops.key_values(text)).when((F.col("detected_format") == "json") & (F.size(keys) > 0), F.transform_values(plain, lambda k, v: F.try_variant_get(v, "$", "string")))
    rows = candidates.withColumn("field_candidates", F.coalesce(fields, F.create_map().cast("map<string,string>")))
    known = F.map_from_arrays(F.array(*map(F.lit, MAPPING)), F.array(*map(F.lit, MAPPING.values())))
    mapped = F.filter(F.map_keys("field_candidates"), lambda k: F.map_contains_key(known, k))
    confidence = F.when(F.col("detected_format") == "key_value", 0.7).when(F.col("detected_format") == "json", 0.75).otherwise(0.3)
    return rows.withColumns({"parser_type": F.col("detected_format"), "schema_mapping": F.map_from_arrays(mapped, F.transform(mapped, lambda k: F.element_at(known, k))), "confidence": confidence})


def shadow_replay(records: DataFrame, parser: dict[str, Any]) -> DataFrame:
    """What a parser in shadow makes of unknown records (unknown_id, record_id, raw_text), without any effect: fields,
    wrong (expected values it did not give) and matched. A record with a test case is held to its fields, any other to
    the parser's field candidates."""
    if parser.get("status") != "shadow":
        raise RegistryError(f"{parser.get('parser_id')} is not in shadow")
    as_map = lambda d: F.create_map(*[F.lit(x) for pair in d.items() for x in pair]).cast("map<string,string>")
    expected = as_map(parser.get("field_candidates", {}))
    for case in reversed(parser.get("test_cases", [])):
        expected = F.when(F.col("record_id") == case["record_id"], as_map(case.get("expected_fields", {}))).otherwise(expected)
    none = F.create_map().cast("map<string,string>")
    rows = records.select("unknown_id", "record_id", F.coalesce(extract(F.col("raw_text"), parser), none).alias("fields"), expected.alias("_expected"))
    wrong = F.map_filter("_expected", lambda k, v: ~F.try_element_at("fields", k).eqNullSafe(v))
    return rows.withColumn("wrong", wrong).withColumn("matched", F.size("wrong") == 0).drop("_expected")


def shadow_report(results: DataFrame, parser: dict[str, Any]) -> DataFrame:
    """One row: records, matched, success rate and how much of the parser's fields is mapped."""
    fields, mapping = parser.get("field_candidates", {}), parser.get("schema_mapping", {})
    out = results.agg(F.count(F.lit(1)).alias("replay_record_count"), F.count_if("matched").alias("matched_count"))
    rate = F.when(F.col("replay_record_count") > 0, F.round(F.col("matched_count") / F.col("replay_record_count"), 6)).otherwise(0.0)
    return out.withColumns({"unmatched_count": F.col("replay_record_count") - F.col("matched_count"), "success_rate": rate, "schema_mapping_rate": F.lit(round(len(mapping) / len(fields), 6) if fields else 0.0)})


def has_passing_tests(parser: dict[str, Any]) -> bool:
    return parser.get("test_case_count", 0) > 0 and parser.get("success_rate", 0.0) >= 1


def has_passing_replay(parser: dict[str, Any]) -> bool:
    return parser.get("shadow_replay_record_count", 0) > 0 and parser.get("shadow_replay_success_rate", 0.0) >= 1 and parser.get("shadow_replay_schema_mapping_rate", 0.0) >= 1


def set_status(parser: dict[str, Any], status: str) -> dict[str, Any]:
    """The parser in its next state. It enters shadow with passing tests, and becomes active after a passing replay; one
    that needs approval waits for it first."""
    if status not in TRANSITIONS[parser["status"]]:
        raise RegistryError(f"no way from {parser['status']} to {status}")
    if status == "shadow" and not has_passing_tests(parser):
        raise RegistryError("tests must have passed")
    if status == "active" and not has_passing_replay(parser):
        raise RegistryError("a shadow replay must have passed")
    if status == "active" and parser.get("approval_required") and parser["status"] != "pending_approval":
        raise RegistryError("the parser needs approval")
    return {**parser, "status": status}


def registered(candidates: list[dict[str, Any]], parsers: list[dict[str, Any]]) -> list[dict[str, Any]]:
    """parsers and a draft for each candidate that is not among them, by name. A candidate has candidate_id,
    suggested_parser, and its source, format, template and samples, of which each is a test."""
    known = {p["parser_id"]: p for p in parsers}
    for c in candidates:
        made, model = c.get("suggested_parser") or {}, c.get("source") == "llm"
        fields, mapping = made.get("field_candidates") or {}, made.get("schema_mapping") or {}
        cases = c.get("test_cases") or [{**{k: x.get(k) for k in ("unknown_id", "record_id", "source_id", "raw_text")}, "expected_fields": fields} for x in c.get("samples") or [] if x.get("raw_text")]
        known.setdefault(c["candidate_id"], {
            "parser_id": c["candidate_id"], "status": "draft", "version": "0.1.0", "priority": 100, "source_type": c.get("suggested_source_type", "unknown"), "source_contract": c.get("source_contract"),
            "format_fingerprint": c.get("format_fingerprint"), "enforce_source_contract": model, "approval_required": model, "format": c.get("detected_format", "text"), "template_hint": c.get("template_hint", ""),
            "parser_type": made.get("parser_type", c.get("detected_format", "text")), "field_extractors": made.get("field_extractors") or {}, "field_candidates": fields, "schema_mapping": mapping,
            "action_mapping": made.get("action_mapping") or {}, "action_source_field": made.get("action_source_field"), "event_defaults": made.get("event_defaults") or {}, "test_case_count": 0, "success_rate": 0.0,
            "schema_mapping_rate": round(len(mapping) / len(fields), 6) if fields else 0.0, "sample_count": c.get("sample_count", 0), "test_cases": cases,
        })
    return [known[k] for k in sorted(known)]


def tested(parser: dict[str, Any], records: DataFrame) -> dict[str, Any]:
    """The parser with the outcome of its own tests; records only lends its session."""
    cases = [c for c in parser.get("test_cases") or [] if c.get("raw_text")]
    as_text = lambda v: v if isinstance(v, str) else json.dumps(v)
    data = [(c["raw_text"], {k: as_text(v) for k, v in (c.get("expected_fields") or {}).items()}) for c in cases]
    passed = run_tests(records.sparkSession.createDataFrame(data, "raw_text string, expected map<string,string>"), parser).where("passed").count() if data else 0
    return {**parser, "test_case_count": len(data), "success_rate": round(passed / len(data), 6) if data else 0.0}


def replayed(parser: dict[str, Any], results: DataFrame) -> dict[str, Any]:
    """The parser with the outcome of a shadow replay (results of shadow_replay)."""
    r = shadow_report(results, parser).first()
    return {**parser, "shadow_replay_record_count": r.replay_record_count, "shadow_replay_success_rate": r.success_rate, "shadow_replay_schema_mapping_rate": r.schema_mapping_rate}
