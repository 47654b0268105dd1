"""Parsers proposed by a provider, such as a language model, for the formats among unknown records."""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import registry
from ..functions import text as text_ops

# fixed values: the kinds of parsers a proposal may ask for
KINDS = ("key_value", "json", "regex")


class ProposalError(ValueError):
    pass


FORMAT_KEYS = ["format_fingerprint", "source_id", "suggested_source_type", "detected_format"]


def _formats(unknown: DataFrame, known: DataFrame | None) -> DataFrame:
    """Unknown records with the fingerprint of their format; without those of known formats."""
    rows = unknown.withColumn("format_fingerprint", registry.format_fingerprint(*[F.col(k) for k in FORMAT_KEYS[1:]], F.lit(None).cast("string"), F.lit(None).cast("string")))
    return rows if known is None else rows.join(known.select("format_fingerprint").distinct(), "format_fingerprint", "left_anti")


def template_counts(unknown: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Every template of every format that requests asks about, with its records: a row each, none left out."""
    return _formats(unknown, known).groupBy(*FORMAT_KEYS, "template_hint").agg(F.count(F.lit(1)).alias("record_count"))


def requests(unknown: DataFrame, known: DataFrame | None = None, samples: int = 5, templates: int = 20) -> DataFrame:
    """A row for each source, type and format: fingerprint, records, first templates and redacted samples.

    known (format_fingerprint) are formats that have a parser and are left out. Only samples and templates of a bounded
    number are gathered; a format's records are counted, not collected. The templates are a preview for a provider, of
    which template_counts has all.
    """
    keys, rows = FORMAT_KEYS, _formats(unknown, known)
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("record_count"))

    def first(df: DataFrame, by: str, n: int, value, name: str) -> DataFrame:
        part = F.pmod(F.xxhash64(by), F.lit(64))  # a hot format is ranked in parts, of which n rows each go on
        few = df.withColumn("_part", part).withColumn("_i", F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(by))).where(F.col("_i") <= n)
        return few.groupBy(*keys).agg(F.transform(F.slice(F.array_sort(F.collect_list(F.struct(by, value.alias("_v")))), 1, n), lambda x: x["_v"]).alias(name))

    shown = first(rows, "unknown_id", samples, text_ops.redact(F.col("raw_text")), "samples")
    hints = first(rows.select(*keys, "template_hint").distinct(), "template_hint", templates, F.col("template_hint"), "templates")
    return counts.join(shown, keys).join(hints, keys)


def validated(proposal: Any) -> dict[str, Any]:
    """The proposal as a parser's definition, or ProposalError for what it must not say."""

    def need(holds: bool, message: str) -> None:
        if not holds:
            raise ProposalError(message)

    need(isinstance(proposal, dict) and proposal.get("parser_type") in KINDS, "a proposal is an object with a known parser_type")
    fields, how, mapping, defaults = (proposal.get(k, {}) for k in ("field_candidates", "field_extractors", "schema_mapping", "event_defaults"))
    need(all(isinstance(x, dict) for x in (fields, how, mapping, defaults)) and bool(fields), "fields, extractors, mapping and defaults are objects, and fields not empty")
    mapping = registry.normalised(mapping)
    need(set(mapping) <= set(fields), "only fields can be mapped")
    for path in mapping.values():
        need(registry.canonical_path(path), f"no such path: {path}")
    need(set(defaults) <= set(registry.DEFAULTS), "defaults may set an event's category, type, action and outcome")
    source = proposal.get("action_source_field")
    need(source is None or source in fields, "action_source_field must be a field")
    if proposal["parser_type"] == "regex":
        need(isinstance(how.get("pattern"), str), "a regex parser needs field_extractors.pattern")
        try:
            re.compile(how["pattern"])
        except re.error as error:
            raise ProposalError(f"the pattern does not compile: {error}") from error
    return {
        "parser_type": proposal["parser_type"], "field_extractors": how, "field_candidates": fields, "schema_mapping": mapping, "action_mapping": proposal.get("action_mapping", {}), "action_source_field": source,
        "event_defaults": defaults, "confidence": float(proposal.get("confidence", 0.0)), "confidence_rationale": str(proposal.get("confidence_rationale", "")), "test_cases": proposal.get("test_cases", []),
    }


def proposed(asked: DataFrame, provider: Callable[[dict[str, Any]], Any]) -> tuple[list[dict[str, Any]], list[dict[str, str]]]:
    """Draft parsers and failures for the rows of requests. Formats, not records, pass through the driver, one by one."""
    candidates, failures = [], []
    for row in asked.orderBy("format_fingerprint").toLocalIterator():
        request = row.asDict(recursive=True)
        try:
            made = validated(provider(request))
        except Exception as error:  # a provider may fail in any way; the other formats go on
            failures.append({"format_fingerprint": row.format_fingerprint, "error": str(error)})
            continue
        contract = {"source_id": row.source_id, "source_type": row.suggested_source_type, "format_fingerprint": row.format_fingerprint}
        candidates.append({
            "candidate_id": f"llm_{row.format_fingerprint.removeprefix('fmt_')}", "source": "llm", "suggested_source_type": row.suggested_source_type, "detected_format": row.detected_format,
            "template_hint": next(iter(row.templates), ""), "format_fingerprint": row.format_fingerprint, "source_contract": contract, "sample_count": row.record_count, "test_cases": made.pop("test_cases"), "suggested_parser": made,
        })
    return registry.registered(candidates, []), failures


def brought_to_approval(unknown: DataFrame, draft: dict[str, Any]) -> dict[str, Any]:
    """The draft after its tests and a shadow replay over the unknown records of its contract: pending_approval where
    both passed, else where it stopped."""
    parser = registry.tested(registry.set_status(draft, "testing"), unknown)
    if not registry.has_passing_tests(parser):
        return parser
    parser = registry.set_status(parser, "shadow")
    own = unknown.where((F.col("source_id") == parser["source_contract"]["source_id"]) & (F.col("suggested_source_type") == parser["source_contract"]["source_type"]) & (F.col("detected_format") == parser["format"]))
    # values differ from record to record: a replay asks whether every field is found
    fields = F.coalesce(registry.extract(F.col("raw_text"), parser), F.create_map().cast("map<string,string>"))
    found = own.select(F.forall(F.array(*map(F.lit, parser["field_candidates"])).cast("array<string>"), lambda f: F.map_contains_key(fields, f)).alias("matched"))
    parser = registry.replayed(parser, found)
    return registry.set_status(parser, "pending_approval") if registry.has_passing_replay(parser) else parser
