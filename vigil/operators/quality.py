"""Quality of parsed and unknown records, drift between two summaries, candidates for parsers, and replays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.state import settle
from .frequent import LIMIT, frequent_items

# fixed values: what is tracked, and how much change counts
TRACKED = ("event.category", "event.action", "event.outcome", "user.name", "source.ip", "raw.checksum", "raw.storage_ref")
DRIFT = {"parse_success_rate_drop": 0.10, "unknown_template_count_multiplier": 2.0, "unknown_template_count_min_delta": 3, "parser_confidence_avg_drop": 0.10, "required_field_coverage_drop": 0.20}


def templates(unknown: DataFrame) -> DataFrame:
    """How often each template occurs: exact counts, partly summed before the shuffle."""
    return unknown.groupBy("template_hint").agg(F.count(F.lit(1)).alias("n"))


def top_templates(unknown: DataFrame, limit: int = 10) -> DataFrame:
    """A report of the most frequent templates; ties by template."""
    return templates(unknown).orderBy(F.col("n").desc(), "template_hint").limit(limit)


def confidence_p50(events: DataFrame) -> DataFrame:
    """The confidence of rank floor(n / 2), by bins of 0.0001; 0 where there is none. At most 10,001 rows are ranked."""
    from pyspark.sql import Window

    bins = events.where("parser.confidence IS NOT NULL").groupBy(F.round(F.col("parser.confidence") * 10_000).cast("long").alias("b")).agg(F.count(F.lit(1)).alias("n"))
    every = Window.orderBy("b")
    ranked = bins.withColumns({"_to": F.sum("n").over(every), "_all": F.sum("n").over(every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))})
    return ranked.agg(F.coalesce(F.min(F.when(F.col("_to") > F.floor(F.col("_all") / 2), F.col("b"))) / 10_000, F.lit(0.0)).alias("parser_confidence_p50"))


def summary(events: DataFrame, unknown: DataFrame) -> DataFrame:
    """One row of counts, rates and coverage. Missing fields are the errors of rejected events."""
    present = [F.count_if(F.coalesce(F.col(p).cast("string"), F.lit("")) != "").alias(p.replace(".", "_")) for p in TRACKED]
    missing = F.coalesce(F.sum(F.size("schema_errors")), F.lit(0)) if "schema_errors" in unknown.columns else F.lit(0)
    conf = F.col("parser.confidence")
    known = events.agg(F.count(F.lit(1)).alias("normalized_records"), F.coalesce(F.round(F.avg(conf.cast("decimal(20,10)")), 6).cast("double"), F.lit(0.0)).alias("parser_confidence_avg"), F.coalesce(F.min(conf), F.lit(0.0)).alias("parser_confidence_min"), *present)
    rest = unknown.agg(F.count(F.lit(1)).alias("unknown_records"), F.count_distinct(F.nullif("template_hint", F.lit(""))).alias("unknown_template_count"), missing.cast("long").alias("missing_required_fields_count"))
    rows = known.crossJoin(F.broadcast(rest)).crossJoin(F.broadcast(confidence_p50(events)))  # one row each
    total = F.col("normalized_records") + F.col("unknown_records")
    rate = F.when(total > 0, F.round(F.col("normalized_records") / total, 6)).otherwise(0.0)
    coverage = {p.replace(".", "_"): F.when(F.col("normalized_records") > 0, F.round(F.col(p.replace(".", "_")) / F.col("normalized_records"), 6)).otherwise(0.0) for p in TRACKED}
    return rows.withColumns({"total_records": total, "parse_success_rate": rate, **coverage})


def snapshot(events: DataFrame, unknown: DataFrame) -> DataFrame:
    """measure, key, n: counts that add up, so that those of two parts of the input merge into those of the whole.

    Measures: normalized, unknown, source_type, parser, present (field), missing (errors), template, reason, confidence
    (bins of 0.0001). Records without a template count under no template.
    """
    item = lambda measure, key, n=1: F.struct(F.lit(measure).alias("measure"), key.cast("string").alias("key"), F.lit(n).cast("long").alias("n") if isinstance(n, int) else n.cast("long").alias("n"))
    conf = F.col("parser.confidence")
    present = [F.when(F.coalesce(F.col(p).cast("string"), F.lit("")) != "", item("present", F.lit(p))) for p in TRACKED]
    known = F.array_compact(F.array(item("normalized", F.lit("")), item("source_type", F.coalesce("raw.source_type", F.lit("unknown"))), item("parser", F.coalesce("parser.id", F.lit("unknown"))), F.when(conf.between(0, 1), item("confidence", F.round(conf * 10_000).cast("long"))), *present))
    errors = F.size("schema_errors") if "schema_errors" in unknown.columns else F.lit(0)
    rest = F.array_compact(F.array(item("unknown", F.lit("")), item("source_type", F.coalesce("source_type" if "source_type" in unknown.columns else "suggested_source_type", F.lit("unknown"))), item("reason", F.coalesce("reason", F.lit("unknown"))), F.when(errors > 0, item("missing", F.lit(""), errors)), F.when(F.coalesce("template_hint", F.lit("")) != "", item("template", F.col("template_hint")))))
    rows = events.select(F.explode(known).alias("x")).unionByName(unknown.select(F.explode(rest).alias("x"))).select("x.*")
    return rows.groupBy("measure", "key").agg(F.sum("n").alias("n"))


def bounded(counts: DataFrame, limit: int = LIMIT) -> DataFrame:
    """A snapshot of at most limit templates: beyond, their counts are those of frequent_items, and the measure
    template_error says by how much they may be short. A state of merged snapshots so does not grow with the templates."""
    own = F.col("measure").isin("template", "template_error")
    if counts.where(F.col("measure") == "template").limit(limit + 1).count() <= limit:
        return counts
    found = settle(frequent_items(counts.where("measure = 'template'"), "key", "n", limit))
    before = counts.where("measure = 'template_error'").select("n").unionByName(found.select(F.col("error").alias("n")).limit(1))  # one row each
    short = before.agg(F.sum("n").alias("n")).select(F.lit("template_error").alias("measure"), F.lit("").alias("key"), "n")
    return counts.where(~own).unionByName(found.select(F.lit("template").alias("measure"), F.col("item").alias("key"), "n")).unionByName(short)


def merged(*snapshots: DataFrame) -> DataFrame:
    """The snapshot of all inputs of the given ones."""
    rows = snapshots[0]
    for s in snapshots[1:]:
        rows = rows.unionByName(s)
    return rows.groupBy("measure", "key").agg(F.sum("n").alias("n"))


def violations(of: DataFrame) -> DataFrame:
    """problem: what cannot be in a snapshot; no rows for a sound one."""
    total = lambda m: F.coalesce(F.sum(F.when(F.col("measure") == m, F.col("n"))), F.lit(0))
    most = F.coalesce(F.max(F.when(F.col("measure") == "present", F.col("n"))), F.lit(0))
    known = F.col("measure").isin("normalized", "unknown", "source_type", "parser", "present", "missing", "template", "reason", "confidence")
    fields = F.count_if((F.col("measure") == "present") & ~F.col("key").isin(*TRACKED))
    bins = F.count_if((F.col("measure") == "confidence") & ~F.coalesce(F.col("key").try_cast("long").between(0, 10_000), F.lit(False)))
    one = of.agg(*[total(m).alias(m) for m in ("normalized", "unknown", "source_type", "parser", "missing", "template", "reason", "confidence")], most.alias("most"), F.count_if(F.coalesce(F.col("n") < 0, F.lit(True))).alias("bad"), F.count_if(~known).alias("strange"), fields.alias("fields"), bins.alias("bins"))
    c = F.col
    checks = {
        "a count is negative or missing": c("bad") > 0, "a measure is unknown": c("strange") > 0, "a field is not tracked": c("fields") > 0, "a confidence is out of range": c("bins") > 0, "source types do not add up": c("source_type") != c("normalized") + c("unknown"),
        "parsers do not add up": c("parser") != c("normalized"), "reasons do not add up": c("reason") != c("unknown"), "a field is present more often than there are records": c("most") > c("normalized"),
        "more confidences than records": c("confidence") > c("normalized"), "more templates than unknown records": c("template") > c("unknown"), "errors without unknown records": (c("unknown") == 0) & (c("missing") != 0),
    }
    return one.select(F.explode(F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in checks.items()]))).alias("problem"))


def drift(before: DataFrame, after: DataFrame, limits: dict = DRIFT) -> DataFrame:
    """flag, triggered, delta of two summaries: drops of rates and coverage, and a spike of templates."""
    drop = lambda c, limit: F.struct(F.lit(f"{c}_drop").alias("flag"), F.round(F.col(f"b.{c}") - F.col(f"a.{c}"), 6).alias("delta"), (F.round(F.col(f"b.{c}") - F.col(f"a.{c}"), 6) >= limit).alias("triggered"))
    b, a = F.col("b.unknown_template_count"), F.col("a.unknown_template_count")
    spike = F.struct(F.lit("unknown_template_count_spike").alias("flag"), (a - b).cast("double").alias("delta"), (((a - b) >= limits["unknown_template_count_min_delta"]) & (a >= b * limits["unknown_template_count_multiplier"])).alias("triggered"))
    flags = [drop("parse_success_rate", limits["parse_success_rate_drop"]), drop("parser_confidence_avg", limits["parser_confidence_avg_drop"]), spike, *[drop(p.replace(".", "_"), limits["required_field_coverage_drop"]) for p in TRACKED]]
    return before.alias("b").crossJoin(F.broadcast(after.alias("a"))).select(F.explode(F.array(*flags)).alias("f")).select("f.*")


def parser_candidates(unknown: DataFrame, samples: int = 5) -> DataFrame:
    """Groups of unknown records that may share a parser, with the first samples by id.

    Samples are kept by a bounded aggregate, so that a template of any size stays small.
    """
    keys = ["suggested_source_type", "detected_format", "template_hint"]
    from pyspark.sql import Window

    spread = unknown.withColumn("_part", F.pmod(F.xxhash64("unknown_id"), F.lit(64)))
    order = Window.partitionBy(*keys, "_part").orderBy("unknown_id")
    first = spread.withColumn("_i", F.row_number().over(order)).where(F.col("_i") <= samples)
    kept = first.groupBy(*keys).agg(F.slice(F.array_sort(F.collect_list(F.struct("unknown_id", "record_id", "raw_text"))), 1, samples).alias("samples"))
    counts = unknown.groupBy(*keys).agg(F.count(F.lit(1)).alias("sample_count"))
    ident = F.concat(F.lit("candidate_"), F.left(F.sha2(F.concat_ws(":", *keys), 256), F.lit(16)))
    return counts.join(kept, keys).withColumns({"candidate_id": ident, "status": F.lit("draft")})


def replay_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """record_id, change_type, baseline_parser_id, current_parser_id of two replays.

    Both have record_id, kind (normalized or unknown), parser_id and projection: what counts as the event's content.
    """
    b, a = before.select("record_id", F.struct("kind", "parser_id", "projection").alias("b")), after.select("record_id", F.struct("kind", "parser_id", "projection").alias("a"))
    c = F.col
    change: Column = (
        F.when(c("b").isNull(), "new_record").when(c("a").isNull(), "removed_record").when((c("b.kind") == "unknown") & (c("a.kind") == "normalized"), "unknown_resolved").when((c("b.kind") == "normalized") & (c("a.kind") == "unknown"), "new_unknown")
        .when(~c("b.parser_id").eqNullSafe(c("a.parser_id")), "parser_changed").when(~c("b.projection").eqNullSafe(c("a.projection")), "event_changed").otherwise("unchanged")
    )
    both = c("a").isNotNull() & c("b").isNotNull()
    return b.join(a, "record_id", "full_outer").select("record_id", change.alias("change_type"), F.when(both, c("b.parser_id")).alias("baseline_parser_id"), F.when(both, c("a.parser_id")).alias("current_parser_id"))


# fixed values: the numbers of a replay's summary whose change is reported
SUMMARY = ("total_records", "normalized_records", "unknown_records", "parse_success_rate", "parser_confidence_avg", "unknown_template_count")
CHANGES = ("unchanged", "unknown_resolved", "new_unknown", "parser_changed", "event_changed", "new_record", "removed_record")


def change_counts(changes: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: records, changes of each type, and how many records each replay (record_id, kind) normalized or not. A
    record that became known or unknown changed its parser too."""
    kinds = {c: F.count_if(F.col("change_type") == c) for c in CHANGES}
    kinds["parser_changed"] = F.count_if(F.col("change_type").isin("parser_changed", "unknown_resolved", "new_unknown"))
    out = changes.agg(F.count(F.lit(1)).alias("total_records"), *[v.alias(k) for k, v in kinds.items()])
    for name, rows in (("baseline", before), ("current", after)):
        one = rows.agg(F.count_if(F.col("kind") == "normalized").alias(f"{name}_normalized_records"), F.count_if(F.col("kind") == "unknown").alias(f"{name}_unknown_records"))
        out = out.crossJoin(F.broadcast(one))  # one row each
    return out


def summary_deltas(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: how each number of SUMMARY differs between two summaries."""
    rows = before.alias("b").crossJoin(F.broadcast(after.alias("a")))  # one row each
    return rows.select(*[F.round(F.col(f"a.{c}").cast("double") - F.col(f"b.{c}").cast("double"), 6).alias(c) for c in SUMMARY])
