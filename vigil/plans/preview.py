"""What a source's sample gives before the source is added."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import parsing
from ..functions import text as text_ops

# fixed values: fields whose presence counts as coverage
IMPORTANT = ("event.time", "event.action", "event.outcome", "user.name", "source.ip", "resource.name")


def preview(spark: SparkSession, settings: dict[str, Any], sample: str, parsers: list[dict[str, Any]] | None = None) -> DataFrame:
    """One row for a sample text of a source (config.validated_source): ok, detected_source_type, parser_id, confidence,
    field_coverage, fields (path, present), event, reason, errors. Of lines the first that is not blank counts."""
    text = sample.strip()
    if settings.get("kind") == "local" and settings.get("record_mode", "line") == "line":
        text = next((x for x in text.splitlines() if x.strip()), "")
    if not text:
        raise ValueError("a sample is needed")
    where = "kafka://preview/sample/0/0" if settings.get("kind") == "kafka" else "file://preview#L1-L1"
    row = spark.createDataFrame([(text,)], "raw_text string")
    row = row.select(
        F.sha2("raw_text", 256).alias("record_id"), F.lit(settings["source_id"]).alias("source_id"), F.lit(settings["source_type"]).alias("source_type"), "raw_text",
        F.concat(F.lit("sha256:"), F.sha2("raw_text", 256)).alias("checksum"), F.lit(where).alias("storage_ref"), F.octet_length("raw_text").alias("size_bytes"),
        F.lit(settings.get("product")).cast("string").alias("product"), F.lit(settings.get("format_version")).cast("string").alias("format_version"),
    )
    made = parsing.parse(row, parsers)
    errors = F.when(F.col("event").isNotNull(), parsing.validation_errors()).otherwise(F.array().cast("array<string>"))
    fields = F.array(*[F.struct(F.lit(p).alias("path"), (F.coalesce(F.col(f"event.{p}"), F.lit("")) != "").alias("present")) for p in IMPORTANT])
    ok = F.col("event").isNotNull() & (F.size("errors") == 0)
    return made.withColumns({"errors": errors, "fields": fields}).select(
        ok.alias("ok"), text_ops.detect_source(F.col("raw_text")).alias("detected_source_type"), F.coalesce("event.parser.id", F.lit("unknown")).alias("parser_id"), F.coalesce("event.parser.confidence", F.lit(0.0)).alias("confidence"),
        (F.size(F.filter("fields", lambda f: f["present"])) / len(IMPORTANT)).alias("field_coverage"), "fields", "event",
        F.when(ok, None).when(F.size("errors") > 0, "schema_validation_failed").otherwise(F.col("reason")).alias("reason"), "errors",
    )
