"""Raw records from text files: lines or brace-balanced objects, with identity and place; stores of raw records and of
canonical events."""

from __future__ import annotations

import bz2
import gzip
import io
import lzma
import zipfile
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .state import settle

#: Suffixes that Spark's own reader does not unpack: such a file (of 2 GB at most) is one task's work.
PACKED = ("xz", "lzma", "zip")
LINES_A_BATCH = 10_000
#: Lines that are numbered, or summed over, in one task.
LINES_A_BUCKET = 20_000
#: A raw record as it is stored.
RAW = (
    "record_id string, source_id string, source_type string, file_path string, line_start int, line_end int, record_index int, raw_text string, checksum string, size_bytes long, storage_ref string, "
    "include_raw_text boolean, product string, format_version string, llm_enabled boolean, kafka_topic string, kafka_partition int, kafka_offset long, kafka_timestamp_ms long"
)
DEFAULTS = {"file_path": "", "line_start": 0, "line_end": 0, "record_index": 0, "include_raw_text": True, "llm_enabled": False}
NEEDED = ("record_id", "source_id", "source_type", "raw_text", "checksum", "size_bytes", "storage_ref")


class SourceError(ValueError):
    pass


def source_files(spark: SparkSession, sources: list[dict[str, Any]]) -> list[dict[str, Any]]:
    """unit_id, path and source of every file: sources in order, of each its patterns in order, of each its matches
    sorted. Patterns are globs of any file system that Spark reads."""
    jvm, out = spark._jvm, []
    for i, source in enumerate(sources):
        for k, pattern in enumerate(source.get("paths", [])):
            at = jvm.org.apache.hadoop.fs.Path(pattern)
            found = at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at) or []
            paths = sorted(f.getPath().toString().removeprefix("file:") for f in found if f.isFile())
            out += [{"unit_id": f"local:{i}:{k}:{n}", "path": p, "source": source} for n, p in enumerate(paths)]
    return out


def _open(path: str, data: bytes) -> io.TextIOBase:
    suffix = path.rpartition(".")[2].lower()
    if suffix == "zip":
        z = zipfile.ZipFile(io.BytesIO(data))
        names = sorted(n for n in z.namelist() if not n.endswith("/"))
        raw = z.open(names[0]) if names else io.BytesIO()
    elif suffix in ("xz", "lzma"):
        raw = lzma.open(io.BytesIO(data))
    else:
        raw = {"gz": gzip.open, "bz2": bz2.open}.get(suffix, lambda b: b)(io.BytesIO(data))
    return io.TextIOWrapper(raw, encoding="utf-8", errors="replace")


def _packed_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                number, held = 0, []
                made = lambda: pa.record_batch([pa.array([path] * len(held), pa.string()), pa.array(range(number + 1, number + 1 + len(held)), pa.int64()), pa.array(held, pa.string())], ["path", "line", "text"])  # noqa: B023, E731
                for line in _open(path, data.as_py()):
                    held.append(line.removesuffix("\n"))
                    if len(held) == LINES_A_BATCH:
                        yield made()
                        number, held = number + len(held), []
                yield made()

    return spark.read.format("binaryFile").load(paths).select("path", "content").mapInArrow(rows, "path string, line long, text string")


def indexed_lines(spark: SparkSession, paths: list[str], separator: str | None = None) -> DataFrame:
    """path, block (where a split begins), i (line of the split, from 0), text of every line of files that Spark reads."""
    reader = spark.read if separator is None else spark.read.option("lineSep", separator)
    rows = reader.text(paths).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("text"))

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[str, int], int] = {}
        for batch in batches:
            at = []
            for key in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen[key] = seen.get(key, -1) + 1
                at.append(seen[key])
            yield pa.record_batch([*batch.columns[:2], pa.array(at, pa.int64()), batch.column(2)], ["path", "block", "i", "text"])

    return rows.select("path", "block", F.make_valid_utf8("text").alias("text")).mapInArrow(number, "path string, block long, i long, text string")


def read_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """path, line (from 1), text of every line of plain, gz, bz2, xz, lzma and zip files (of these the first member).

    Large files are read by many tasks: a split's lines are counted first, and the counts before it, summed, number them.
    xz, lzma and zip files are a task's work each, line by line. Paths may be folders.
    """
    listed = _listed(spark, paths)
    plain = [p for p in listed if p.rpartition(".")[2].lower() not in PACKED]
    packed = [p for p in listed if p not in plain]
    parts = []
    if plain:
        lines = indexed_lines(spark, plain)
        counts = lines.groupBy("path", "block").agg(F.count(F.lit(1)).alias("n"))
        before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row a split
        first = counts.select("path", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
        parts.append(lines.join(F.broadcast(first), ["path", "block"]).select("path", (F.col("first") + F.col("i") + 1).alias("line"), "text"))
    if packed:
        parts.append(_packed_lines(spark, packed))
    if not parts:
        return spark.createDataFrame([], "path string, line int, text string")
    rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return rows.select(F.regexp_replace("path", "^file:/+", "/").alias("path"), F.col("line").cast("int").alias("line"), "text")


def _listed(spark: SparkSession, paths: list[str]) -> list[str]:
    out = []
    for p in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(p)
        fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
        inside = fs.listStatus(at) if fs.exists(at) and fs.getFileStatus(at).isDirectory() else []
        out += [f.getPath().toString() for f in inside if f.isFile() and not f.getPath().getName().startswith(("_", "."))] if inside else [p]
    return out


def _running(rows: DataFrame, value: Column, name: str, before: bool = False) -> DataFrame:
    """rows (path, line) with the sum of value over the lines of a path up to each (or before it), a bucket of lines at a
    time: the buckets' sums, added up, begin each bucket's own."""
    rows = rows.withColumns({"_b": F.floor(F.col("line") / LINES_A_BUCKET), "_v": value.cast("long")})
    sums = rows.groupBy("path", "_b").agg(F.sum("_v").alias("_s"))
    earlier = Window.partitionBy("path").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("path", "_b", F.coalesce(F.sum("_s").over(earlier), F.lit(0)).alias("_s"))
    own = Window.partitionBy("path", "_b").orderBy("line").rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    rows = rows.withColumn("_own", F.coalesce(F.sum("_v").over(own), F.lit(0)))
    return rows.join(sums, ["path", "_b"]).withColumn(name, F.col("_s") + F.col("_own")).drop("_b", "_v", "_s", "_own")


def line_records(lines: DataFrame) -> DataFrame:
    """Lines that are not blank: path, line_start, line_end, record_index (from 1), raw_text."""
    kept = _running(lines.where(F.regexp_like("text", F.lit(r"\S"))), F.lit(1), "_index")
    return kept.select("path", F.col("line").alias("line_start"), F.col("line").alias("line_end"), F.col("_index").cast("int").alias("record_index"), F.col("text").alias("raw_text"))


def object_records(lines: DataFrame) -> DataFrame:
    """Runs of lines in which braces balance, without a trailing comma; an unfinished tail is dropped.

    The depth after a line is a running sum; a record ends where it is 0, so a line's record is the number of such
    lines before it.
    """
    count = lambda c: F.length("text") - F.length(F.translate("text", c, ""))
    rows = _running(lines, count("{") - count("}"), "_depth")
    ends = F.when(F.col("_depth") <= 0, 1).otherwise(0)
    rows = _running(rows.withColumn("_ends", ends), F.col("_ends"), "_record", before=True)
    parts = rows.groupBy("path", "_record").agg(F.array_sort(F.collect_list(F.struct("line", "text"))).alias("l"), F.max("_ends").alias("_whole"), F.max(F.contains("text", F.lit("{"))).alias("_object"))
    whole = parts.where("_whole = 1 AND _object").withColumn("line", F.element_at("l", 1)["line"])
    text = F.regexp_replace(F.regexp_replace(F.array_join(F.transform("l", lambda x: x["text"]), "\n"), r"^\s+|\s+$", ""), ",$", "")
    whole = _running(whole, F.lit(1), "_index")
    return whole.select("path", F.col("line").alias("line_start"), F.element_at("l", -1)["line"].alias("line_end"), F.col("_index").cast("int").alias("record_index"), text.alias("raw_text"))


def raw_records(framed: DataFrame, source_id: str, source_type: str, **more: Any) -> DataFrame:
    """framed records with identity, checksum, size and reference; more are the source's other settings of RAW."""
    ident = F.concat_ws(":", F.lit(source_id), "path", F.col("line_start").cast("string"), F.col("line_end").cast("string"), "raw_text")
    rows = framed.select(
        F.sha2(ident, 256).alias("record_id"), F.lit(source_id).alias("source_id"), F.lit(source_type).alias("source_type"), F.col("path").alias("file_path"), "line_start", "line_end", "record_index", "raw_text",
        F.concat(F.lit("sha256:"), F.sha2("raw_text", 256)).alias("checksum"), F.octet_length("raw_text").alias("size_bytes"), F.concat(F.lit("file://"), "path", F.lit("#L"), "line_start", F.lit("-L"), "line_end").alias("storage_ref"),
    )
    return rows.withColumns({k: F.lit(v) for k, v in more.items()}) if more else rows


def source_records(spark: SparkSession, sources: list[dict[str, Any]]) -> DataFrame:
    """The raw records of all files of all sources, with the columns of RAW."""
    out = spark.createDataFrame([], RAW)
    for i, source in enumerate(sources):
        paths = [f["path"] for f in source_files(spark, [source])]
        if paths:
            lines = read_lines(spark, paths)
            framed = (object_records if source.get("record_mode", "line") == "object" else line_records)(lines)
            more = {k: source[k] for k in ("product", "format_version", "include_raw_text", "llm_enabled") if source.get(k) is not None}
            out = out.unionByName(stored(raw_records(framed, source.get("source_id", f"source-{i}"), source.get("source_type", "auto"), **more)))
    return out


def stored(records: DataFrame) -> DataFrame:
    """records with exactly the columns of RAW; missing ones and nulls have their defaults."""
    kinds = {f.name: f.dataType for f in records.sparkSession.createDataFrame([], RAW).schema}
    missing = [c for c in NEEDED if c not in records.columns]
    if missing:
        raise SourceError(f"raw records lack {', '.join(missing)}")
    column = lambda c: F.col(c) if c in records.columns else F.lit(None)
    return records.select(*[F.coalesce(column(c).cast(k), F.lit(DEFAULTS.get(c)).cast(k)).alias(c) for c, k in kinds.items()])


def write_raw_store(records: DataFrame, path: str) -> None:
    """Raw records as JSON lines."""
    stored(records).write.json(path, ignoreNullFields=False)


def read_raw_store(spark: SparkSession, path: str) -> DataFrame:
    """A raw store with the columns of RAW; blank lines are passed over, a line that is no record fails the job."""
    rows = spark.read.schema(RAW).json(path, mode="FAILFAST")
    return stored(rows.where(" OR ".join(f"{c} IS NOT NULL" for c in NEEDED)))


def read_canonical(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Canonical events from JSON lines; a malformed line fails the job."""
    return spark.read.schema(schema).json(path, mode="FAILFAST")


def read_peer_groups(spark: SparkSession, path: str) -> DataFrame:
    """user_name, group_id of a CSV file with exactly that header. SourceError for another header, an empty or missing
    field, or a user who stands in it twice."""
    raw = spark.read.csv(path, header=False, inferSchema=False, enforceSchema=False, quote='"', escape='"', nullValue="\u0000", emptyValue="", mode="FAILFAST")
    head = spark.read.text(path).limit(1).collect()
    if not head or head[0].value.strip("﻿\r") != "user_name,group_id" or len(raw.columns) != 2:
        raise SourceError("the header of peer groups is user_name,group_id")
    rows = settle(spark.read.csv(path, header=True, schema="user_name string, group_id string", mode="FAILFAST", emptyValue=""))
    wrong = rows.where("coalesce(user_name, '') = '' OR coalesce(group_id, '') = ''")
    twice = rows.groupBy("user_name").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    if not wrong.isEmpty() or not twice.isEmpty():
        raise SourceError("peer groups have an invalid or repeated user")
    return rows


def kafka_records(messages: DataFrame, source_id: str, source_type: str) -> DataFrame:
    """Messages (topic, partition, offset, timestamp, value), of a stream too, as raw records."""
    text = F.make_valid_utf8(F.col("value").cast("string"))
    place = F.concat_ws(":", F.lit(source_id), "topic", F.col("partition").cast("string"), F.col("offset").cast("string"))
    return messages.select(
        F.sha2(place, 256).alias("record_id"), F.lit(source_id).alias("source_id"), F.lit(source_type).alias("source_type"), text.alias("raw_text"), F.concat(F.lit("sha256:"), F.sha2(text, 256)).alias("checksum"), F.octet_length(text).alias("size_bytes"),
        F.concat(F.lit("kafka://"), "topic", F.lit("/"), "partition", F.lit("/"), "offset").alias("storage_ref"), F.col("topic").alias("kafka_topic"), F.col("partition").alias("kafka_partition"), F.col("offset").alias("kafka_offset"), F.unix_millis("timestamp").alias("kafka_timestamp_ms"),
    )


def kafka_stream(spark: SparkSession, config: dict[str, Any]) -> DataFrame:
    """The messages of the topics of a configuration, as a stream. Needs the Kafka connector on the class path."""
    options = {"kafka.bootstrap.servers": config["bootstrap_servers"], "subscribe": ",".join(config["topics"]), "kafka.group.id": config["group_id"], "startingOffsets": config.get("auto_offset_reset", "earliest")}
    for name in ("security_protocol", "sasl_mechanism", "ssl_ca_location"):
        if config.get(name):
            options["kafka." + {"ssl_ca_location": "ssl.truststore.location"}.get(name, name.replace("_", "."))] = config[name]
    return spark.readStream.format("kafka").options(**options).load()
