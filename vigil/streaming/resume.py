"""Parsing of files in steps that may stop behind any record and go on from there.

Records have places in one order: files as they are listed, records of a file by number. They are staged once, sorted by
place; a step reads its places alone, appends to each sink, and commits its cursor, the sinks' lengths and the quality
counts in one manifest. What a lost step left behind the committed lengths is cut off before the next one.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import parsing
from ..operators import quality
from ..sources import files
from ..sources.state import StateError, StateTable, discard, settle

VERSION = 1
#: Hashes that are joined to one of the next level, and levels: enough for 10^14 records.
FAN, LEVELS = 4096, 4
SINKS = ("normalized", "unknown")
ROWS_A_PART = 200_000


def record_hash() -> Column:
    return F.sha2(F.concat_ws("\0", "record_id", "checksum"), 256)


def ordered_chain(records: DataFrame, keys: list[str], index: str) -> DataFrame:
    """keys, n and chain of the records of each key in the order of index (unique in a key, from 0).

    Splits of FAN consecutive records are hashed, and the hashes of FAN splits in a row, and so on: any task can hash a
    split, and another record, order or count gives another chain. No group is larger than FAN.
    """
    rows = records.select(*keys, F.col(index).cast("long").alias("_i"), record_hash().alias("_h"), F.lit(1).cast("long").alias("_n"))
    for _ in range(LEVELS):
        joined = F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_h"))), lambda x: x["_h"]), ""), 256)
        rows = rows.groupBy(*keys, F.floor(F.col("_i") / FAN).alias("_up")).agg(joined.alias("_h"), F.sum("_n").alias("_n")).select(*keys, F.col("_up").alias("_i"), "_h", "_n")
    return rows.select(*keys, F.col("_n").alias("n"), F.col("_h").alias("chain"))


class Sink:
    """JSON lines in a folder of steps, each a folder of parts; in the order of their names they are one run of bytes."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self._path = spark, folder, spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def _steps(self) -> list[str]:
        at = self._path(self.folder)
        return sorted(f.getPath().getName() for f in self._fs.listStatus(at) if f.isDirectory()) if self._fs.exists(at) else []

    def parts(self) -> list[tuple[str, int]]:
        """Path and bytes of every part, in order."""
        out = []
        for step in self._steps():
            found = [f for f in self._fs.listStatus(self._path(f"{self.folder}/{step}")) if f.isFile() and f.getPath().getName().startswith("part-")]
            out += sorted((f.getPath().toString(), f.getLen()) for f in found)
        return out

    def length(self) -> int:
        return sum(n for _, n in self.parts())

    def cut_back(self, steps: int, length: int) -> None:
        """Removes what lies behind the committed steps; StateError where less is left than was committed."""
        for step in self._steps():
            if step >= f"step-{steps:09d}":
                self._fs.delete(self._path(f"{self.folder}/{step}"), True)
        if self.length() != length:
            raise StateError(f"{self.folder} has {self.length()} bytes where {length} were committed")

    def append(self, rows: DataFrame, step: int, parts: int) -> None:
        """rows as JSON in the order of place, a column that is left out. They are written out behind the shuffle: names of
        fields are not sent with every row."""
        names = [c for c in rows.columns if c != "place"]
        rows = rows.repartitionByRange(parts, "place").sortWithinPartitions("place")
        rows.select(F.to_json(F.struct(*names), {"ignoreNullFields": "false"}).alias("document")).write.text(f"{self.folder}/step-{step:09d}")


def _manifest(spark: SparkSession, units: list[dict[str, Any]]) -> list[list]:
    """What pins the input: each file's name, source, bytes and time of change."""
    out = []
    for u in units:
        at = spark._jvm.org.apache.hadoop.fs.Path(u["path"])
        s = at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at)
        out.append([u["unit_id"], u["path"], s.getLen(), s.getModificationTime()])
    return out


def _framed(spark: SparkSession, units: list[dict[str, Any]]) -> DataFrame:
    """Records of the files with unit (place of the file in the list) and number (from 0) within it. A file that is
    listed twice counts twice."""
    out = None
    for i in sorted({int(u["unit_id"].split(":")[1]) for u in units}):
        own = [(u["path"], k) for k, u in enumerate(units) if int(u["unit_id"].split(":")[1]) == i]
        source = next(u["source"] for u in units if int(u["unit_id"].split(":")[1]) == i)
        rows = files.source_records(spark, [{**source, "source_id": source.get("source_id", f"source-{i}"), "paths": sorted({p for p, _ in own})}])
        rows = rows.join(F.broadcast(spark.createDataFrame(own, "_path string, unit int")), F.col("file_path") == F.col("_path")).drop("_path")  # a row a file
        out = rows if out is None else out.unionByName(rows)
    return out.withColumn("number", (F.col("record_index") - 1).cast("long"))


def _staged(spark: SparkSession, units: list[dict[str, Any]], folder: str) -> tuple[str, list[int]]:
    """Writes the records of all files sorted by place (number in the whole order, from 0); records of each file."""
    rows = settle(_framed(spark, units))
    counted = {r.unit: r.n for r in rows.groupBy("unit").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a file
    counts = [counted.get(i, 0) for i in range(len(units))]
    first = spark.createDataFrame([(i, sum(counts[:i])) for i in range(len(units))], "unit int, _first long")
    placed = rows.join(F.broadcast(first), "unit").withColumn("place", F.col("_first") + F.col("number")).drop("_first")
    path = f"{folder}/staged"
    placed.repartitionByRange(max(1, -(-sum(counts) // ROWS_A_PART)), "place").sortWithinPartitions("place").write.mode("overwrite").parquet(path)
    discard(rows)
    return path, counts


def _chain_at(rows: DataFrame, unit: int, number: int) -> str:
    """The chain of a file's records up to a number."""
    found = ordered_chain(rows.where((F.col("unit") == unit) & (F.col("number") <= number)), ["unit"], "number").first()
    return "" if found is None or found.n != number + 1 else found.chain


def parse_files(spark: SparkSession, sources: list[dict[str, Any]], folder: str, parsers: list[dict[str, Any]] | None = None, every: int = 10_000_000, most: int | None = None, resume: bool = False) -> dict[str, Any]:
    """Parses all files of sources into folder/normalized and folder/unknown (JSON lines) and folder/state, every so many
    records a step; most: stops behind so many records, of which the last may lie anywhere in a file.

    With resume it goes on behind the committed cursor: the bytes of the sinks, the counts and the chain become those of
    a run that never stopped. Refused (StateError) are other sources, parsers or folders than the state was made with,
    files that changed since, a file whose records up to the cursor have another chain, sinks that are shorter than
    committed, and a first run into a folder that has state. Returns the notes: records, status, cursor and lengths.
    Files without records and an empty list of files give empty sinks.
    """
    units = files.source_files(spark, sources)
    table = StateTable(spark, f"{folder}/state", VERSION, {"sources": sources, "parsers": parsers or [], "folder": folder})
    sinks, notes = {k: Sink(spark, f"{folder}/{k}") for k in SINKS}, table.notes()
    if not resume and notes:
        raise StateError("the folder has state: resume, or take another one")
    if resume and not notes:
        raise StateError("there is nothing to resume")
    manifest = _manifest(spark, units)
    if not notes:
        path, counts = _staged(spark, units, folder) if units else ("", [])
        notes = {"manifest": manifest, "staged": path, "counts": counts, "records": 0, "steps": 0, "lengths": dict.fromkeys(SINKS, 0), "cursor": None, "status": "running"}
        table.note(notes)
    elif notes["manifest"] != manifest:
        raise StateError("the input files are not those of the state")
    for k, sink in sinks.items():
        sink.cut_back(notes["steps"], notes["lengths"][k])
    cursor, total = notes["cursor"], sum(notes["counts"])
    if resume and cursor and notes["status"] != "complete" and _chain_at(_framed(spark, [units[cursor["unit"]]]).withColumn("unit", F.lit(cursor["unit"])), cursor["unit"], cursor["number"]) != cursor["chain"]:
        raise StateError("the records up to the cursor have changed")
    end = total if most is None else min(total, notes["records"] + most)
    while notes["records"] < end:
        notes = _step(spark, table, sinks, notes, min(end, notes["records"] + every), parsers)
    if notes["records"] == total and notes["status"] != "complete":
        notes = {**notes, "status": "complete"}
        table.note(notes)
    return notes


def _step(spark: SparkSession, table: StateTable, sinks: dict[str, Sink], notes: dict[str, Any], end: int, parsers: list[dict[str, Any]] | None) -> dict[str, Any]:
    """Parses the places from the committed ones to end and commits."""
    begin, counts = notes["records"], notes["counts"]
    staged = spark.read.parquet(notes["staged"])
    rows = staged.where((F.col("place") >= begin) & (F.col("place") < end))
    good, unknown = parsing.routed(rows, parsers, "place")
    parts = max(1, -(-(end - begin) // ROWS_A_PART))
    events, rest = good.drop("place"), unknown.drop("place")
    for kind, df in zip(SINKS, (good, unknown), strict=True):  # a record goes with its place: no join finds it again
        sinks[kind].append(df, notes["steps"], parts)
    unit = next(i for i in range(len(counts)) if sum(counts[: i + 1]) >= end)
    number = end - 1 - sum(counts[:unit])
    cursor = {"unit": unit, "number": number, "chain": _chain_at(staged, unit, number)}
    known, now = table.current()[1], quality.snapshot(events, rest)
    notes = {**notes, "records": end, "steps": notes["steps"] + 1, "lengths": {k: s.length() for k, s in sinks.items()}, "cursor": cursor}
    table.commit(settle(quality.bounded(settle(now if known is None else quality.merged(known, now)))), notes)
    discard(good)  # the records as parsed
    return notes
