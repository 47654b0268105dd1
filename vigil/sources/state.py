"""Stage results kept apart from the plans that made them, and state tables with a guarded meaning."""

from __future__ import annotations

import hashlib
import json
import os
import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from typing import Any

from pyspark.sql import DataFrame, SparkSession


class StateError(RuntimeError):
    pass


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir of the session. Only where that is unset and all runs on this
    machine a local one is set; on a cluster that is refused."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    jdir = spark.sparkContext._jsc.sc().getCheckpointDir()
    if jdir.isEmpty():
        if not spark.sparkContext.master.startswith("local"):
            raise StateError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        jdir = spark.sparkContext._jsc.sc().getCheckpointDir()
    return jdir.get()


def settle(df: DataFrame) -> DataFrame:
    """df computed once and written as Parquet in the shared folder: later plans start from it, read only the columns
    they need, and an executor that goes takes nothing with it."""
    path = f"{shared_dir(df.sparkSession)}/settled-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Removes what settle wrote and df reads, for who has read it to the end."""
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if folder.rpartition("/")[2].startswith("settled-"):
            at = jvm.org.apache.hadoop.fs.Path(folder)
            at.getFileSystem(conf).delete(at, True)


def settle_by(key: str, tasks: int, *parts: DataFrame) -> DataFrame:
    """All rows of parts (of the same columns) settled in buckets of key, one to each of so many tasks: what is dealt so
    already is written where it is, and joins and groups of such tables by key, or by key and more, need no shuffle."""
    spark = parts[0].sparkSession
    return write_dealt(key, tasks, f"{shared_dir(spark)}/settled_{uuid.uuid4().hex}", parts)


def write_dealt(key: str, tasks: int, path: str, parts: Sequence[DataFrame], folders: str | None = None, ordered: bool = False) -> DataFrame:
    """settle_by at a path; with folders (a column) each of its values has a folder of its own. A task's rows are written
    as they come, or ordered by key."""
    spark, name = parts[0].sparkSession, f"dealt_{uuid.uuid4().hex}"
    # a join goes by the buckets of a part of its keys too
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    # a union of tables in buckets is planned as in buckets and may be run as not (Spark 4.1: "Can't zip RDDs")
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")
    # what is written as it is dealt is read so too: a task then has the users of one bucket and writes one file
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")
    with unsorted_writes(spark):
        for i, df in enumerate(parts):
            out = df.select(*parts[0].columns).repartition(tasks, key).write.format("parquet").mode("append" if i else "error").bucketBy(tasks, key)
            out = out.partitionBy(folders) if folders else out
            (out.sortBy(key) if ordered else out).option("path", path).saveAsTable(name)
    return spark.table(name)


@contextmanager
def unsorted_writes(spark: SparkSession, files: int = 16) -> Iterator[None]:
    """Writes within sort no rows by their bucket or folder, as long as a task has so many of them at most."""
    conf = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(conf)
    spark.conf.set(conf, str(files))
    try:
        yield
    finally:
        spark.conf.set(conf, before)


def fingerprint(config: Any) -> str:
    return hashlib.sha256(json.dumps(config, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def write_json(path: str, document: dict) -> None:
    """Written beside, flushed, then renamed: readers see the old or the new document."""
    folder = os.path.dirname(os.path.abspath(path))
    with tempfile.NamedTemporaryFile("w", dir=folder, delete=False, encoding="utf-8") as f:
        json.dump(document, f, sort_keys=True, ensure_ascii=False)
        f.flush()
        os.fsync(f.fileno())
    os.replace(f.name, path)


class StateTable:
    """A table as Parquet parts under a folder, and numbered manifests of which the newest names the parts.

    A manifest pins the schema version and the configuration's fingerprint: state made otherwise is refused. Manifests
    are only ever added, each in one exclusive creation, so a crash at any moment leaves the table as it was or as it
    is to be, and of two writers at most one succeeds. One that was not written to its end is passed over, on reading
    and on numbering the next. A manifest carries notes (such as offsets) that are committed with the data.

    This needs a file system whose listings are up to date and whose creation without overwriting is exclusive, as HDFS
    and local ones; over an object store without that, keep to one writer.
    """

    def __init__(self, spark: SparkSession, folder: str, version: int, config: dict):
        self.spark, self.folder, self.meta = spark, folder, {"version": version, "config": fingerprint(config)}
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def _numbers(self) -> list[int]:
        """Of all manifests, whole or not, newest first."""
        at = self._path(f"{self.folder}/manifests")
        if not self._fs.exists(at):
            return []
        names = (f.getPath().getName() for f in self._fs.listStatus(at))
        return sorted((int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n.removesuffix(".json").isdigit()), reverse=True)

    def _at(self, rev: int):
        return self._path(f"{self.folder}/manifests/{rev:012d}.json")

    def _read(self, rev: int) -> dict | None:
        """None where its writer was lost, or is not done."""
        stream = self._fs.open(self._at(rev))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode() or "null")
        except ValueError:
            return None
        finally:
            stream.close()

    @classmethod
    def newest(cls, spark: SparkSession, folder: str) -> dict:
        """The newest manifest of a table, by whatever version and configuration it was made."""
        table = cls(spark, folder, 0, {})
        found = next(filter(None, map(table._read, table._numbers())), None)
        if found is None:
            raise StateError(f"there is no table at {folder}")
        return found

    def manifest(self) -> dict:
        """rev (0 before the first commit), parts and notes."""
        held = next(filter(None, map(self._read, self._numbers())), None) or {**self.meta, "rev": 0, "parts": [], "notes": {}}
        if {k: held[k] for k in self.meta} != self.meta:
            raise StateError("the state was made by another version or configuration")
        return held

    def notes(self) -> dict:
        return self.manifest()["notes"]

    def current(self) -> tuple[int, DataFrame | None]:
        held = self.manifest()
        parts = [f"{self.folder}/{p}" for p in held["parts"]]
        return held["rev"], self.spark.read.parquet(*parts) if parts else None

    def _upcoming(self, held: dict) -> int:
        return max([held["rev"], *self._numbers()[:1]]) + 1

    def _next(self, held: dict, parts: list[str], notes: dict | None) -> int:
        """A manifest behind all others. Writers that passed one another over find that out: one looks for later numbers
        after its own is whole, the other for whole earlier ones after its number is taken."""
        rev = self._upcoming(held)
        taken = StateError(f"revision {rev} was committed by another writer")
        document = {**self.meta, "rev": rev, "parts": parts, "notes": held["notes"] if notes is None else notes}
        try:
            out = self._fs.create(self._at(rev), False)
        except Exception as error:
            raise taken from error
        try:
            if any(self._read(n) for n in self._numbers() if held["rev"] < n < rev):
                raise taken
            out.write(json.dumps(document, sort_keys=True).encode())
        finally:
            out.close()
        if self._numbers()[0] > rev:
            raise taken
        return rev

    def _write(self, df: DataFrame) -> str:
        part = f"part-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.folder}/{part}")
        return part

    def commit(self, df: DataFrame, notes: dict | None = None) -> int:
        """df in the place of the table."""
        held = self.manifest()
        return self._next(held, [self._write(df)], notes)

    def append(self, df: DataFrame, notes: dict | None = None, most_parts: int = 64) -> int:
        """df added to the table; nothing that is there is written again, but for every most_parts commits, when the
        parts become one."""
        held = self.manifest()
        parts = [*held["parts"], self._write(df)]
        if len(parts) > most_parts:
            parts = [self._write(self.spark.read.parquet(*[f"{self.folder}/{p}" for p in parts]))]
        return self._next(held, parts, notes)

    def vacuum(self) -> int:
        """Removes the parts that the newest manifest does not name; how many. For a time without writers, and without
        readers of older revisions."""
        held = {p.partition("/")[0] for p in self.manifest()["parts"]}
        old = [f.getPath() for f in self._fs.listStatus(self._path(self.folder)) if f.getPath().getName().startswith("part-") and f.getPath().getName() not in held] if self._fs.exists(self._path(self.folder)) else []
        for path in old:
            self._fs.delete(path, True)
        return len(old)

    def note(self, notes: dict) -> int:
        """New notes beside the same data."""
        held = self.manifest()
        return self._next(held, held["parts"], notes)


def in_step(what: str, consumed: int, current: int) -> None:
    """StateError where a stage was built from an older revision than its input now has."""
    if consumed != current:
        raise StateError(f"{what} is at revision {consumed} of its input, which is at {current}: build it first")
