"""State tables by key: every part holds rows of one bucket of keys, so that looking up and changing keys touches no others."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .state import StateTable, unsorted_writes, write_dealt

#: So many changed keys go to every task, and leave the other rows where they lie; more are joined by a shuffle.
FEW_KEYS = 100_000
#: Buckets with fewer bytes than this together are written as one file each on every change.
SMALL_BYTES = 1_000_000


class KeyedTable(StateTable):
    """A StateTable whose rows are dealt into buckets by a hash of key, and which knows in which revision a row was written.

    Parts are named by bucket, rows in them lie in the order of key, so that Parquet's statistics skip the rows of other
    keys. Reading or changing some keys reads the parts of their buckets alone, and a change writes those again; adding
    writes only what is added, until a bucket has most_parts parts, which then become one. The number of buckets belongs
    to the table's configuration.

    The hash is the one that deals rows to tasks, so rows that are dealt by key to a multiple of the buckets (tasks_for)
    lie in one bucket a task: a table without rows takes them as they are, and dealt reads them so.
    """

    def __init__(self, spark: SparkSession, folder: str, version: int, config: dict, key: str, buckets: int = 64, most_parts: int = 16):
        super().__init__(spark, folder, version, {**config, "key": key, "buckets": buckets, "hash": "murmur3"})
        self.key, self.buckets, self.most_parts = key, buckets, most_parts
        self._dealt: tuple[int, DataFrame] | None = None

    def bucket(self) -> Column:
        return F.pmod(F.hash(F.col(self.key)), F.lit(self.buckets)).cast("int")

    def tasks_for(self, tasks: int) -> int:
        """At least so many tasks, a multiple of the buckets."""
        return -(-tasks // self.buckets) * self.buckets

    def dealt(self) -> DataFrame | None:
        """All rows as this process dealt them to tasks, where nobody has changed the table since; else None."""
        return self._dealt[1] if self._dealt is not None and self._dealt[0] == self.manifest()["rev"] else None

    def buckets_of(self, keys: DataFrame) -> set[int]:
        return {r[0] for r in keys.select(self.bucket()).distinct().collect()}  # as many as buckets, at most

    @staticmethod
    def _bucket_of(part: str) -> int:
        return int(part.rpartition("=")[2])

    def parts_of(self, buckets: set[int]) -> list[str]:
        return [p for p in self.manifest()["parts"] if self._bucket_of(p) in buckets]

    def _load(self, parts: list[str]) -> DataFrame | None:
        """Rows of parts with _revision; of no parts, no rows of the table's columns; None where it has none yet."""
        every = self.manifest()["parts"]
        if not every:
            return None
        if parts:
            return self.spark.read.parquet(*[f"{self.folder}/{p}" for p in parts])
        return self.spark.read.parquet(f"{self.folder}/{every[0]}").where(F.lit(False))

    def current(self) -> tuple[int, DataFrame | None]:
        held = self.manifest()
        rows = self._load(held["parts"])
        return held["rev"], None if rows is None else rows.drop("_revision")

    def of(self, keys: DataFrame) -> DataFrame | None:
        """The rows of keys (a column named as the table's key), from the parts of their buckets."""
        rows = self._load(self.parts_of(self.buckets_of(keys)))
        return None if rows is None else rows.drop("_revision").join(keys.select(self.key).distinct(), self.key, "left_semi")

    def lookup(self, *keys: Any) -> DataFrame | None:
        """The rows of a few given keys; their values are pushed down to the parts of their buckets."""
        kind = next(f.dataType for f in rows.schema if f.name == self.key) if (rows := self.current()[1]) is not None else None
        if kind is None:
            return None
        wanted = self.spark.createDataFrame([(k,) for k in keys], self.key + " " + kind.simpleString())
        return self._load(self.parts_of(self.buckets_of(wanted))).where(F.col(self.key).isin(*keys)).drop("_revision")

    def changed_since(self, rev: int) -> DataFrame | None:
        """Keys of rows that were written after a revision, from the parts that were."""
        held = self.manifest()
        known = set((self._read(rev) or {"parts": []})["parts"]) if rev else set()
        rows = self._load([p for p in held["parts"] if p not in known])
        return None if rows is None else rows.where(F.col("_revision") > rev).select(self.key).distinct()

    def _write_buckets(self, rows: DataFrame) -> list[str]:
        part = f"part-{uuid.uuid4().hex}"
        # a bucket's rows come together and are split where they are many (AQE): nothing is counted or sampled before
        rows = rows.withColumn("_bucket", self.bucket()).hint("rebalance", "_bucket").sortWithinPartitions("_bucket", self.key)
        return self._put(rows, part)

    def _put(self, rows: DataFrame, part: str) -> list[str]:
        with unsorted_writes(self.spark, self.buckets):  # rows come by bucket, and stay in the order of key
            rows.write.partitionBy("_bucket").parquet(f"{self.folder}/{part}")
        return self._folders(part)

    def _folders(self, part: str) -> list[str]:
        found = self._fs.listStatus(self._path(f"{self.folder}/{part}"))
        return sorted(f"{part}/{f.getPath().getName()}" for f in found if f.isDirectory() and f.getPath().getName().startswith("_bucket="))

    @staticmethod
    def _few(keys: DataFrame) -> bool:
        return keys.limit(FEW_KEYS + 1).count() <= FEW_KEYS

    def _deal(self, held: dict, parts: Sequence[DataFrame], tasks: int, notes: dict | None, ordered: bool = False) -> int:
        """Rows of parts (with _revision) as all that the table has, dealt by key and written once."""
        part = f"part-{uuid.uuid4().hex}"
        rows = write_dealt(self.key, tasks, f"{self.folder}/{part}", [p.withColumn("_bucket", self.bucket()) for p in parts], "_bucket", ordered)
        rev = self._next(held, self._folders(part), notes)
        self._dealt = (rev, rows.drop("_bucket", "_revision"))
        return rev

    def add(self, rows: DataFrame, notes: dict | None = None, tasks: int | None = None) -> int:
        """rows beside what is there; nothing that is there is read, but for buckets of too many parts. tasks: as for replace."""
        held = self.manifest()
        rev = self._upcoming(held)
        counts: dict[int, int] = {}
        for p in held["parts"]:
            counts[self._bucket_of(p)] = counts.get(self._bucket_of(p), 0) + 1
        full = {b for b, n in counts.items() if n >= self.most_parts}
        rows = rows.withColumn("_revision", F.lit(rev).cast("long"))
        if tasks is not None and not held["parts"]:
            return self._deal(held, [rows], tasks, notes, ordered=True)
        if full:
            rows = self._load(self.parts_of(full)).unionByName(rows)
        return self._next(held, [p for p in held["parts"] if self._bucket_of(p) not in full] + self._write_buckets(rows), notes)

    def replace(self, rows: DataFrame | Sequence[DataFrame], keys: DataFrame, notes: dict | None = None, tasks: int | None = None) -> int:
        """rows in the place of all that the table has of keys; rows of other keys in the same buckets stay as they are.

        rows may come in several parts of the same columns. With tasks (of tasks_for) a table without rows gets them
        dealt to so many tasks: what is dealt so already is neither shuffled nor sorted, and dealt has it for those who
        read on.
        """
        held = self.manifest()
        rev, touched = self._upcoming(held), self.buckets_of(keys)
        parts = [df.withColumn("_revision", F.lit(rev).cast("long")) for df in ([rows] if isinstance(rows, DataFrame) else rows)]
        if tasks is not None and not held["parts"]:
            return self._deal(held, parts, tasks, notes)
        rows = reduce(DataFrame.unionByName, parts)
        old, kept = self._load(self.parts_of(touched)), []
        gone = keys.select(self.key).distinct()
        if old is not None:
            few = self._few(gone)
            rest = old.join(F.broadcast(gone) if few else gone, self.key, "left_anti").select(*rows.columns)
            if not few or self._bytes(touched) < SMALL_BYTES:
                rows = rest.unionByName(rows)
            else:  # what stays lies in its buckets, in order: it is written from where it is read, without a shuffle
                kept = self._put(rest.withColumn("_bucket", self.bucket()), f"part-{uuid.uuid4().hex}")
        return self._next(held, [p for p in held["parts"] if self._bucket_of(p) not in touched] + kept + self._write_buckets(rows), notes)

    def _bytes(self, buckets: set[int]) -> int:
        return sum(self._fs.getContentSummary(self._path(f"{self.folder}/{p}")).getLength() for p in self.parts_of(buckets))
