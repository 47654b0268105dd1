"""A broker in a folder: topics with partitions, messages with offsets, groups with committed offsets.

It stands in for a message broker where there is none, as in tests and on one machine: the stream reader is a Python data
source with the columns of Spark's Kafka source, so that what reads one reads the other. The folder must be one that the
driver and all executors see under the same path.
"""

from __future__ import annotations

import base64
import bisect
import datetime
import json
import os
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from .state import write_json

MESSAGES = "topic string, partition int, offset long, timestamp timestamp, value binary"
#: Messages of a segment file, as produce writes them, and of a task that reads.
SEGMENT, SPAN = 10_000, 100_000


class BrokerError(RuntimeError):
    pass


class Broker:
    """Messages lie in segments, a file each of JSON lines (milliseconds, value in base64), named by first and next offset."""

    def __init__(self, folder: str):
        self.folder = folder

    def _partition(self, topic: str, partition: int) -> str:
        return f"{self.folder}/topics/{topic}/{partition}"

    def _segments(self, topic: str, partition: int) -> list[tuple[int, int]]:
        at = self._partition(topic, partition)
        names = (n.removesuffix(".jsonl").split("-") for n in os.listdir(at) if n.endswith(".jsonl")) if os.path.isdir(at) else ()
        return sorted((int(a), int(b)) for a, b in names)

    def ends(self, topics: list[str]) -> dict[str, dict[str, int]]:
        """By topic and partition the next offset to be given."""
        out: dict[str, dict[str, int]] = {}
        for topic in topics:
            at = f"{self.folder}/topics/{topic}"
            parts = sorted((int(p) for p in os.listdir(at)), key=int) if os.path.isdir(at) else []
            out[topic] = {str(p): max((b for _, b in self._segments(topic, p)), default=0) for p in parts}
        return out

    def write(self, topic: str, partition: int, first: int, messages: list[tuple[int, bytes]]) -> None:
        """A segment (milliseconds, value) that begins at offset first; written again it stays the same."""
        at = self._partition(topic, partition)
        os.makedirs(at, exist_ok=True)
        name = f"{at}/{first:020d}-{first + len(messages):020d}.jsonl"
        beside = f"{name}.{os.getpid()}"
        with open(beside, "w", encoding="ascii") as f:
            f.writelines(json.dumps([ms, base64.b64encode(v).decode()]) + "\n" for ms, v in messages)
        os.replace(beside, name)

    def send(self, topic: str, partition: int, values: list[bytes | str], ms: int = 0) -> None:
        """Messages behind those that are there. For one sender at a time."""
        first = self.ends([topic])[topic].get(str(partition), 0)
        if values:
            self.write(topic, partition, first, [(ms, v.encode() if isinstance(v, str) else v) for v in values])

    def read(self, topic: str, partition: int, start: int, end: int) -> Iterator[tuple[int, int, bytes]]:
        """Offset, milliseconds and value of the messages from start to end."""
        segments = self._segments(topic, partition)
        for a, b in segments[max(0, bisect.bisect_right([a for a, _ in segments], start) - 1) :]:
            if a >= end:
                break
            if b > start:
                with open(f"{self._partition(topic, partition)}/{a:020d}-{b:020d}.jsonl", encoding="ascii") as f:
                    for offset, line in enumerate(f, a):
                        if start <= offset < end:
                            ms, value = json.loads(line)
                            yield offset, ms, base64.b64decode(value)

    def committed(self, group: str) -> dict[str, dict[str, int]]:
        path = f"{self.folder}/groups/{group}.json"
        if not os.path.exists(path):
            return {}
        with open(path, encoding="utf-8") as f:
            return json.load(f)

    def commit(self, group: str, offsets: dict[str, dict[str, int]]) -> None:
        """Notes the next offsets of a group's topics and partitions; BrokerError while commits are refused."""
        if os.path.exists(f"{self.folder}/refusing"):
            raise BrokerError("the broker refuses commits")
        os.makedirs(f"{self.folder}/groups", exist_ok=True)
        known = self.committed(group)
        write_json(f"{self.folder}/groups/{group}.json", {**known, **{t: {**known.get(t, {}), **ps} for t, ps in offsets.items()}})

    def refuse(self, refusing: bool = True) -> None:
        """From now on commits fail, or succeed again."""
        os.makedirs(self.folder, exist_ok=True)
        path = f"{self.folder}/refusing"
        if refusing:
            open(path, "w").close()
        elif os.path.exists(path):
            os.remove(path)


class Span(InputPartition):
    def __init__(self, topic: str, partition: int, start: int, end: int):
        self.topic, self.partition, self.start, self.end = topic, partition, start, end


class BrokerReader(DataSourceStreamReader):
    """Reads from the offsets of startingOffsets (topic, partition, next offset), else those the group has committed,
    else the first ones. Offsets are committed by whoever has stored results, never by the reader."""

    def __init__(self, options: dict[str, str]):
        self.broker, self.topics = Broker(options["folder"]), options["subscribe"].split(",")
        self.given = json.loads(options.get("startingOffsets") or "{}") or self.broker.committed(options.get("group", ""))

    def initialOffset(self) -> dict[str, Any]:
        return {t: {p: int(self.given.get(t, {}).get(p, 0)) for p in ps} for t, ps in self.broker.ends(self.topics).items()}

    def latestOffset(self) -> dict[str, Any]:
        return self.broker.ends(self.topics)

    def partitions(self, start: dict, end: dict) -> list[Span]:
        out = []
        for t, ps in end.items():
            for p, last in ps.items():
                first = int(start.get(t, {}).get(p, self.given.get(t, {}).get(p, 0)))
                out += [Span(t, int(p), a, min(a + SPAN, last)) for a in range(first, last, SPAN)]
        return out

    def read(self, partition: Span) -> Iterator[tuple]:
        for offset, ms, value in self.broker.read(partition.topic, partition.partition, partition.start, partition.end):
            yield partition.topic, partition.partition, offset, datetime.datetime.fromtimestamp(ms / 1000, datetime.timezone.utc), value

    def commit(self, end: dict) -> None:
        pass


class BrokerSource(DataSource):
    """Options: folder, subscribe (topics, comma-separated), group, startingOffsets (JSON)."""

    @classmethod
    def name(cls) -> str:
        return "folder_broker"

    def schema(self) -> str:
        return MESSAGES

    def streamReader(self, schema: Any) -> BrokerReader:
        return BrokerReader(dict(self.options))


def stream(spark: SparkSession, folder: str, topics: list[str], group: str, offsets: dict[str, dict[str, int]] | None = None) -> DataFrame:
    """The messages of topics as a stream, from offsets if given, else from those the group has committed."""
    spark.dataSource.register(BrokerSource)
    options = {"folder": folder, "subscribe": ",".join(topics), "group": group, "startingOffsets": json.dumps(offsets or {})}
    return spark.readStream.format("folder_broker").options(**options).load()


def produce(rows: DataFrame, folder: str, topic: str) -> DataFrame:
    """Writes rows (partition, value) as the messages of a new topic, in the order of value; partition, messages.

    A partition is written by one task, segment by segment, as a broker's partition is one log.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        broker, at, held = Broker(folder), {}, {}

        def flush(p: int) -> None:
            broker.write(topic, p, at.get(p, 0), [(0, v) for v in held.pop(p)])

        for batch in batches:
            for p, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held.setdefault(p, []).append(v)
                if len(held[p]) == SEGMENT:
                    flush(p)
                    at[p] = at.get(p, 0) + SEGMENT
        sizes = {p: at.get(p, 0) + len(held.get(p, ())) for p in {*at, *held}}
        for p in list(held):
            flush(p)
        yield pa.record_batch([pa.array(list(sizes), pa.int32()), pa.array(list(sizes.values()), pa.int64())], ["partition", "messages"])

    rows = rows.select("partition", F.col("value").cast("binary").alias("value")).repartition("partition").sortWithinPartitions("partition", "value")
    return rows.mapInArrow(write, "partition int, messages long")
