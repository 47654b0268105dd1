"""Structured Streaming around the batch operators: events in micro-batches, every stage brought up to date for each."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import parsing
from ..operators import features, quality, sessions
from ..sources import broker, files, tail
from ..sources.state import StateError, StateTable, fingerprint, settle
from .resume import ordered_chain

VERSION = 3
MODES = ("replay", "realtime")


def _absorbed(table: StateTable, fields: DataFrame, notes: dict | None = None) -> tuple[DataFrame, int]:
    """What absorb adds, and the table's revision then."""
    rev, known = table.current()
    first = features.first_of_ids(fields)
    if known is not None:
        first = first.join(known.select("event_id"), "event_id", "left_anti")
    first = settle(first)
    if first.isEmpty():
        return first, rev if notes is None else table.note(notes)
    return first, table.append(first, notes)


def absorb(table: StateTable, fields: DataFrame, notes: dict | None = None) -> int:
    """Adds the events of a batch that the table does not know, in whatever order they arrive; none is dropped for being
    late. What is there is not written again. A batch that comes again changes nothing. Rejected ids are remembered
    beside accepted ones."""
    return _absorbed(table, fields, notes)[1]


def accepted(table: StateTable) -> DataFrame | None:
    known = table.current()[1]
    return None if known is None else known.where("reason IS NULL").drop("reason")


def run(stream: DataFrame, folder: str, checkpoint: str, downstream: Callable[[DataFrame, int], None], config: dict | None = None) -> StreamingQuery:
    """Starts a query over a stream of canonical events (nested, as features.admit takes them).

    For each micro-batch the events' state is committed first, then downstream(accepted events, batch id) runs, then
    Spark notes the batch as done: after a crash in between, the batch comes again and finds its events known. Ends
    when what is available has been read.
    """
    spark: SparkSession = stream.sparkSession
    table = StateTable(spark, folder, VERSION, config or {})

    def step(batch: DataFrame, number: int) -> None:
        absorb(table, features.admit(batch))
        events = accepted(table)
        if events is not None:
            downstream(events, number)

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _chain(rows: DataFrame) -> list[list]:
    """For each partition of a topic, or each file, how many records there are and their chain in order."""
    keys, index = (["kafka_topic", "kafka_partition"], "kafka_offset") if "kafka_offset" in rows.columns else (["file_path"], "line_start")
    return sorted([*map(str, r[:-2]), r.n, r.chain] for r in ordered_chain(rows, keys, index).toLocalIterator())


def _next_offsets(rows: DataFrame, known: dict[str, dict[str, int]]) -> dict[str, dict[str, int]]:
    out = {t: dict(ps) for t, ps in known.items()}
    for r in rows.groupBy("kafka_topic", "kafka_partition").agg(F.max("kafka_offset").alias("last")).collect():  # a row a partition
        out.setdefault(r.kafka_topic, {})[str(r.kafka_partition)] = r["last"] + 1
    return out


def _unseen(rows: DataFrame, offsets: dict[str, dict[str, int]]) -> DataFrame:
    """Messages behind the offsets that are known."""
    known = [(t, int(p), n) for t, ps in offsets.items() for p, n in ps.items()]
    if not known:
        return rows
    seen = F.broadcast(rows.sparkSession.createDataFrame(known, "kafka_topic string, kafka_partition int, _next long"))  # a row a partition
    return rows.join(seen, ["kafka_topic", "kafka_partition"], "left").where(F.col("_next").isNull() | (F.col("kafka_offset") >= F.col("_next"))).drop("_next").select(*rows.columns)


def parse_stream(
    records: DataFrame, folder: str, checkpoint: str, parsers: list[dict[str, Any]] | None = None, config: dict | None = None, commit: Callable[[dict[str, dict[str, int]]], None] | None = None
) -> StreamingQuery:
    """Starts a query that parses a stream of raw records (files.raw_records or files.kafka_records) into folder:
    normalized and unknown, a folder a batch, and the quality of all batches (state quality, see summary_of).

    A batch's outputs are written under the number of its commit, then its counts, a chain over all records in order and,
    of messages, the next offsets are committed, then commit(next offsets) tells the broker, then Spark notes its own. A
    run that was stopped anywhere goes on from there: outputs without a commit are written over, and messages behind the
    committed offsets alone are parsed, even where Spark's checkpoint is lost; records of files go by Spark's batch. A
    failing commit ends the query; the batch comes again, finds its messages known, and is told to the broker again.
    Other parsers, settings or folders than those the state was made with are refused.
    """
    spark: SparkSession = records.sparkSession
    table = parse_state(spark, folder, parsers, config)
    table.manifest()

    def step(batch: DataFrame, number: int) -> None:
        notes = table.notes()
        messages, offsets = "kafka_offset" in batch.columns, notes.get("offsets", {})
        if messages or notes.get("batch", -1) < number:
            rows = settle(_unseen(batch, offsets) if messages else batch)
            if not rows.isEmpty() or not messages:
                at = notes.get("commits", 0)
                good, unknown = parsing.routed(rows, parsers)
                good.write.mode("overwrite").parquet(f"{folder}/normalized/batch={at}")
                unknown.write.mode("overwrite").parquet(f"{folder}/unknown/batch={at}")
                known = table.current()[1]
                counts = quality.snapshot(good, unknown)
                chained = _chain(rows)
                offsets = _next_offsets(rows, offsets) if messages else offsets
                notes = {"batch": number, "commits": at + 1, "chain": fingerprint([notes.get("chain", ""), chained]), "records": notes.get("records", 0) + sum(x[-2] for x in chained), "offsets": offsets}
                table.commit(settle(quality.bounded(settle(counts if known is None else quality.merged(known, counts)))), notes)
        if commit is not None and offsets:
            commit(offsets)

    return records.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def parse_state(spark: SparkSession, folder: str, parsers: list[dict[str, Any]] | None = None, config: dict | None = None) -> StateTable:
    """The state of parse_stream: quality counts, and notes with chain, records and next offsets."""
    return StateTable(spark, f"{folder}/quality", VERSION, {"parsers": parsers or [], "config": config or {}, "folder": folder})


def consume(spark: SparkSession, broker_folder: str, topics: list[str], group: str, source: tuple[str, str], folder: str, checkpoint: str, parsers: list[dict[str, Any]] | None = None) -> StreamingQuery:
    """parse_stream over the topics of a folder broker, as source (id and type): it begins at the offsets of its own
    state, else at those the group has committed, and commits to the group what its state has."""
    held = parse_state(spark, folder, parsers).notes().get("offsets")
    messages = broker.stream(spark, broker_folder, topics, group, held)
    return parse_stream(files.kafka_records(messages, *source), folder, checkpoint, parsers, commit=lambda offsets: broker.Broker(broker_folder).commit(group, offsets))


def parsed(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """The normalized events and unknown records of all committed batches of parse_stream."""
    done = StateTable.newest(spark, f"{folder}/quality")["notes"].get("commits", 0)
    return tuple(spark.read.option("basePath", f"{folder}/{kind}").parquet(f"{folder}/{kind}").where(F.col("batch") < done).drop("batch") for kind in ("normalized", "unknown"))


def follow(spark: SparkSession, path: str, folder: str, schema: str, downstream: Callable[[DataFrame, int | None], None], lag_s: int = 300, config: dict | None = None) -> dict[str, Any]:
    """Reads what was added to a file of canonical events (JSON lines) and brings everything up to date.

    Events are added to the state, the watermark moves to lag_s before the newest event (never back), sessions that
    ended before it are closed for good, downstream(accepted events, watermark) runs, and only then the place in the
    file, with digests of its blocks (tail.appended), is committed: after a crash the same lines come again and find
    their events known.
    """
    settings = {"lag_s": lag_s, "schema": schema, "path": path, **(config or {})}
    table, closed = StateTable(spark, f"{folder}/events", VERSION, settings), StateTable(spark, f"{folder}/sessions", VERSION, settings)
    progress = StateTable(spark, f"{folder}/progress", VERSION, settings)
    notes = progress.notes()
    lines, place = tail.appended(spark, path, notes.get("file", {}))
    canonical = lines.select(F.from_json("text", schema, {"mode": "FAILFAST"}).alias("e")).select("e.*")
    fresh, _ = _absorbed(table, features.admit(canonical))
    new, latest = fresh.agg(F.count(F.lit(1)), F.max(F.when(F.col("reason").isNull(), F.col("event_time_ms")))).first()
    events = accepted(table)
    if events is None:
        return {"offset": place["offset"], "new": 0, "watermark": None, "closed": 0, "bytes_read": place["bytes_read"]}
    if "newest" not in notes:  # also what a run added that did not come to its end
        latest = events.agg(F.max("event_time_ms")).first()[0]
    newest = max((t for t in (notes.get("newest"), latest) if t is not None), default=None)
    watermark = notes.get("watermark", -1) if newest is None else max(notes.get("watermark", -1), newest - lag_s * 1000)
    done = closed.current()[1]
    # events that lie in no closed session yet, whatever happened to the run before
    pool = events
    if done is not None:
        pool = events.join(_held(events, done), "event_id", "left_anti")
    base = sessions.none_closed(events) if done is None else done.drop("event_ids")
    now, left, _ = sessions.advance(base, pool.limit(0), pool, watermark)
    ended = now if done is None else now.join(done.select("session_id"), "session_id", "left_anti")
    ended = settle(_with_events(ended, pool))
    n = ended.count()
    if n:
        closed.append(ended)
    downstream(events, watermark)
    progress.note({"file": {k: v for k, v in place.items() if k != "bytes_read"}, "watermark": watermark, "newest": newest})
    return {"offset": place["offset"], "new": new, "watermark": watermark, "closed": n, "bytes_read": place["bytes_read"]}


def _with_events(closed: DataFrame, pool: DataFrame) -> DataFrame:
    """Closed sessions with the ids of their events: a later event of the same time is told from them."""
    day = lambda c: F.col(c) - F.pmod(F.col(c), F.lit(features.DAY_MS))
    spans = closed.select("session_id", "user_name", "start_time", "last_event_time", F.explode(F.sequence(day("start_time"), day("last_event_time"), F.lit(features.DAY_MS))).alias("_day"))
    met = pool.select("user_name", "event_id", "event_time_ms").withColumn("_day", day("event_time_ms")).join(spans, ["user_name", "_day"])
    own = met.where((F.col("event_time_ms") >= F.col("start_time")) & (F.col("event_time_ms") <= F.col("last_event_time"))).groupBy("session_id").agg(F.collect_list("event_id").alias("event_ids"))  # a session's own
    return closed.join(own, "session_id")


def _held(events: DataFrame, done: DataFrame) -> DataFrame:
    return done.select(F.explode("event_ids").alias("event_id"))


class Mode:
    """Whether a state is being filled from history (replay) or kept up to date (realtime): history comes first, once.

    A state that is kept up to date takes no history any more; history that is not finished cannot be kept up to date.
    """

    def __init__(self, table: StateTable):
        self.table = table

    def enter(self, mode: str) -> None:
        if mode not in MODES:
            raise StateError(f"unknown mode {mode}")
        notes = self.table.notes()
        held = notes.get("mode")
        if mode == "replay" and (held == "realtime" or notes.get("finished") or (held is None and self.table.current()[0])):
            raise StateError("the state holds history already: build a new one")
        if mode == "realtime" and held == "replay" and not notes.get("finished"):
            raise StateError("the history is not finished")
        if held != mode:
            self.table.note({**notes, "mode": mode})

    def finish(self) -> None:
        """History has ended: its sessions can be flushed."""
        notes = self.table.notes()
        if notes.get("mode") != "replay":
            raise StateError("only history can be finished")
        self.table.note({**notes, "finished": True})
