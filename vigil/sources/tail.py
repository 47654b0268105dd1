"""What was added to a file that only grows, with digests of its blocks, so that a run reads little of what it knows."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession

from .state import StateError

#: Bytes of a block that is hashed, and of a task's span of lines.
BLOCK, SPAN = 8 << 20, 32 << 20
#: Old blocks that a run looks at again, besides as many as were added.
RECHECKED = 4
LINES_A_BATCH = 10_000


def opened(path: str):
    """The file for reading at any place, in any file system that Arrow knows, and its length."""
    fs, name = pyarrow.fs.FileSystem.from_uri(path)
    return fs.open_input_file(name), fs.get_file_info(name).size


def _last_line_end(path: str, begin: int) -> int:
    """The place behind the last line end from begin on; begin where there is none."""
    file, size = opened(path)
    with file:
        at = size
        while at > begin:
            first = max(begin, at - (1 << 20))
            found = file.read_at(at - first, first).rfind(b"\n")
            if found >= 0:
                return first + found + 1
            at = first
    return begin


def block_digests(spark: SparkSession, path: str, ranges: list[tuple[int, int]]) -> list[str]:
    """SHA-256 of each range of bytes, a task each."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                made = hashlib.sha256()
                file, _ = opened(path)
                with file:
                    for at in range(a, b, 1 << 20):
                        made.update(file.read_at(min(1 << 20, b - at), at))
                out.append(made.hexdigest())
            yield pa.record_batch([batch.column(0), pa.array(out, pa.string())], ["a", "digest"])

    if not ranges:
        return []
    rows = spark.createDataFrame(ranges, "a long, b long").repartition(min(len(ranges), 10_000))
    found = {r.a: r.digest for r in rows.mapInArrow(digest, "a long, digest string").toLocalIterator()}
    return [found[a] for a, _ in ranges]


def lines_between(spark: SparkSession, path: str, begin: int, end: int) -> DataFrame:
    """text of the lines that begin between two places, of which each lies behind a line end; by spans, a task each."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                file, _ = opened(path)
                with file:
                    held: list[str] = []
                    at = a
                    if a > begin:  # the line that the span begins in is that of the span before
                        file.seek(a - 1)
                        rest = b""
                        while b"\n" not in rest and (more := file.read(1 << 16)):
                            rest, at = more, file.tell()
                        at = at - len(rest) + rest.find(b"\n") + 1
                    file.seek(at)
                    rest = b""
                    while at < b:
                        more = file.read(min(1 << 20, end - file.tell()))
                        if not more:
                            break
                        *whole, rest = (rest + more).split(b"\n")
                        for line in whole:
                            if at >= b:
                                break
                            held.append(line.decode("utf-8", "replace"))
                            at += len(line) + 1
                        while len(held) >= LINES_A_BATCH:
                            yield pa.record_batch([pa.array(held[:LINES_A_BATCH], pa.string())], ["text"])
                            del held[:LINES_A_BATCH]
                    yield pa.record_batch([pa.array(held, pa.string())], ["text"])

    spans = [(a, min(a + SPAN, end)) for a in range(begin, end, SPAN)]
    if not spans:
        return spark.createDataFrame([], "text string")
    return spark.createDataFrame(spans, "a long, b long").repartition(min(len(spans), 10_000)).mapInArrow(read, "text string")


def appended(spark: SparkSession, path: str, known: dict[str, Any]) -> tuple[DataFrame, dict[str, Any]]:
    """The lines (text) behind what is known of a file, and what is known then: offset (behind the last whole line),
    blocks (a digest of each whole block before it), tail (of the rest), turn and bytes_read.

    known is {} at first. The tail is always compared with its digest; of the whole blocks as many are as were added,
    and RECHECKED more, in turns, so that all of them are compared again and again while a run reads no more than about
    twice what was added. A file that is shorter, or whose compared bytes differ, raises StateError. A last line without
    its end is left for later.
    """
    offset, blocks, turn = known.get("offset", 0), list(known.get("blocks", ())), known.get("turn", 0)
    file, size = opened(path)
    file.close()
    if size < offset:
        raise StateError("the file is shorter than what was read of it")
    end, whole = _last_line_end(path, offset), len(blocks)
    added = end // BLOCK - whole
    again = sorted({(turn + i) % whole for i in range(min(whole, max(0, added) + RECHECKED))}) if whole else []
    old = [(i * BLOCK, (i + 1) * BLOCK) for i in again] + ([(whole * BLOCK, offset)] if offset > whole * BLOCK else [])
    new = [(i * BLOCK, (i + 1) * BLOCK) for i in range(whole, end // BLOCK)] + ([(end - end % BLOCK, end)] if end % BLOCK else [])
    if block_digests(spark, path, old) != [blocks[i] for i in again] + ([known["tail"]] if offset > whole * BLOCK else []):
        raise StateError("what was read before is no longer what the file begins with")
    digests = block_digests(spark, path, new)
    now = {"offset": end, "blocks": blocks + digests[: max(0, added)], "tail": digests[-1] if end % BLOCK else "", "turn": (turn + len(again)) % max(1, whole)}
    return lines_between(spark, path, offset, end), {**now, "bytes_read": sum(b - a for a, b in old + new) + end - offset}
