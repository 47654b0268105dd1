"""Exact removal of long repeats by prefix-free parsing.

Triggers, found by a rolling hash of the bytes alone, cut texts into phrases that overlap by a trigger. The phrases are the
dictionary; each text becomes a parse, a list of phrase names. Parses that agree tell repeats from phrase to phrase, and
where only the ends of a stretch differ, the orders of what precedes and what follows the agreeing phrases combine into
the order of the corpus, in which repeats are neighbours.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

LENGTH = 400
#: Bytes that are hashed for a trigger, and bytes before them in which the hash must not recur: with them they are the
#: trigger, by which phrases overlap. Runs and short periods so have no triggers.
HASHED, BEFORE = 16, 16
TRIGGER = HASHED + BEFORE
#: Bytes from trigger to trigger, on average.
SPACING = 128
BATCH_BYTES = 1 << 20
#: Rows of a group that are ordered in one task; larger groups are first split by more of their bytes.
GROUP_ROWS = 50_000
#: Rows that one call of repeated_windows takes, but for the end of a group.
CHUNK = 8000
#: Texts are shorter than 2^31 bytes; the rest of 64 bits is for hashes.
POSITION_BITS = 31
#: Bits of a phrase's name in the first attempt.
NAME_BITS = 128


def rolled(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of 2 * n bytes from those of n."""
    left, right = h[:-n], h[n:]
    return (left ^ (left >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + (right ^ (right >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)


def rolling_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """A hash of every k bytes (k a power of two), from those of halves."""
    h = (data.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    n = 1
    while n < k:
        h = rolled(h, n)
        n *= 2
    return h


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of every width values."""
    n, least = 1, x
    while 2 * n <= width:
        least = np.minimum(least[:-n], least[n:])
        n *= 2
    rest = width - n
    return np.minimum(least[: len(least) - rest], least[rest:]) if rest else least


def batches_of(column: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    """Texts of a batch as UTF-8 in groups of some BATCH_BYTES, with the first's row."""
    first, held, size = 0, [], 0
    for i, x in enumerate(column):
        raw = x.as_buffer().to_pybytes() if x.is_valid else b""
        held.append(raw)
        size += len(raw)
        if size >= BATCH_BYTES:
            yield first, held
            first, held, size = i + 1, [], 0
    if held:
        yield first, held


def keyed(docs: DataFrame, id: str, text: str) -> DataFrame:
    """doc_id, text (null as empty) and two hashes that name the row; rows with the same id and text have the same."""
    raw = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.xxhash64(F.lit(1), F.col(id)).alias("k1"), F.xxhash64(raw).alias("k2"), F.col(id).alias("doc_id"), raw.alias("text"))


def triggers(data: np.ndarray, h: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Places of the triggers in texts that stand one after another; h are the hashes of every HASHED bytes.

    Whether TRIGGER bytes are a trigger depends on them alone, wherever they stand.
    """
    at = np.flatnonzero(h < np.uint64((1 << 64) // SPACING))
    at = at[at >= BEFORE]
    for d in range(1, BEFORE + 1):
        at = at[h[at] != h[at - d]]
    at -= BEFORE
    owner = np.searchsorted(ends, at, side="right")
    return at[(at >= starts[owner]) & (at + TRIGGER <= ends[owner])]


def name(phrase: bytes, attempt: int, bits: int) -> tuple[int, int]:
    """Two signed numbers of 64 bits; later attempts hash otherwise and use twice the bits, up to 128."""
    whole = xxhash.xxh3_128_intdigest(phrase, attempt) & (1 << min(128, bits << attempt)) - 1
    low, high = whole & (1 << 64) - 1, whole >> 64
    return low - (low >> 63 << 64), high - (high >> 63 << 64)


def cuts_of(places: np.ndarray, start: int, end: int) -> list[int]:
    """Where the phrases of the text at start begin, in it."""
    lo, hi = np.searchsorted(places, [start, end])
    return [0, *(places[lo:hi] - start).tolist()]


def phrases_of(raw: bytes, cuts: list[int]) -> list[bytes]:
    """Each from its cut to the end of the trigger at the next one."""
    return [raw[a : b + TRIGGER] for a, b in zip(cuts, [*cuts[1:], len(raw)], strict=True)]


def bare_runs(data: np.ndarray, h: np.ndarray, places: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Runs of windows without two triggers, and so without a whole phrase: first window, windows, anchor, unit.

    A window's anchor is the first of the least hashes of TRIGGER bytes in it, so equal windows have equal anchors. A
    run has one anchor and one unit (see units).
    """
    wide = rolled(h, HASHED)
    mask = np.uint64((1 << POSITION_BITS) - 1)
    keyed = (wide & ~mask) | np.arange(len(wide), dtype=np.uint64)
    least = sliding_least(keyed, length - TRIGGER + 1)
    usable = np.maximum(ends - starts - length + 1, 0)
    x = np.repeat(starts, usable) + np.arange(usable.sum()) - np.repeat(np.cumsum(usable) - usable, usable)
    first = np.searchsorted(places, x)
    bare = np.searchsorted(places, x + length - TRIGGER, side="right") - first < 2
    x, first = x[bare], first[bare]
    anchor = (least[x] & mask).astype(np.int64)
    new = np.flatnonzero((np.diff(anchor, prepend=-1) != 0) | (np.diff(x, prepend=-9) != 1) | (np.diff(first, prepend=-1) != 0))
    own = np.searchsorted(ends, x[new], side="right")
    base = np.searchsorted(places, starts[own])
    unit = np.where(first[new] > base, places[np.maximum(first[new] - 1, 0)] + 1 if len(places) else 0, starts[own])
    return x[new], np.diff(new, append=len(x)), anchor[new], unit


def parsed_texts(rows: DataFrame, attempt: int = 0, bits: int = NAME_BITS, length: int = LENGTH) -> DataFrame:
    """The parse of every text of length and more: k1, k2, row (unique), size, cuts, the phrases' names (h1, h2), the
    bare runs (unit, start, n, before, g), and sure (start, n): windows that occur twice within runs of the text itself.

    Of bare runs with the same bytes the first stands for all.
    """
    names = ["k1", "k2", "row", "size", "cuts", "h1", "h2", "unit", "start", "n", "before", "g", "sure_start", "sure_n"]
    kinds = [pa.int64()] * 3 + [pa.int32()] + [pa.list_(pa.int32())] + [pa.list_(pa.int64())] * 2 + [pa.list_(pa.int32())] * 4 + [pa.list_(pa.int64())] + [pa.list_(pa.int32())] * 2

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            for first, texts in batches_of(batch.column(2)):
                out: list[list] = [[] for _ in names]
                for i, values in texts_parsed(texts):
                    number += 1
                    for column, v in zip(out, (batch.column(0)[first + i].as_py(), batch.column(1)[first + i].as_py(), number, *values), strict=True):
                        column.append(v)
                yield pa.record_batch([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names)

    def texts_parsed(texts: list[bytes]) -> Iterator[tuple[int, tuple]]:
        joined = b"".join(texts)
        if len(joined) < length:
            return
        data, sizes = np.frombuffer(joined, np.uint8), np.fromiter(map(len, texts), np.int64, len(texts))
        ends = np.cumsum(sizes)
        starts = ends - sizes
        h = rolling_hashes(data, HASHED)
        places = triggers(data, h, starts, ends)
        runs = bare_runs(data, h, places, starts, ends, length)
        hashes = rolled(h, HASHED)[runs[2]].view(np.int64).tolist()
        edges = np.searchsorted(runs[0], np.append(starts, ends[-1])).tolist()
        x, n, anchor, unit = (v.tolist() for v in runs)
        for i, raw in enumerate(texts):
            if len(raw) < length:
                continue
            s = int(starts[i])
            cuts = cuts_of(places, s, int(ends[i]))
            made = [name(p, attempt, bits) for p in phrases_of(raw, cuts)]
            seen: dict[bytes, int] = {}
            kept, sure = [], set()
            for k in range(edges[i], edges[i + 1]):
                same = raw[x[k] - s : x[k] - s + n[k] + length - 1]
                if same in seen:
                    sure |= {k, seen[same]}
                else:
                    seen[same] = k
                    kept.append(k)
            spans: list[list[int]] = []
            for k in sorted(sure):
                if spans and spans[-1][0] + spans[-1][1] == x[k] - s:
                    spans[-1][1] += n[k]
                else:
                    spans.append([x[k] - s, n[k]])
            yield i, (
                len(raw), cuts, [a for a, _ in made], [b for _, b in made], [unit[k] - s for k in kept], [x[k] - s for k in kept], [n[k] for k in kept], [anchor[k] - x[k] for k in kept],
                [hashes[k] for k in kept], [a for a, _ in spans], [b for _, b in spans],
            )

    schema = "k1 long, k2 long, row long, size int, cuts array<int>, h1 array<long>, h2 array<long>, unit array<int>, start array<int>, n array<int>, before array<int>, g array<long>, sure_start array<int>, sure_n array<int>"
    return rows.select("k1", "k2", "text").mapInArrow(parse, schema)


def dictionary(rows: DataFrame, attempt: int = 0, bits: int = NAME_BITS, length: int = LENGTH) -> DataFrame:
    """h1, h2, phrase: the different phrases of all texts of length and more, with their names."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in batches_of(batch.column(0)):
                texts = [t for t in texts if len(t) >= length]
                if not texts:
                    continue
                sizes = np.fromiter(map(len, texts), np.int64, len(texts))
                data, ends = np.frombuffer(b"".join(texts), np.uint8), np.cumsum(sizes)
                starts = ends - sizes
                places = triggers(data, rolling_hashes(data, HASHED), starts, ends)
                held = {p for raw, a, b in zip(texts, starts.tolist(), ends.tolist(), strict=True) for p in phrases_of(raw, cuts_of(places, a, b))}
                named = [name(p, attempt, bits) for p in held]
                yield pa.record_batch([pa.array([a for a, _ in named], pa.int64()), pa.array([b for _, b in named], pa.int64()), pa.array([*held], pa.binary())], ["h1", "h2", "phrase"])

    return rows.select("text").mapInArrow(cut, "h1 long, h2 long, phrase binary").distinct()


def all_apart(phrases: DataFrame) -> bool:
    """Whether no two different phrases have one name: from here on, equal names are equal bytes."""
    return phrases.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()


def units(parses: DataFrame, length: int = LENGTH) -> DataFrame:
    """The units of every parse (k1, k2, size, items: pos, cut and id of each phrase, null where it occurs once).

    A unit is the windows that start in one phrase behind its first byte (in the text's first phrase, at it too). k1,
    k2, unit (its start), off (1, or 0 in the first phrase), n (windows), ids (of all phrases that its windows touch,
    null if one occurs once) and parts (start, n, before, g): stretches of windows with the same phrases whole inside,
    none of which occurs once. g is a hash of these; before is how far the first of them lies behind the start.
    """

    def made(cuts: np.ndarray, ids: np.ndarray, size: int) -> Iterator[tuple]:
        m, known = len(cuts), ids >= 0
        for j in np.flatnonzero(known | np.append(known[1:], False)).tolist():
            a, last = int(cuts[j]) + (j > 0), min(int(cuts[j + 1]) if j + 1 < m else size, size - length)
            if last < a:
                continue
            top = int(np.searchsorted(cuts, last + length))
            whole = ids[j:top].tolist() if known[j:top].all() else None
            parts = []
            b = j + 2
            while b < m and known[b - 1]:  # phrases j + 1 to b - 1 lie inside windows that reach the trigger at cut b
                low = max(a, int(cuts[b]) + TRIGGER - length)
                high = min(last, int(cuts[b + 1]) + TRIGGER - length - 1 if b + 1 < m else last)
                if low > last:
                    break
                if low <= high:
                    parts.append((low, high - low + 1, int(cuts[j + 1]) - low, xxhash.xxh3_64_intdigest(ids[j + 1 : b].tobytes()) - (1 << 63)))
                b += 1
            if whole is not None or parts:
                yield a, int(j > 0), last - a + 1, whole, parts

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, out = [], []
            for i, (size, items) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3), strict=True)):
                flat = items.values
                cuts, ids = flat.field("cut").to_numpy(), flat.field("id").fill_null(-1).to_numpy()
                for u in made(cuts, ids, size):
                    keys.append(i)
                    out.append(u)
            own = pa.array(keys, pa.int64())
            parts = [[[p[k] for p in u[4]] for u in out] for k in range(4)]
            yield pa.record_batch(
                [batch.column(0).take(own), batch.column(1).take(own), *[pa.array([u[k] for u in out], pa.int32()) for k in range(3)], pa.array([u[3] for u in out], pa.list_(pa.int64())), *[pa.array(p, pa.list_(pa.int32())) for p in parts[:3]], pa.array(parts[3], pa.list_(pa.int64()))],
                ["k1", "k2", "unit", "off", "n", "ids", "p_start", "p_n", "p_before", "p_g"],
            )

    schema = "k1 long, k2 long, unit int, off int, n int, ids array<long>, p_start array<int>, p_n array<int>, p_before array<int>, p_g array<long>"
    return parses.select("k1", "k2", "size", "items").mapInArrow(rows, schema)


def repeated_windows(rows: list[tuple[int, int, bytes]], groups: np.ndarray, length: int = LENGTH) -> list[np.ndarray]:
    """For each stretch, which of its windows also occur in another stretch of its group.

    rows: (windows, before, bytes); groups: a number for each, rows of a group together. What follows the place before
    is sorted (the order of the parse), and so is what precedes it, read backwards (the order of the dictionary's
    suffixes). Rows whose neighbours in an order agree over u bytes are one class at u; a window with t bytes before the
    place is repeated exactly if another row has its class at t before and at length - t after. Nothing is hashed.
    """
    n = len(rows)
    if not n:
        return []
    width = max(len(b) - before for _, before, b in rows)
    back = max(before for _, before, _ in rows)
    after, ahead = np.zeros((n, max(width, length)), np.uint8), np.zeros((n, max(back, 1)), np.uint8)
    for i, (_, before, b) in enumerate(rows):
        after[i, : len(b) - before] = np.frombuffer(b, np.uint8, offset=before)
        ahead[i, :before] = np.frombuffer(b, np.uint8, count=before)[::-1]

    def shared(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in the order within groups, and how far each row there agrees with the one before it."""
        keys = np.concatenate([groups[:, None].astype(">u4").view(np.uint8).reshape(n, 4), x], axis=1)
        order = np.lexsort(_columns(keys))
        y = x[order]
        differs = np.concatenate([y[1:] != y[:-1], np.ones((n - 1, 1), bool)], axis=1)
        lcp = np.concatenate([[-1], np.where(groups[order][1:] == groups[order][:-1], differs.argmax(axis=1), -1)])
        place = np.empty(n, np.int64)
        place[order] = np.arange(n)
        return place, lcp

    place_after, lcp_after = shared(after)
    place_ahead, lcp_ahead = shared(ahead)
    windows = np.array([r[0] for r in rows])
    before = np.array([r[1] for r in rows])
    out = [np.zeros(w, bool) for w in windows]
    for t in range(int((before - windows + 1).min()), int(before.max()) + 1):
        held = np.flatnonzero((before >= t) & (before - windows < t))
        if len(held) < 2:
            continue
        a = np.cumsum(lcp_ahead < t)[place_ahead[held]]
        b = np.cumsum(lcp_after < length - t)[place_after[held]]
        _, inverse, count = np.unique(a * (n + 1) + b, return_inverse=True, return_counts=True)
        for i in held[count[inverse] > 1].tolist():
            out[i][before[i] - t] = True
    return out


def _columns(keys: np.ndarray) -> list[np.ndarray]:
    """Columns for lexsort, eight bytes at a time, the last first."""
    pad = -keys.shape[1] % 8
    wide = np.pad(keys, ((0, 0), (0, pad))).view(">u8")
    return [wide[:, k] for k in range(wide.shape[1] - 1, -1, -1)]


PART = "g long, k1 long, k2 long, start int, n int, before int, low int, high int, bytes binary"
PARTS = ["g", "k1", "k2", "start", "n", "before", "low", "high", "bytes"]
KINDS = (*[pa.int64()] * 3, *[pa.int32()] * 5, pa.binary())


def part_batch(out: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([r[i] for r in out], k) for i, k in enumerate(KINDS)], PARTS)


def part_bytes(fetched: DataFrame, length: int = LENGTH) -> DataFrame:
    """The parts listed (column at) beside each text, with their bytes. The windows of a part begin low to high bytes
    before its anchor, which stands before bytes behind the part's start."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = None
        for batch in batches:
            out: list[tuple] = []
            for k1, k2, text, at in zip(*(batch.column(c) for c in ("k1", "k2", "text", "at")), strict=True):
                key = k1.as_py(), k2.as_py()
                if key == done:  # a repeated row has the same parts
                    continue
                done, raw = key, text.as_buffer().to_pybytes()
                out += [(x["g"], *key, x["start"], x["n"], x["before"], 0, length - 1, raw[x["start"] : x["start"] + x["n"] + length - 1]) for x in at.as_py()]
                if len(out) >= CHUNK:
                    yield part_batch(out)
                    out = []
            yield part_batch(out)

    return fetched.mapInArrow(rows, PART)


def halved(parts: DataFrame, length: int = LENGTH) -> DataFrame:
    """parts in two: windows that begin far before the anchor, and those that end far behind it. Each half's windows share
    more bytes around the anchor, and their group is named after these, so that equal windows stay together."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for _, k1, k2, start, n, before, low, high, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                middle = (low + high + 1) // 2
                split = max(0, min(n, before - middle + 1))
                for a, b, lo, hi in ((0, split, middle, high), (split, n, low, middle - 1)):
                    if a < b:
                        shared = raw[before - lo : before + length - hi]
                        out.append((xxhash.xxh3_64_intdigest(shared, lo) - (1 << 63), k1, k2, start + a, b - a, before - a, lo, hi, raw[a : b + length - 1]))
            yield part_batch(out)

    return parts.mapInArrow(rows, PART)


def resolve(parts: DataFrame, length: int = LENGTH, chunk: int = CHUNK) -> DataFrame:
    """k1, k2, start, n, mask (a bit for each window) of parts whose groups one task can hold, by their orders."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if len(held) >= chunk and r[0] != held[-1][0]:
                    yield made(held)
                    held = []
                held.append(r)
        yield made(held)

    def made(held: list[tuple]) -> pa.RecordBatch:
        groups = np.cumsum(np.array([False] + [a[0] != b[0] for a, b in zip(held, held[1:], strict=False)], np.int64)[: len(held)])
        masks = repeated_windows([(r[4], r[5], r[8]) for r in held], groups, length)
        columns = [pa.array([r[i] for r in held], k) for i, k in ((1, pa.int64()), (2, pa.int64()), (3, pa.int32()), (4, pa.int32()))]
        return pa.record_batch([*columns, pa.array([np.packbits(m).tobytes() if m.any() else None for m in masks], pa.binary())], ["k1", "k2", "start", "n", "mask"])

    return parts.repartition("g").sortWithinPartitions("g").mapInArrow(rows, "k1 long, k2 long, start int, n int, mask binary").where("mask IS NOT NULL")


def resolved(parts: DataFrame, length: int = LENGTH, group_rows: int = GROUP_ROWS) -> DataFrame:
    """resolve for groups of any size. A group that is too large for a task is halved, over all tasks, until its parts
    share all their bytes but what a task can order; windows that share all are equal, and are told by their bytes."""
    out = []
    while True:
        sizes = parts.groupBy("g").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
        out.append(resolve(parts.join(sizes.where(F.col("_n") <= group_rows).select("g"), "g"), length))
        large = sizes.where(F.col("_n") > group_rows).select("g")
        if large.isEmpty():
            break
        parts = table(parts.join(large, "g").select(*PARTS), "large")
        single = parts.where("low = high")  # one window each
        twice = single.groupBy("bytes").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("bytes")
        out.append(single.join(twice, "bytes").select("k1", "k2", "start", "n", F.unhex(F.lit("80")).alias("mask")))
        parts = table(halved(parts.where("low < high"), length), "halved")
    masks = out[0]
    for x in out[1:]:
        masks = masks.unionByName(x)
    return masks


def removed_spans(docs: DataFrame, length: int = LENGTH, group_rows: int = GROUP_ROWS, bits: int = NAME_BITS, id: str = "doc_id", text: str = "text") -> DataFrame:
    """k1, k2, doc_id, text and hits of every row: the windows (start, n, mask or null for all) found elsewhere.

    1. Texts are cut into phrases at triggers. The dictionary proves by the bytes that no two phrases share a name; else
       names are made anew.
    2. A text's parse gives its units; units with equal parses are equal in all their bytes, so repeated throughout.
    3. Of each different unit, stretches of windows whose whole phrases are repeated meet by these phrases (windows
       without one: by an anchor); the order of what precedes and of what follows tells which windows are repeated.
    4. All windows go back to their texts.
    """
    rows = keyed(docs, id, text)
    attempt = 0
    while not all_apart(dictionary(rows, attempt, bits, length)):
        attempt += 1
    parsed = table(parsed_texts(rows, attempt, bits, length), "parses")
    every = parsed.select("k1", "k2", "row", "size", F.posexplode(F.arrays_zip("cuts", "h1", "h2")).alias("pos", "p"))
    every = every.select("k1", "k2", "row", "size", "pos", F.col("p.cuts").alias("cut"), F.col("p.h1").alias("h1"), F.col("p.h2").alias("h2"))
    often = every.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("h1", "h2", F.monotonically_increasing_id().alias("id"))
    often = table(often, "often")  # written, so that ids stay and both sides of the join are plain exchanges
    items = F.array_sort(F.collect_list(F.struct("pos", "cut", "id"))).alias("items")  # a text's own phrases
    made = table(units(every.join(often, ["h1", "h2"], "left").groupBy("k1", "k2", "row", "size").agg(items), length), "units")
    parse = ["off", "n", "ids"]
    place = F.struct("k1", "k2", "unit")
    same = made.where("ids IS NOT NULL").groupBy(*parse).agg(F.count(F.lit(1)).alias("_n"), F.min(place).alias("_first")).where("_n > 1").drop("_n")
    made = table(made.join(same, parse, "left").withColumns({"whole": F.col("_first").isNotNull(), "alone": F.coalesce(F.col("_first") == place, F.lit(True))}).drop("ids", "off", "_first"), "told")
    # one unit of each kind, whether whole or not, may share windows with others
    parts = made.where("alone").select("k1", "k2", "whole", F.explode(F.arrays_zip("p_start", "p_n", "p_before", "p_g")).alias("p"))
    parts = parts.select("k1", "k2", "whole", F.col("p.p_start").alias("start"), F.col("p.p_n").alias("n"), F.col("p.p_before").alias("before"), F.col("p.p_g").alias("g"))
    bare = parsed.select("k1", "k2", F.explode(F.arrays_zip("unit", "start", "n", "before", "g")).alias("p")).select("k1", "k2", "p.*")
    bare = bare.join(made.select("k1", "k2", "unit", "whole", "alone").distinct(), ["k1", "k2", "unit"], "left").where("alone IS NULL OR alone")
    parts = parts.unionByName(bare.select("k1", "k2", F.coalesce("whole", F.lit(False)).alias("whole"), "start", "n", "before", "g"))
    parts = table(parts, "parts")
    groups = parts.groupBy("g").agg(F.count(F.lit(1)).alias("_n"), F.min("whole").alias("_whole")).where("_n > 1 AND NOT _whole").select("g")
    wanted = parts.join(groups, "g").groupBy("k1", "k2").agg(F.collect_set(F.struct("g", "start", "n", "before")).alias("at"))  # a text's own
    masks = resolved(table(part_bytes(rows.join(wanted, ["k1", "k2"]), length), "bytes"), length, group_rows)
    none = F.lit(None).cast("binary").alias("mask")
    sure = parsed.select("k1", "k2", F.explode(F.arrays_zip("sure_start", "sure_n")).alias("p")).select("k1", "k2", F.col("p.sure_start").alias("start"), F.col("p.sure_n").alias("n"), none)
    hits = made.where("whole").select("k1", "k2", F.col("unit").alias("start"), "n", none).unionByName(sure).unionByName(masks)
    hits = hits.groupBy("k1", "k2").agg(F.collect_set(F.struct("start", "n", "mask")).alias("hits"))  # a text's own
    return rows.join(hits, ["k1", "k2"], "left")


def covered(size: int, hits: list[dict], length: int) -> np.ndarray:
    """Whether each byte of a text lies in one of the windows of hits."""
    edges = np.zeros(size + 1, np.int64)
    for x in hits:
        if x["mask"] is None:
            starts = np.arange(x["start"], x["start"] + x["n"])
        else:
            starts = x["start"] + np.flatnonzero(np.unpackbits(np.frombuffer(x["mask"], np.uint8), count=None)[: x["n"]])
        np.add.at(edges, starts, 1)
        np.add.at(edges, starts + length, -1)
    return np.cumsum(edges[:-1]) > 0


def without_repeats(docs: DataFrame, length: int = LENGTH, group_rows: int = GROUP_ROWS, bits: int = NAME_BITS, id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the remaining bytes) of every row.

    Every byte in a string of length bytes that also starts elsewhere, in any text, goes; all its occurrences go. Texts
    shorter than that, null and empty ones stay as they are. A text that is repeated as a row is a repeat like any
    other. Bytes may be cut inside a character.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for x, hits in zip(batch.column("text"), batch.column("hits"), strict=True):
                raw = x.as_buffer().to_pybytes() if x.is_valid else b""
                if not hits.is_valid:
                    out.append((len(raw), 0, 0, raw))
                    continue
                gone = covered(len(raw), hits.as_py(), length)
                runs = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()) if len(gone) else 0
                out.append((len(raw), int(gone.sum()), runs, np.frombuffer(raw, np.uint8)[~gone].tobytes()))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.record_batch([batch.column("doc_id"), *[pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)]], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    kind = docs.schema[id].dataType.simpleString()
    return removed_spans(docs, length, group_rows, bits, id, text).mapInArrow(rows, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary")


def repeat_digests(docs: DataFrame) -> DataFrame:
    return without_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
