"""Codes of vectors by product quantisation: a codebook for each part of a vector, refined by Lloyd rounds that rescan only
parts whose nearest entry may have changed.

A part keeps the slack between its lower bound (distance to the second nearest entry) and its upper bound (distance to its
own). Entries drift from round to round; a heap for each entry, within a block of vectors, gives the parts whose slack the
drift since their last scan has used up, and no others.
"""

from __future__ import annotations

import hashlib
import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table

PARTS, ENTRIES, ROUNDS = 16, 64, 2
SCALE = 256
#: A block is one row of the state: so many bytes of components as 64-bit numbers, and so many vectors at most.
BLOCK_BYTES, BLOCK_ROWS = 4 << 20, 1 << 14
#: Sums go through Spark in limbs of so many bits, so that no sum of a block or a table overflows.
LIMB = 40
#: Rows and entries whose distances are held at once.
SCAN = 4096
#: Bounds give way by this much, for rounding.
SLIP = 2.0**-48
#: Up to so many labels (a number each) their errors are broadcast; more are joined by shuffle, hot labels salted.
MAX_BROADCAST_LABELS, SALTS = 10_000, 32


def usable(vectors: DataFrame, id: str, vector: str, label: str) -> DataFrame:
    """vec_id, label, vector of the rows whose vector is neither null nor holds null or non-finite components."""
    x = F.col(vector)
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return vectors.select(F.col(id).alias("vec_id"), F.col(label).alias("label"), x.alias("vector")).where(F.col("vector").isNotNull() & ~bad)


def floors(x: np.ndarray) -> np.ndarray:
    """floor(SCALE * x), exact: 64-bit integers, or Python's where those are too short."""
    scaled = np.floor(x.astype(np.float64) * SCALE)
    if np.abs(scaled).max(initial=0) < 2**62:
        return scaled.astype(np.int64)
    exact = [math.floor(v * SCALE) if abs(v) < 2.0**900 else int(v) * SCALE for v in x.astype(np.float64).ravel().tolist()]
    return np.array(exact, object).reshape(x.shape)


def packed(x: np.ndarray, raw: np.ndarray) -> tuple[str, bytes]:
    """The floors x in as few bytes as hold them, or the components themselves, which floors() takes again."""
    most = np.abs(x).max(initial=0)
    for kind, bits in (("h", 15), ("i", 31)):
        if most < 1 << bits:
            return kind, x.astype(kind).tobytes()
    return "d", raw.astype("d").tobytes()


def unpacked(kind: str, data: bytes, rows: int) -> np.ndarray:
    x = np.frombuffer(data, kind).reshape(rows, -1)
    return floors(x) if kind == "d" else x.astype(np.int64)


def exact_kind(x: np.ndarray, entries: np.ndarray) -> type:
    """The kind of number in which squared distances of x and entries are exact."""
    most = int(max(np.abs(x).max(initial=0), np.abs(entries).max(initial=0)))
    room = entries.shape[-1] * (2 * most) ** 2
    return np.float64 if room < 2**52 else np.int64 if room < 2**62 else object


def scan(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row the nearest entry, the lower of equal ones, and the slack: by how much the next one is further, at least."""
    kind = exact_kind(x, entries)
    e = entries.astype(kind)
    codes, slack = np.zeros(len(x), np.uint8), np.empty(len(x))
    for a in range(0, len(x), SCAN):
        part = x[a : a + SCAN].astype(kind)
        d = (part * part).sum(1)[:, None] - 2 * (part @ e.T) + (e * e).sum(1)
        at = np.arange(len(part))
        codes[a : a + SCAN] = best = d.argmin(1).astype(np.int64)
        if len(e) == 1:
            slack[a : a + SCAN] = np.inf
        elif kind is object:
            slack[a : a + SCAN] = -np.inf  # too large for bounds: scanned in every round
        else:
            d = d.astype(np.float64)
            first = d[at, best]
            d[at, best] = np.inf
            slack[a : a + SCAN] = np.sqrt(d.min(1)) * (1 - SLIP) - np.sqrt(first) * (1 + SLIP)
    return codes, slack


def violated(codes: np.ndarray, keys: np.ndarray, drift: np.ndarray) -> np.ndarray:
    """Rows whose key is not above the cumulative drift of their entry, popped from a heap for each entry."""
    order = np.argsort(codes, kind="stable")
    ends = np.cumsum(np.bincount(codes, minlength=len(drift)))
    out: list[int] = []
    for entry, (a, b) in enumerate(zip([0, *ends[:-1]], ends, strict=True)):
        rows = order[a:b]
        heap = list(zip(keys[rows].tolist(), rows.tolist(), strict=True))
        heapq.heapify(heap)
        while heap and heap[0][0] <= drift[entry]:
            out.append(heapq.heappop(heap)[1])
    return np.array(sorted(out), np.int64)


def moves(x: np.ndarray, codes: np.ndarray, sign: int, part: int, n_entries: int) -> list[tuple[int, int, int, int, int]]:
    """(entry's number, place, limb, sum, count) of the rows x of one part; a row with place -1 has the count."""
    counts = np.bincount(codes, minlength=n_entries)
    sums = np.zeros((n_entries, x.shape[1]), x.dtype)
    np.add.at(sums, codes, x)
    out = []
    for entry in np.flatnonzero(counts).tolist():
        slot = part * n_entries + entry
        out.append((slot, -1, 0, 0, sign * int(counts[entry])))
        for j, total in enumerate(sums[entry].tolist()):
            rest, limb, way = abs(total), 0, sign if total >= 0 else -sign
            while rest:
                if low := rest & (1 << LIMB) - 1:
                    out.append((slot, j, limb, way * low, 0))
                rest >>= LIMB
                limb += 1
    return out


STATE = "n int, kind string, data binary, codes binary, keys binary, moves array<struct<slot:int,place:int,limb:int,sum:bigint,n:bigint>>"
MOVES = pa.list_(pa.struct([("slot", pa.int32()), ("place", pa.int32()), ("limb", pa.int32()), ("sum", pa.int64()), ("n", pa.int64())]))


class Codebooks:
    """Entries by part as exact integers, what they are the means of, and how far they have drifted in all.

    Its size is that of the codebooks, whatever the number of vectors. drift has for each entry what a slack has lost
    since round 0: the entry's own way, and the longest of any other entry of its part.
    """

    def __init__(self, first: np.ndarray, parts: int) -> None:
        self.n, self.width = len(first), first.shape[1] // parts
        self.entries = [first[:, p * self.width : (p + 1) * self.width] for p in range(parts)]
        self.sums = [[[0] * self.width for _ in range(self.n)] for _ in range(parts)]
        self.counts = [[0] * self.n for _ in range(parts)]
        self.drift = np.zeros((parts, self.n))

    def refine(self, moved: DataFrame) -> None:
        """Takes the moves of a round: entries become the floors of their parts' means; unused entries stay."""
        for r in moved.groupBy("slot", "place", "limb").agg(F.sum("sum").alias("sum"), F.sum("n").alias("n")).toLocalIterator():
            part, entry = divmod(r.slot, self.n)
            if r.place < 0:
                self.counts[part][entry] += r.n
            else:
                self.sums[part][entry][r.place] += r["sum"] << LIMB * r.limb
        for part, old in enumerate(self.entries):
            new = np.array([[s // n for s in sums] if n else e for sums, n, e in zip(self.sums[part], self.counts[part], old.tolist(), strict=True)], object).reshape(old.shape)
            squares = [sum((a - b) ** 2 for a, b in zip(x, y, strict=True)) for x, y in zip(old.tolist(), new.tolist(), strict=True)]
            way = np.array([math.sqrt(s) * (1 + SLIP) if s < 2**1000 else math.inf for s in squares])
            for entry in range(self.n):
                self.drift[part, entry] += way[entry] + np.delete(way, entry).max(initial=0)
            self.drift[part] *= 1 + SLIP
            small = max((abs(v) for row in new.tolist() for v in row), default=0) < 2**62
            self.entries[part] = new.astype(np.int64) if small else new

    def digest(self) -> str:
        return hashlib.sha256(",".join(str(v) for e in self.entries for row in e.tolist() for v in row).encode()).hexdigest()


def block_of(ids: pa.Array, labels: pa.Array, x: np.ndarray, raw: np.ndarray, books: Codebooks) -> pa.RecordBatch:
    """A block of the state after a first scan of all its parts."""
    codes, keys, moved = np.empty((len(x), len(books.entries)), np.uint8), np.empty((len(x), len(books.entries))), []
    for part, entries in enumerate(books.entries):
        own = x[:, part * books.width : (part + 1) * books.width]
        codes[:, part], keys[:, part] = scan(own, entries)
        moved += moves(own, codes[:, part], 1, part, books.n)
    return state_row(ids, labels, *packed(x, raw), codes, keys, moved)


def state_row(ids: pa.Array, labels: pa.Array, kind: str, data: bytes, codes: np.ndarray, keys: np.ndarray, moved: list) -> pa.RecordBatch:
    """keys are kept in 32 bits, rounded down."""
    short = np.nextafter(keys.astype(np.float32), np.float32(-np.inf))
    one = lambda v: pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v)
    values = [one(ids), one(labels), pa.array([len(codes)], pa.int32()), pa.array([kind]), pa.array([data], pa.binary()), pa.array([codes.tobytes()], pa.binary()), pa.array([short.tobytes()], pa.binary()), pa.array([moved], MOVES)]
    return pa.record_batch(values, ["ids", "labels", "n", "kind", "data", "codes", "keys", "moves"])


def rescanned(x: np.ndarray, codes: np.ndarray, keys: np.ndarray, books: Codebooks) -> list[tuple[int, int, int, int, int]]:
    """Brings codes and keys of a block up to the present entries, in place, and gives the moves of parts that changed."""
    moved = []
    for part, entries in enumerate(books.entries):
        rows = violated(codes[:, part], keys[:, part], books.drift[part])
        if len(rows):
            own, old = x[rows, part * books.width : (part + 1) * books.width], codes[rows, part]
            new, slack = scan(own, entries)
            codes[rows, part], keys[rows, part] = new, slack + books.drift[part][new]
            changed = new != old
            if changed.any():
                moved += moves(own[changed], old[changed], -1, part, books.n) + moves(own[changed], new[changed], 1, part, books.n)
    return moved


def errors(x: np.ndarray, codes: np.ndarray, books: Codebooks) -> list[int | None]:
    """Squared distances to the entries of the codes, summed over parts; None above 64 bits."""
    near = np.concatenate([e[codes[:, p]] for p, e in enumerate(books.entries)], axis=1)
    kind = exact_kind(x, near)
    kind = object if kind is object else np.int64
    return [e if e < 2**63 else None for e in ((x.astype(kind) - near.astype(kind)) ** 2).sum(1).tolist()]


def compressed(vectors: DataFrame, id: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, n_entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of every row whose vector is whole and finite.

    Rows with a null vector or with null or non-finite components are dropped, and so are vectors whose length is not
    that of the first one; the first are those of the least ids, nulls last, equal ids by their components. A length that
    is no multiple of parts counts as filled up with 0. Fewer vectors than n_entries make codebooks of as many entries.
    Repeated rows give repeated rows. Errors above 64 bits, and sums of errors that are, are null. An empty table gives
    no rows. Every round writes its state, blocks of vectors with codes and bounds, to the shared folder, so that a
    lost executor costs one round's part.
    """
    rows = usable(vectors, id, vector, label)
    first = lambda of: of.orderBy(F.col("vec_id").asc_nulls_last(), "vector").select("vector").limit(n_entries).collect()
    least = first(rows)
    kind, mark = vectors.schema[id].dataType.simpleString(), vectors.schema[label].dataType.simpleString()
    if not least:
        return rows.select("vec_id", *[F.lit(None).cast(t).alias(c) for c, t in (("code", "string"), ("error", "long"), ("label_error", "long"), ("codebooks_sha256", "string"))])
    size = len(least[0].vector)
    rows, width = rows.where(F.size("vector") == size), max(1, -(-size // parts))
    if any(len(r.vector) != size for r in least):
        least = first(rows)
    filled = lambda v: np.pad(v, ((0, 0), (0, parts * width - size)))
    books = Codebooks(floors(filled(np.array([r.vector for r in least], np.float64).reshape(len(least), size))), parts)
    step = max(1, min(BLOCK_ROWS, BLOCK_BYTES // (8 * parts * width)))

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, step):
                part = batch.slice(a, step)
                raw = filled(part.column(2).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, size))
                yield block_of(part.column(0), part.column(1), floors(raw), raw, books)

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for r in range(batch.num_rows):
                ids, labels, n, stored, data = (batch.column(c)[r] for c in ("ids", "labels", "n", "kind", "data"))
                n = n.as_py()
                codes, keys = (np.frombuffer(batch.column(c)[r].as_py(), t).reshape(n, parts) for c, t in (("codes", np.uint8), ("keys", np.float32)))
                codes, keys = codes.copy(), keys.astype(np.float64)
                x = unpacked(stored.as_py(), data.as_py(), n)
                yield ids.values, labels.values, stored.as_py(), data.as_py(), codes, keys, rescanned(x, codes, keys, books), x

    def go_on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for *row, _ in opened(batches):
            yield state_row(*row)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, labels, _, _, codes, _, _, x in opened(batches):
            yield pa.record_batch([ids, labels, pa.array([c.tobytes().hex() for c in codes], pa.string()), pa.array(errors(x, codes, books), pa.int64())], ["vec_id", "label", "code", "error"])

    schema = f"ids array<{kind}>, labels array<{mark}>, {STATE}"
    state = table(rows.mapInArrow(begin, schema), "codes")
    for last in range(1, rounds + 1):
        books.refine(state.select(F.inline("moves")))
        if last < rounds:
            state = table(state.mapInArrow(go_on, schema), "codes")
    found = table(state.mapInArrow(finish, f"vec_id {kind}, label {mark}, code string, error long"), "coded")
    return with_label_errors(found).select("vec_id", "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))


def with_label_errors(found: DataFrame) -> DataFrame:
    """found with label_error; a label with a great part of the rows is summed before the shuffle and meets its rows in SALTS groups."""
    sums = found.groupBy(F.col("label").alias("_label")).agg(F.expr("try_sum(error)").alias("label_error"))

    def same(left: DataFrame, right: DataFrame, *more: Column) -> DataFrame:
        return left.join(right, [F.col("label").eqNullSafe(F.col("_label")), *more])

    sums = table(sums, "label_errors")
    if sums.count() <= MAX_BROADCAST_LABELS:
        return same(found, F.broadcast(sums))
    salted = found.withColumn("_salt", F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)).cast("int"))
    return same(salted, sums.withColumn("_to", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), F.col("_salt") == F.col("_to"))


def oracle(parts: int = PARTS, n_entries: int = ENTRIES, rounds: int = ROUNDS) -> str:
    """The same rows by DuckDB, by full scans."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""near{r} AS (SELECT rid, part, arg_min(entry, (d, entry)) AS entry, min(d) AS d FROM (
  SELECT p.rid, p.part, e.entry, list_sum(list_transform(list_zip(p.x, e.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM cut p JOIN book{r} e USING (part)) GROUP BY rid, part)""")
        if r < rounds:
            steps.append(f"""means{r} AS (SELECT part, entry, list(m ORDER BY j) AS x FROM (
  SELECT part, entry, j, CAST(sum(v) // count(*) - CASE WHEN sum(v) % count(*) < 0 THEN 1 ELSE 0 END AS BIGINT) AS m
  FROM (SELECT n.part, n.entry, unnest(p.x) AS v, unnest(range(len(p.x))) AS j FROM near{r} n JOIN cut p USING (rid, part)) GROUP BY part, entry, j) GROUP BY part, entry),
book{r + 1} AS (SELECT b.part, b.entry, coalesce(m.x, b.x) AS x FROM book{r} b LEFT JOIN means{r} m USING (part, entry))""")
    return f"""
WITH kept AS (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS rid, vec_id, label, list_transform(embedding, lambda v: CAST(floor(CAST(v AS DOUBLE) * {SCALE}) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0),
cut AS (SELECT rid, part, v[part * (len(v) // {parts}) + 1:(part + 1) * (len(v) // {parts})] AS x FROM kept, range({parts}) AS t(part)),
book0 AS (SELECT part, rid - 1 AS entry, x FROM cut WHERE rid <= {n_entries}),
{",".join(steps)},
final AS (SELECT rid, string_agg(lpad(lower(to_hex(entry)), 2, '0'), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM near{rounds} GROUP BY rid),
sha AS (SELECT sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY part, entry, j)) AS codebooks_sha256 FROM (SELECT part, entry, unnest(x) AS v, unnest(range(len(x))) AS j FROM book{rounds})),
labels_ AS (SELECT label, CAST(sum(error) AS BIGINT) AS label_error FROM final JOIN kept USING (rid) GROUP BY label)
SELECT k.vec_id, f.code, f.error, l.label_error, sha.codebooks_sha256
FROM final f JOIN kept k USING (rid) JOIN labels_ l ON k.label IS NOT DISTINCT FROM l.label, sha
"""


ORACLE = oracle()
