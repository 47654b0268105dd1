"""Collocations: phrases of up to four words that occur more often together than their parts.

Shards of text become count tries of limited depth, kept as their sorted paths. Ranges of the order of paths are cut out of
all tries and merged; a walk over a merged trie gives the counts of a phrase's first words, and links from a phrase to the
phrase without its first word give those of its last words.
"""

from __future__ import annotations

import struct
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import hash_bucket, table

DEPTH, LEAST, TOP = 4, 30, 2000
#: A candidate goes where a longer phrase around it has this share of its count.
COVERED = 80
#: Bytes of text in a trie, and in a range, on average; a range's bounds are a few words in the driver and in every task.
TRIE_BYTES, RANGE_BYTES = 6 << 20, 8 << 20
#: Paths looked at for each bound.
OVERSAMPLE = 40
UNKNOWN = "und"
#: Counts that ranges share (eight at most for each range) are broadcast up to so many; more are joined by shuffle.
MAX_BROADCAST_SHARED = 100_000
#: Candidates of a lang that are ordered in one task.
ROWS_A_PART = 100_000

SPACES, BREAKS = b"\t ", b".,;:!?\n\x0b\x0c\r"
CLASS = np.zeros(256, np.uint8)
CLASS[list(SPACES)], CLASS[list(BREAKS)] = 1, 2
AS_LINES = bytes(ord("\n") if b in BREAKS else b for b in range(256))


def segments(raw: bytes, size: int) -> Iterator[tuple[bytes, int]]:
    """A text in parts of about size bytes: bytes, and how many of them hold the starts of words that count here.

    A part goes on for DEPTH - 1 words beyond those that start in it, so that no phrase is lost or counted twice.
    """
    at = 0
    while len(raw) - at > 2 * size:
        kinds = CLASS[np.frombuffer(raw, np.uint8, 2 * size, at)]
        behind = size + np.flatnonzero((kinds[size:] == 0) & (kinds[size - 1 : -1] != 0))[:DEPTH]
        if len(behind) < DEPTH:
            break  # words of many bytes: the rest at once
        yield raw[at : at + int(behind[-1])], int(behind[0])
        at += int(behind[0])
    yield raw[at:], len(raw) - at


def keys_of(columns: np.ndarray, sizes: list[int]) -> np.ndarray:
    """A number for each column, in the columns' order, equal for equal ones; row i holds numbers from 0 to sizes[i] - 1."""
    key, room = np.zeros(columns.shape[1], np.int64), 1
    for row, size in zip(columns, sizes, strict=True):
        if room * size >= 1 << 62:
            found, key = np.unique(key, return_inverse=True)
            room = len(found)
        key = key * size + row
        room *= size
    return key


def summed(columns: np.ndarray, counts: np.ndarray, sizes: list[int], kind: str = "quicksort") -> tuple[np.ndarray, np.ndarray]:
    """The distinct columns in order, with the sums of their counts."""
    key = keys_of(columns, sizes)
    order = np.argsort(key, kind=kind)
    key = key[order]
    new = np.flatnonzero(np.r_[len(key) > 0, key[1:] != key[:-1]][: len(key)])
    return columns[:, order[new]], np.add.reduceat(counts[order], new) if len(new) else counts[:0]


class Trie:
    """The count trie of (lang, bytes, bytes that count) of some texts, as its sorted distinct paths and their counts.

    A path is a lang and DEPTH words from some word on, as places in the sorted langs and words; 0 stands for what lies
    beyond the end of the piece. A node is the stretch of paths that begin alike, and its count is their sum.
    """

    def __init__(self, texts: list[tuple[bytes, bytes, int]]) -> None:
        lowered = b"\n".join(t.lower() for _, t, _ in texts)  # of bytes: A-Z alone
        kinds = CLASS[np.frombuffer(lowered, np.uint8)]
        first = kinds == 0
        first[1:] &= kinds[:-1] != 0
        at = np.flatnonzero(first)
        piece = np.cumsum(kinds == 2, dtype=np.int32)[at]
        numbers: defaultdict[bytes, int] = defaultdict(count().__next__)
        ids = np.fromiter(map(numbers.__getitem__, lowered.translate(AS_LINES).split()), np.int64, len(at))
        names = list(numbers)
        order = sorted(range(len(names)), key=names.__getitem__)
        self.words = [b"", *[names[i] for i in order]]
        rank = np.zeros(len(names), np.int32)
        rank[order] = np.arange(1, len(names) + 1)
        self.langs = sorted({lang for lang, _, _ in texts})
        places = {lang: i for i, lang in enumerate(self.langs)}
        sizes = np.array([len(t) for _, t, _ in texts], np.int64) + 1
        begins = np.cumsum(sizes) - sizes
        text = np.searchsorted(begins, at, side="right") - 1
        counted = at < (begins + np.array([own for _, _, own in texts], np.int64))[text]
        n = len(at)
        word, pieces = np.zeros(n + DEPTH, np.int32), np.full(n + DEPTH, -1, np.int32)
        word[:n], pieces[:n] = rank[ids], piece
        lang = np.array([places[lang] for lang, _, _ in texts], np.int32)[text]
        paths = np.stack([lang, *[np.where(pieces[k : n + k] == piece, word[k : n + k], 0) for k in range(DEPTH)]])[:, counted]
        self.paths, self.counts = summed(paths, np.ones(paths.shape[1], np.int64), self.sizes())

    def sizes(self) -> list[int]:
        return [len(self.langs), *[len(self.words)] * DEPTH]

    def cuts(self, bounds: list[tuple[bytes, ...]]) -> np.ndarray:
        """For each bound (a lang and DEPTH words, b'' beyond the end) the place of the first path not before it."""

        def places(names: list[bytes], wanted: tuple[bytes, ...]) -> list[int]:
            found = [bisect_left(names, w) for w in wanted]
            return [2 * i + (i < len(names) and names[i] == w) for i, w in zip(found, wanted, strict=True)]

        if not bounds:
            return np.empty(0, np.int64)
        columns = list(zip(*bounds, strict=True))
        asked = np.array([places(self.langs, columns[0]), *[places(self.words, c) for c in columns[1:]]], np.int32)
        key = keys_of(np.concatenate([asked, 2 * self.paths + 1], axis=1), [2 * n + 1 for n in self.sizes()])
        return np.searchsorted(key[len(bounds) :], key[: len(bounds)])

    def packed(self, a: int, b: int) -> tuple[list[bytes], bytes]:
        """Langs, and the paths a to b as bytes: words, and of each path only what differs from the path before it."""
        paths = self.paths[:, a:b]
        langs, paths0 = np.unique(paths[0], return_inverse=True)
        used, rest = np.unique(paths[1:], return_inverse=True)
        own = np.concatenate([paths0[None], rest.reshape(DEPTH, -1)])
        differs = np.logical_or.accumulate(own != np.pad(own, ((0, 0), (1, 0)), constant_values=-1)[:, :-1], axis=0)
        parts = [b"\n".join(self.words[i] for i in used), differs.sum(0).astype(np.uint8).tobytes(), self.counts[a:b].tobytes(), *[row[new].astype(np.uint32).tobytes() for row, new in zip(own, differs, strict=True)]]
        return [self.langs[i] for i in langs], zstandard.compress(struct.pack(f"<{len(parts)}Q", *map(len, parts)) + b"".join(parts), 1)


def unpacked(data: bytes) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Words, paths and counts of Trie.packed."""
    raw, head = zstandard.decompress(data), 8 * (DEPTH + 4)
    ends = head + np.cumsum(struct.unpack(f"<{DEPTH + 4}Q", raw[:head]))
    words, depths, counts, *rows = (raw[a:b] for a, b in zip([head, *ends[:-1]], ends, strict=True))
    new = np.frombuffer(depths, np.uint8)
    paths = np.empty((DEPTH + 1, len(new)), np.int32)
    for j, row in enumerate(rows):  # the last new one holds
        paths[j] = np.frombuffer(row, np.uint32)[np.cumsum(new > DEPTH - j) - 1]
    return words.split(b"\n"), paths, np.frombuffer(counts, np.int64)


def merged(tries: list[tuple[list[bytes], list[bytes], np.ndarray, np.ndarray]]) -> tuple[list[bytes], list[bytes], np.ndarray, np.ndarray]:
    """One trie of several (langs, words, paths, counts), each sorted: a stable sort finds the runs and merges them."""

    def common(lists: list[list[bytes]]) -> tuple[list[bytes], list[np.ndarray]]:
        names = sorted(set().union(*lists))
        place = {w: i for i, w in enumerate(names)}
        return names, [np.array([place[w] for w in x], np.int32) for x in lists]

    langs, lang_places = common([t[0] for t in tries])
    words, word_places = common([[b"", *t[1]] for t in tries])
    paths = np.concatenate([np.concatenate([a[p[:1]], b[1:][p[1:]]]) for a, b, (_, _, p, _) in zip(lang_places, word_places, tries, strict=True)], axis=1)
    paths, counts = summed(paths, np.concatenate([t[3] for t in tries]), [len(langs), *[len(words)] * DEPTH], "stable")
    return langs, words, paths, counts


COUNTS = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("size", pa.int32()), ("f", pa.int64()), *[(f"l{k}", pa.int64()) for k in range(1, DEPTH)], ("shared", pa.bool_())])
COUNTS_DDL = f"lang string, phrase string, size int, f long, {', '.join(f'l{k} long' for k in range(1, DEPTH))}, shared boolean"


def frequent(langs: list[bytes], words: list[bytes], paths: np.ndarray, counts: np.ndarray, least: int) -> pa.Table:
    """The nodes of a range's trie that occur least times, with the counts of the nodes above them.

    The first and the last node of each depth may go on in other ranges: they are shared, whatever their count, and do
    not count as known above others. Of depth 0 is a lang, with the count of its words.
    """
    n = paths.shape[1]
    rows: dict[str, list] = {name: [] for name in COUNTS.names}
    new, above = np.zeros(n, bool), []
    for depth in range(DEPTH + 1):
        new = new | np.r_[True, paths[depth, 1:] != paths[depth, :-1]]
        starts = np.flatnonzero(new)
        f = np.add.reduceat(counts, starts)
        real = np.flatnonzero(paths[depth, starts] > 0) if depth else np.arange(len(starts))
        starts, f = starts[real], f[real]
        shared = np.zeros(len(f), bool)
        shared[[0, -1] if len(f) else []] = True
        for i in np.flatnonzero((f >= least) | shared).tolist():
            path = paths[:, starts[i]]
            rows["lang"].append(langs[path[0]].decode("utf-8", "replace"))
            rows["phrase"].append(b" ".join(words[w] for w in path[1 : depth + 1]).decode("utf-8", "replace"))
            rows["size"].append(depth)
            rows["f"].append(int(f[i]))
            rows["shared"].append(bool(shared[i]))
            for k in range(1, DEPTH):
                known = None
                if k < depth:
                    firsts, sums, open_ = above[k]
                    at = int(np.searchsorted(firsts, starts[i], side="right")) - 1
                    known = None if open_[at] else int(sums[at])
                rows[f"l{k}"].append(known)
        above.append((starts, f, shared))
    return pa.table(rows, COUNTS)


def texts_of(batch: pa.RecordBatch) -> Iterator[tuple[bytes, bytes]]:
    for lang, text in zip(batch.column(0), batch.column(1), strict=True):
        yield lang.as_buffer().to_pybytes(), text.as_buffer().to_pybytes()


def path_at(raw: bytes, at: int) -> tuple[bytes, ...] | None:
    """The path of the next word that begins after at, if it lies near."""
    rest = raw[at : at + 1024].lower()
    begin = next((i for i in range(1, len(rest)) if CLASS[rest[i - 1]] and not CLASS[rest[i]]), None)
    if begin is None:
        return None
    words = rest[begin:].translate(AS_LINES).split(b"\n", 1)[0].split()[:DEPTH]
    return tuple(words + [b""] * (DEPTH - len(words)))


def range_bounds(docs: DataFrame, ranges: int, total: int) -> list[tuple[bytes, ...]]:
    """Where the order of paths is cut into ranges of about equal text: of the paths at every so many bytes, each
    OVERSAMPLE-th. Bounds say only which task merges what: results do not depend on them."""
    stride = max(1, total // (ranges * OVERSAMPLE))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ahead = TaskContext.get().partitionId() * 7919 % stride
        for batch in batches:
            found = []
            for lang, raw in texts_of(batch):
                while ahead < len(raw):
                    if path := path_at(raw, ahead):
                        found.append((lang, *path))
                    ahead += stride
                ahead -= len(raw)
            yield pa.record_batch([pa.array([f[i] for f in found], pa.binary()) for i in range(DEPTH + 1)], [f"w{i}" for i in range(DEPTH + 1)])

    seen = sorted(tuple(map(bytes, r)) for r in docs.mapInArrow(look, ", ".join(f"w{i} binary" for i in range(DEPTH + 1))).toLocalIterator())
    return sorted({seen[len(seen) * i // ranges] for i in range(1, ranges)}) if seen else []


def phrase_counts(docs: DataFrame, lang: str = "lang", text: str = "text", least: int = LEAST, trie_bytes: int = TRIE_BYTES, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """lang, phrase, size, f, l1 to l3 of every phrase of 1 to DEPTH words that occurs least times in a lang; of size 0, the words of a lang.

    A null text is empty, a null lang is 'und'. l1 to l3 are the counts of a phrase's first 1 to 3 words, where it is
    longer. The words of a text are lower-cased (A-Z); phrases do not cross BREAKS.
    """
    docs = docs.select(F.coalesce(F.col(lang), F.lit(UNKNOWN)).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    total = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    ranges = -(-total // range_bytes)
    bounds = docs.sparkSession.sparkContext.broadcast(range_bounds(docs, ranges, total) if ranges > 1 else [])

    def count_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            trie = Trie(held)
            ends = [*trie.cuts(bounds.value).tolist(), len(trie.counts)]
            for i, (a, b) in enumerate(zip([0, *ends[:-1]], ends, strict=True)):
                if a < b:
                    names, data = trie.packed(a, b)
                    yield pa.record_batch([pa.array([i], pa.int32()), pa.array([names], pa.list_(pa.binary())), pa.array([data], pa.binary())], ["range", "langs", "data"])

        for batch in batches:
            for name, raw in texts_of(batch):
                for part, own in segments(raw, trie_bytes):
                    held.append((name, part, own))
                    size += len(part)
                    if size >= trie_bytes:
                        yield from flush()
                        held, size = [], 0
        if held:
            yield from flush()

    def merge(group: pa.Table) -> pa.Table:
        tries = [(names, *unpacked(data)) for names, data in zip(group.column("langs").to_pylist(), (x.as_py() for x in group.column("data")), strict=True)]
        return frequent(*merged(tries), least)

    nodes = docs.mapInArrow(count_up, "range int, langs array<binary>, data binary").groupBy("range").applyInArrow(merge, COUNTS_DDL)
    lefts = [F.max(f"l{k}").alias(f"l{k}") for k in range(1, DEPTH)]
    whole = table(nodes.groupBy("lang", "phrase", "size").agg(F.sum("f").alias("f"), *lefts, F.max("shared").alias("shared")), "phrases")
    shared = table(whole.where("shared").select(F.col("lang").alias("_lang"), F.col("phrase").alias("_phrase"), F.col("f").alias("_f")), "shared")
    out = whole.where(F.col("f") >= least).withColumn("_w", F.split("phrase", " "))
    few = shared.count() <= MAX_BROADCAST_SHARED
    for k in range(1, DEPTH):
        missing = F.col(f"l{k}").isNull() & (F.col("size") > k)
        rest = out.where(missing).join(F.broadcast(shared) if few else shared, (F.col("lang") == F.col("_lang")) & (F.concat_ws(" ", F.slice("_w", 1, k)) == F.col("_phrase")))
        out = out.where(~missing).unionByName(rest.withColumn(f"l{k}", F.col("_f")).drop("_lang", "_phrase", "_f"))
    return out.drop("_w", "shared")


def with_rights(counts: DataFrame) -> DataFrame:
    """The phrases of two words and more with r1 to r3, the counts of what follows the first 1 to 3 words.

    A phrase links to the phrase without its first word, which is as frequent at least: that one's count is r1, and its
    own rights are the next ones.
    """
    link = F.expr("substring(phrase, instr(phrase, ' ') + 1)")
    shorter = counts.where("size = 1").select("lang", "phrase", "f", F.array().cast("array<long>").alias("rights"))
    out = None
    for size in range(2, DEPTH + 1):
        links = shorter.select(F.col("lang").alias("_lang"), F.col("phrase").alias("_link"), F.array_prepend("rights", F.col("f")).alias("rights"))
        linked = counts.where(F.col("size") == size).join(links, (F.col("lang") == F.col("_lang")) & (link == F.col("_link"))).drop("_lang", "_link")
        linked = table(linked, "links")
        shorter, out = linked, linked if out is None else out.unionByName(linked)
    return out


def first_rows(df: DataFrame, key: str, order: list, n: int) -> DataFrame:
    """The first n rows of each key with their rank from 1; the rows of a key are sifted in parts, so that none is sorted in one task."""
    rank = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    parts = -(-df.count() // ROWS_A_PART)
    while parts > 1:
        df = df.withColumn("_part", hash_bucket(parts, "phrase")).withColumn("_rank", rank(key, "_part")).where(F.col("_rank") <= n).drop("_part", "_rank")
        parts = -(-parts * n // ROWS_A_PART)
    return df.withColumn("rank", rank(key).cast("long")).where(F.col("rank") <= n)


def collocations(docs: DataFrame, lang: str = "lang", text: str = "text", least: int = LEAST, top: int = TOP, **sizes: int) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first top phrases of each lang by score, count and phrase.

    Candidates are phrases of 2 to DEPTH words that occur least times. A cut after k words has the score
    2,000,000 * a / (l + r), rounded down, of the counts of the whole, the first k words and the rest; the lowest counts,
    of equal ones that with the smallest k. A candidate inside a longer one with COVERED percent of its count goes. An
    empty table, or one without frequent phrases, gives no rows; repeated rows count repeatedly.
    """
    return scored_phrases(table(phrase_counts(docs, lang, text, least, **sizes), "counts"), top)


def scored_phrases(counts: DataFrame, top: int) -> DataFrame:
    """The rows of collocations from the counts of phrases; decimals, as 2,000,000 * a may pass 64 bits."""
    linked = table(with_rights(counts), "linked")
    wide = lambda c: c.cast("decimal(20,0)")

    def cut(k: int):
        r = F.get("rights", F.lit(k - 1))
        score = F.call_function("div", wide(F.col("f")) * 2_000_000, wide(F.col(f"l{k}")) + wide(r))
        return F.when(F.col("size") > k, F.struct(score.alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), r.alias("r")))

    lowest = F.array_min(F.array_compact(F.array(*[cut(k) for k in range(1, DEPTH)])))
    words = F.split("phrase", " ")
    inner = F.array(*[F.when(F.col("size") >= at + size, F.array_join(F.slice(words, at + 1, size), " ")) for size in range(2, DEPTH) for at in range(DEPTH - size + 1)])
    inner = F.when(F.col("size") == 2, F.array().cast("array<string>")).otherwise(F.filter(F.array_compact(inner), lambda x: x != F.col("phrase")))
    around = linked.select(F.col("lang").alias("_lang"), F.explode(inner).alias("_phrase"), "f").groupBy("_lang", "_phrase").agg(F.max("f").alias("_f"))
    kept = linked.join(around, (F.col("lang") == F.col("_lang")) & (F.col("phrase") == F.col("_phrase")), "left").where(F.col("_f").isNull() | (wide(F.col("_f")) * 100 < wide(F.col("f")) * COVERED))
    scored = table(kept.withColumn("_cut", lowest).select("lang", "phrase", F.col("f").alias("a"), "_cut.l", "_cut.r", "_cut.score"), "scored")
    first = first_rows(scored, "lang", [F.desc("score"), F.desc("a"), F.asc("phrase")], top)
    totals = counts.where("size = 0").select("lang", F.col("f").alias("n"))
    return first.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


#: The same rows by DuckDB.
ORACLE = rf"""
WITH pieces AS (SELECT coalesce(lang, '{UNKNOWN}') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
words AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda w: w <> '') AS w FROM pieces),
totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM words GROUP BY lang),
grams AS (SELECT lang, size, w, unnest(range(1, len(w) - size + 2)) AS i FROM words, range(1, {DEPTH + 1}) AS s(size)),
counts AS (SELECT lang, size, w[i:i + size - 1] AS p, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= {LEAST}),
cuts AS (SELECT lang, p, f, size, unnest(range(1, size)) AS k FROM counts WHERE size > 1),
scores AS (
  SELECT c.lang, c.p, c.f AS a, x.f AS l, y.f AS r, CAST(2000000 * CAST(c.f AS HUGEINT) // (CAST(x.f AS HUGEINT) + y.f) AS BIGINT) AS score, k
  FROM cuts c JOIN counts x ON x.lang = c.lang AND x.p = c.p[1:k] JOIN counts y ON y.lang = c.lang AND y.p = c.p[k + 1:]),
best AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1),
inner_ AS (
  SELECT c.lang, c.p[i:i + s - 1] AS p, max(c.f) AS f FROM (SELECT *, unnest(range(1, 4)) AS i FROM counts WHERE size > 2) c, range(2, {DEPTH}) AS t(s)
  WHERE s < c.size AND i + s - 1 <= c.size GROUP BY ALL),
kept AS (SELECT b.* FROM best b LEFT JOIN inner_ i ON i.lang = b.lang AND i.p = b.p WHERE i.f IS NULL OR 100 * CAST(i.f AS HUGEINT) < {COVERED} * CAST(b.a AS HUGEINT)),
ordered AS (SELECT *, array_to_string(p, ' ') AS phrase FROM kept),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM ordered)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= {TOP}
"""
