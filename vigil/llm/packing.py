"""Packing token pieces into sequences: exact complements by length first, best fit for the rest."""

from __future__ import annotations

import json
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, hash_bucket, ranked

MAX_TOKENS = 1024
END_ID = 2
ROWS_A_BUCKET = 4000
#: How byte-level BPE splits a text first.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> dict[str, int]:
    """The byte for which each letter of such a vocabulary stands: printable Latin-1 for itself, others from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class ByteTokenizer:
    """The ids that tokenizers gives for a byte-level BPE file, without special tokens added.

    A vocabulary whose ids follow its merges, as byte_bpe_50k.json's do, is run by tiktoken, which gives the same ids
    in a third of the time; any other file by tokenizers itself. Special tokens that stand in a text keep their ids.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        vocab, merges = model["model"]["vocab"], model["model"]["merges"]
        special = {t["content"]: t["id"] for t in model["added_tokens"]}
        merged = ["".join(m.split(" ") if isinstance(m, str) else m) for m in merges]
        pre = model.get("pre_tokenizer") or {}
        plain = not model.get("normalizer") and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
        if plain and [vocab.get(m) for m in merged] == [*range(256, 256 + len(merged))]:
            import tiktoken

            letters = byte_letters()
            ranks = {bytes(letters[c] for c in t): i for t, i in vocab.items() if t not in special}
            own = tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
            self.encode = lambda text: own.encode(text, allowed_special="all") if any(s in text for s in special) else own.encode_ordinary(text)
        else:
            from tokenizers import Tokenizer

            whole = Tokenizer.from_file(path)
            self.encode = lambda text: whole.encode(text, add_special_tokens=False).ids


def token_pieces(docs: DataFrame, tokenizer: str | None = None, max_tokens: int = MAX_TOKENS, end_id: int = END_ID, with_ids: bool = False, id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids if asked for) of every piece of every text.

    A document is its text's ids and end_id; null counts as empty. One longer than max_tokens is cut into pieces of
    max_tokens, of which the first takes the remainder.
    """
    path = tokenizer or default_tokenizer()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = ByteTokenizer(path)
        for batch in batches:
            yield made(batch.column(0), (own.encode(x.as_py() or "") for x in batch.column(1)))

    def made(ids: pa.Array, tokens: Iterator[list[int]]) -> pa.RecordBatch:
        doc, piece, start, length, crc, kept = [], [], [], [], [], []
        for i, t in enumerate(tokens):
            t = np.array([*t, end_id], "<u4")
            edges = [0, *range(len(t) % max_tokens or max_tokens, len(t) + 1, max_tokens)]
            for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
                doc.append(i), piece.append(k), start.append(a), length.append(b - a)
                crc.append(zlib.crc32(t[a:b].tobytes()))
                if with_ids:
                    kept.append(t[a:b].tolist())
        columns = [ids.take(pa.array(doc, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
        names = ["doc_id", "piece", "start", "length", "ids_crc32"]
        return pa.record_batch(columns + [pa.array(kept, pa.list_(pa.int32()))] * with_ids, names + ["ids"] * with_ids)

    kind = docs.schema[id].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return docs.select(F.col(id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(rows, schema)


Pattern = tuple[int, tuple[int, ...]]


def fits(have: np.ndarray, lengths: tuple[int, ...]) -> bool:
    return all(have[k] >= v for k, v in Counter(lengths).items())


class Complements:
    """An index of the sums of one, two and three lengths that are still there, by which exact fillings are looked up.

    Pairs are filed under their sums, the longer half first. A triple is its longest length and the pair filed under
    the rest. Counts only fall, so a pair whose lengths are used up is dropped when it is met.
    """

    def __init__(self, have: np.ndarray):
        self.have, self.size = have, len(have) - 1
        self.pairs: list[list[int]] = [[] for _ in range(self.size + 1)]
        for x in np.flatnonzero(have).tolist():  # rising, so that the last of a list is the longest
            for y in np.flatnonzero(have[: min(x, self.size - x) + 1]).tolist():
                self.pairs[x + y].append(x)

    def pair(self, total: int, held: tuple[int, ...] = ()) -> tuple[int, ...] | None:
        filed = self.pairs[total]
        while filed and not fits(self.have, (filed[-1], total - filed[-1])):
            filed.pop()
        for x in reversed(filed):  # the first one, unless held takes what it needs
            if fits(self.have, (*held, x, total - x)):
                return x, total - x
        return None

    def filling(self, first: int) -> tuple[int, ...] | None:
        """Up to three lengths that fill what first leaves exactly."""
        gap = self.size - first
        if not gap:
            return ()
        if fits(self.have, (first, gap)):
            return (gap,)
        if found := self.pair(gap, (first,)):
            return found
        for x in np.flatnonzero(self.have[: gap - 1])[::-1].tolist():
            if 3 * x < gap:
                break
            if fits(self.have, (first, x)) and (found := self.pair(gap - x, (first, x))):
                return (x, *found)
        return None


def best_fit(counts: dict[int, int], size: int = MAX_TOKENS, opened: list[Pattern] | None = None) -> list[Pattern]:
    """(times, lengths) of sequences by best fit, longest length first, on top of those opened: every piece goes into
    the fullest sequence that has room. Sequences that are alike are one entry, split where a length runs out."""
    gaps: dict[int, list[Pattern]] = {}
    for times, lengths in opened or []:
        gaps.setdefault(size - sum(lengths), []).append((times, lengths))
    for k in sorted((k for k, n in counts.items() if n), reverse=True):
        left = int(counts[k])
        while left:
            gap = min((g for g in gaps if g >= k), default=None)
            if gap is None:
                each = size // k
                for times, n in ((left // each, each), (1, left % each)):
                    if times and n:
                        gaps.setdefault(size - n * k, []).append((times, (k,) * n))
                break
            times, lengths = gaps[gap].pop()
            if times > left:
                gaps[gap].append((times - left, lengths))
            if not gaps[gap]:
                del gaps[gap]
            used = min(times, left)
            gaps.setdefault(gap - k, []).append((used, (*lengths, k)))
            left -= used
    return [p for held in gaps.values() for p in held]


def by_complements(counts: dict[int, int], size: int = MAX_TOKENS, shortest: int = 1) -> list[Pattern]:
    """Sequences begun by lengths of shortest and more, longest first, filled exactly as often as counts allow; what is
    left is packed best fit. A filling uses a length up, so there are a few times size entries at most."""
    have = np.zeros(size + 1, np.int64)
    for k, v in counts.items():
        have[k] = v
    index, out = Complements(have), []
    rest: Counter[int] = Counter()
    for first in range(size, shortest - 1, -1):
        while have[first]:
            if (found := index.filling(first)) is None:
                rest[first] = int(have[first])
                have[first] = 0
                break
            lengths = (first, *found)
            times = int(min(have[k] // v for k, v in Counter(lengths).items()))
            for k in lengths:
                have[k] -= times
            out.append((times, lengths))
    left = rest + Counter({k: int(have[k]) for k in np.flatnonzero(have).tolist()})
    return out + best_fit(left, size)


def plan_patterns(counts: dict[int, int], size: int = MAX_TOKENS) -> list[Pattern]:
    """(times, lengths) of sequences that use counts up: exact complements, then best fit for what is left.

    Fillings spend short lengths, which best fit may need more; so complements are taken for all lengths, for those
    over half, three quarters and so on of a sequence, or for none, whichever needs the fewest sequences. The result
    is never worse than best fit of everything.
    """
    starts = [1, size // 2, 3 * size // 4, 7 * size // 8, 15 * size // 16]
    plans = [by_complements(counts, size, s) for s in starts] + [best_fit(counts, size)]
    return min(plans, key=lambda p: sum(t for t, _ in p))


def pack(pieces: DataFrame, size: int = MAX_TOKENS) -> DataFrame:
    """pieces with sequence_id and offset, in as few sequences of size as the plan needs.

    The plan is made from the counts of each length alone (size rows at most) and is broadcast: a few times size
    entries of up to size lengths, whatever the number of pieces. A piece's place follows from its rank among those of its length, ranked without gathering a length in
    one task. pieces must have doc_id, piece, length, ids_crc32 and stay the same when computed again.
    """
    counts = {r.length: r.n for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    taken: Counter = Counter()
    plan, base = [], 0
    for times, lengths in plan_patterns(counts, size):
        offset = 0
        for k in lengths:
            plan.append((k, taken[k], taken[k] + times, base, offset))
            taken[k] += times
            offset += k
        base += times
    places = pieces.sparkSession.createDataFrame(plan, "length long, _lo long, _hi long, _base long, offset long")
    n = max(1, -(-sum(counts.values()) // ROWS_A_BUCKET))
    rows = ranked(pieces, ["length"], hash_bucket(n, "doc_id", "piece", "ids_crc32"), [F.col("doc_id"), F.col("piece"), F.col("ids_crc32")], "_rank")
    placed = rows.join(F.broadcast(places), (rows.length == places.length) & (F.col("_rank") >= F.col("_lo")) & (F.col("_rank") < F.col("_hi"))).drop(places.length)
    return placed.withColumn("sequence_id", F.col("_base") + F.col("_rank") - F.col("_lo")).drop("_rank", "_lo", "_hi", "_base")


def packed_documents(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Every piece of every document with its place: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = cut(token_pieces(docs, tokenizer))
    return pack(pieces).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
