import random
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from vigil.llm import packing

from .cases import documents, texts, words


def test_ids_are_those_of_tokenizers():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    r = random.Random(5)
    odd = ["".join(r.choice([" ", " ", "\n", "\t", " ", " ", "\x1c", "\x85", "a", "B1", "'s", "é", ".", "漢", "<|endoftext|>"]) for _ in range(60)) for _ in range(800)]
    rows = [x or "" for x in texts()] + odd
    rows += ["".join(chr(r.choice([r.randrange(32, 0x250), r.randrange(0x370, 0x1000), r.randrange(0x3000, 0xA000)])) for _ in range(40)) for _ in range(300)]
    own = packing.ByteTokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    for x in rows:
        assert own.encode(x) == t.encode(x, add_special_tokens=False).ids, repr(x)


def plain_best_fit(counts, size=1024):
    """Piece by piece, longest first, into the fullest sequence with room."""
    gaps = []
    for k in sorted((k for k, n in counts.items() for _ in range(n)), reverse=True):
        room = [g for g in gaps if g >= k]
        if room:
            gaps.remove(min(room))
        gaps.append((min(room) if room else size) - k)
    return len(gaps)


@pytest.mark.parametrize("seed", range(8))
def test_best_fit_of_counts_is_that_of_pieces(seed):
    r = random.Random(seed)
    counts = Counter(min(1024, int(r.lognormvariate(5, 1.2)) + 1) for _ in range(r.choice([3, 60, 1500])))
    plan = packing.best_fit(counts)
    assert sum(t for t, _ in plan) == plain_best_fit(counts)
    used = Counter()
    for times, lengths in plan:
        assert sum(lengths) <= 1024
        for k in lengths:
            used[k] += times
    assert used == counts
    assert sum(t for t, _ in packing.plan_patterns(counts)) <= plain_best_fit(counts)


@pytest.mark.parametrize("seed", range(4))
def test_index_finds_a_filling_where_there_is_one(seed):
    r = random.Random(seed)
    have = np.zeros(65, np.int64)
    for _ in range(9):
        have[r.randint(1, 60)] += r.randint(1, 2)
    index = packing.Complements(have)
    pieces = [k for k in range(65) for _ in range(have[k])]
    for first in np.flatnonzero(have).tolist():
        rest = [*pieces]
        rest.remove(first)
        exact = any(sum(c) == 64 - first for n in (1, 2, 3) for c in combinations(rest, n))
        found = index.filling(first)
        assert (found is not None) == exact
        if found:
            assert sum(found) == 64 - first and not Counter([first, *found]) - Counter(pieces)


@pytest.mark.parametrize("seed", range(6))
def test_plan_uses_every_piece_once_and_few_sequences(seed):
    r = random.Random(seed)
    counts = {r.randint(1, 1024): r.randint(1, 10**r.randint(0, 7)) for _ in range(r.choice([1, 5, 60, 700]))}
    plan = packing.plan_patterns(counts)
    used = {}
    for times, lengths in plan:
        assert times > 0 and sum(lengths) <= 1024
        for k in lengths:
            used[k] = used.get(k, 0) + times
    assert used == counts
    assert len(plan) <= 5 * 1024
    assert sum(t for t, _ in plan) <= sum(t for t, _ in packing.best_fit(counts))
    least = -(-sum(k * v for k, v in counts.items()) // 1024)
    if len(counts) == 700:
        assert sum(t for t, _ in plan) <= least * 1.02 + 2


def test_plan_finds_singles_pairs_and_triples():
    assert sorted(packing.plan_patterns({1024: 2, 600: 1, 424: 1})) == [(1, (600, 424)), (2, (1024,))]
    assert packing.plan_patterns({700: 3, 200: 3, 124: 3}) == [(3, (700, 200, 124))]
    assert packing.plan_patterns({400: 1, 300: 1, 200: 1, 124: 1}) == [(1, (400, 300, 200, 124))]
    assert packing.plan_patterns({512: 5}) == [(2, (512, 512)), (1, (512,))]


def test_packed_documents(spark):
    docs = documents(spark, [*texts(), *[words(random.Random(i).randint(1, 900), i) for i in range(60)]])
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    out = packing.packed_documents(docs).collect()
    by_doc, by_sequence = {}, {}
    for r in out:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for r in docs.collect():
        ids = np.array([*t.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4")
        pieces = sorted(by_doc[r.doc_id], key=lambda p: p.piece)
        assert [p.piece for p in pieces] == [*range(len(pieces))]
        at = 0
        for p in pieces:
            assert p.start == at and p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            assert p.length == 1024 or p.piece == 0
            at += p.length
        assert at == len(ids)
    for s in by_sequence.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 1024
    total = sum(r.length for r in out)
    assert len(by_sequence) <= -(-total // 1024) * 1.05 + 1


def test_empty_table_and_repeated_rows(spark):
    docs = documents(spark, ["a b c", None])
    assert packing.packed_documents(docs.limit(0)).count() == 0
    twice = packing.packed_documents(docs.union(docs)).collect()
    assert len(twice) == 4 and len({(r.sequence_id, r.offset) for r in twice}) == 4


def test_ids_can_be_kept(spark):
    r = packing.token_pieces(documents(spark, ["a b c"]), with_ids=True).first()
    assert len(r.ids) == r.length == 4 and r.ids[-1] == 2
