"""Packing against the library's ids, and plans against exhaustive search and one-by-one best fit."""

import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from test_tokens import TEXTS, packed
from txnlens.llm import packing
from txnlens.llm.queries import WORD_BPE

END = packed([1])


def test_ids_equal_the_library():
    library = Tokenizer.from_file(WORD_BPE)
    want = [packed(e.ids) for e in library.encode_batch(TEXTS, add_special_tokens=False)]
    assert packing.LibraryEncoder(WORD_BPE).encode(TEXTS) == want


def contents(lengths, capacity):
    """What lies in each sequence of a plan as (offset, length)."""
    counts = {}
    for x in lengths:
        counts[x] = counts.get(x, 0) + 1
    plan = packing.Plan(counts, capacity)
    rows = plan.arrays()
    out = [[] for _ in range(plan.sequences)]
    for x, n in counts.items():
        ranks = np.arange(n)
        for s, o in zip(*packing.places(rows, np.full(n, x), ranks)):
            out[s].append((int(o), x))
    return out


def one_by_one(lengths, capacity):
    """The same rule, piece by piece: greedy pairs of large ones, then best fit."""
    large = sorted(x for x in lengths if 3 * x > capacity)
    gaps = []
    while large:
        longest = large.pop()
        mate = max((x for x in large if x + longest <= capacity), default=0)
        if mate:
            large.remove(mate)
        gaps.append(capacity - longest - mate)
    for x in sorted((x for x in lengths if 3 * x <= capacity), reverse=True):
        gap = min((g for g in gaps if g >= x), default=None)
        if gap is None:
            gap = capacity
        else:
            gaps.remove(gap)
        gaps.append(gap - x)
    return len(gaps), sorted(gaps)


@pytest.mark.parametrize("seed", range(40))
def test_plan_equals_best_fit_one_by_one(seed):
    rng = random.Random(seed)
    capacity = rng.choice([1, 2, 7, 30, 100])
    pool = [rng.randint(1, capacity) for _ in range(rng.randint(1, 8))] if seed % 2 else range(1, capacity + 1)
    lengths = rng.choices(list(pool), k=rng.randint(0, 300))
    bins = contents(lengths, capacity)
    for own in bins:  # gapless from 0, nothing over the end
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert 0 < at <= capacity
    assert sorted(x for own in bins for _, x in own) == sorted(lengths)
    n, gaps = one_by_one(lengths, capacity)
    assert (len(bins), sorted(capacity - sum(x for _, x in own) for own in bins)) == (n, gaps)


def test_pairs_are_as_many_as_can_be():
    """Pieces above a third: as few sequences as any matching needs."""

    def least(left):
        if not left:
            return 0
        first, rest = left[0], left[1:]
        alone = 1 + least(rest)
        return min([alone, *(1 + least(rest[:i] + rest[i + 1 :]) for i, x in enumerate(rest) if first + x <= 30)])

    rng = random.Random(5)
    for _ in range(60):
        lengths = [rng.randint(11, 30) for _ in range(rng.randint(1, 7))]
        assert len(contents(lengths, 30)) == least(lengths)


def test_plan_is_bounded_by_the_capacity():
    rng = random.Random(1)
    counts = {x: rng.randint(1, 10**9) for x in range(1, 4097)}
    plan = packing.Plan(counts, 4096)
    assert len(plan.rows) < 20 * 4096
    assert plan.sequences < 1.02 * -(-sum(x * n for x, n in counts.items()) // 4096)
    assert not any(plan.left.values())


def check_packed(rows, sequences, capacity):
    library = Tokenizer.from_file(WORD_BPE)
    want = []
    for doc, text in rows:
        ids = np.frombuffer(packed(library.encode(text or "", add_special_tokens=False).ids) + END, "<u4")
        for piece, start in enumerate(range(0, len(ids), capacity)):
            want.append((str(doc), piece, start, ids[start : start + capacity].tobytes()))
    got = []
    for s in sequences:
        at = 0
        for p in s.pieces:
            assert p.offset == at
            at += p.length
            got.append((str(p.doc_id), p.piece, p.start, bytes(s.ids[4 * p.offset : 4 * at])))
        assert 4 * at == len(s.ids) <= 4 * capacity
    assert len({s.sequence_id for s in sequences}) == len(sequences)
    assert sorted(got) == sorted(want)


@pytest.mark.parametrize("limit", [0, packing.BROADCAST_ROWS])
def test_whole_documents(documents, monkeypatch, limit):
    monkeypatch.setattr(packing, "BROADCAST_ROWS", limit)  # counts by shuffle and by broadcast
    rows = [*enumerate(TEXTS[-250:]), (7, "the same id"), (7, "the same id"), (None, "no id"), (None, None), (900, None), (901, "")]
    rows += [(902, "long text " * 2000)]
    check_packed(rows, packing.pack(documents(rows), WORD_BPE, capacity=64).collect(), 64)


def test_nothing_and_one(documents):
    assert packing.pack(documents([]), WORD_BPE).collect() == []
    (only,) = packing.pack(documents([(5, None)]), WORD_BPE).collect()
    assert bytes(only.ids) == END and only.pieces[0].doc_id == 5
    assert zlib.crc32(END) == zlib.crc32(packed([1]))


def test_many_equal_pieces(documents):
    """A hot length: numbers run through all tasks without a gap."""
    rows = [(i, "a") for i in range(500)]
    found = packing.pack(documents(rows), WORD_BPE, capacity=10).collect()
    assert len(found) == 100 and all(len(s.pieces) == 5 for s in found)
