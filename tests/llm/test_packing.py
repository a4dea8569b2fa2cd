import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from skerry.llm import packing
from skerry.llm.common import TokenBytes


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(packing.word_bpe())


def expected(tokenizer, text, capacity):
    ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
    return [(s, len(ids[s : s + capacity]), zlib.crc32(ids[s : s + capacity].tobytes())) for s in range(0, len(ids), capacity)]


def check(rows, capacity):
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


@pytest.mark.parametrize("capacity", [64, 4096])
def test_pieces_and_places(spark, odd, tokenizer, capacity):
    rows = packing.pack(odd, packing.word_bpe(), capacity=capacity).collect()
    got, want = Counter(), Counter()
    for r in rows:
        got[r.doc_id, r.start, r.length, r.ids_crc32] += 1
        assert r.start == r.piece * capacity
    for r in odd.collect():
        want.update((r.doc_id, *x) for x in expected(tokenizer, r.text, capacity))
    assert got == want
    check(rows, capacity)


def test_whole_table_is_packed_tightly(spark, docs, tokenizer):
    rows = packing.op1_best_fit_packing(spark, "/root/testdata/sf0.001").collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    by = defaultdict(list)
    for r in rows:
        by[r.doc_id].append((r.start, r.length, r.ids_crc32))
    assert {k: sorted(v) for k, v in by.items()} == {k: expected(tokenizer, t, 4096) for k, t in texts.items()}
    assert check(rows, 4096) <= -(-sum(r.length for r in rows) // 4096) + 1


def test_empty(empty):
    assert packing.pack(empty, packing.word_bpe()).collect() == []


def best_fit(counts, capacity):
    """Number of sequences by best fit, longest first, piece by piece."""
    gaps, n = Counter(), 0
    for length in sorted(counts.elements(), reverse=True):
        gap = next((g for g in range(length, capacity + 1) if gaps[g]), None)
        n += gap is None
        gaps[capacity if gap is None else gap] -= gap is not None
        gaps[(capacity if gap is None else gap) - length] += 1
    return n


@pytest.mark.parametrize("seed", range(6))
def test_plan_places_every_piece_once(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 100, 4096])
    counts = Counter(min(capacity, int(rng.paretovariate(0.7))) for _ in range(3000))
    counts[capacity // 2 + 1] += 1000
    runs, sequences = packing.plan(dict(counts), capacity)
    room, ranks = Counter(), defaultdict(list)
    for length, rank, n, first in runs:
        ranks[length] += range(rank, rank + n)
        for s in range(first, first + n):
            room[s] += length
    assert {k: sorted(v) for k, v in ranks.items()} == {k: list(range(n)) for k, n in counts.items()}
    assert max(room.values()) <= capacity
    assert max(room) < sequences
    # no more than two sequences are at most half full, as best fit guarantees
    assert sum(v * 2 <= capacity for v in room.values()) <= 1
    assert len(room) <= 1.03 * best_fit(counts, capacity) + 1


def test_plan_of_nothing():
    assert packing.plan({}, 4096) == ([], 0)


def test_knapsack_against_brute_force():
    rng = random.Random(3)
    for _ in range(30):
        values = np.array([0] + [rng.uniform(-1, 5) for _ in range(12)])
        best = [0.0] * 13
        for c in range(1, 13):
            best[c] = max([best[c - 1]] + [best[c - s] + values[s] for s in range(1, c + 1)])
        way = packing.knapsack(values)
        assert sum(way) <= 12 and abs(values[way].sum() - best[12]) < 1e-9


def test_token_bytes_equal_the_library(tokenizer):
    rng = random.Random(1)
    signs = ["a", "B", "é", "É", "'s", "'", "1", "12", " ", "\n", "\t", "\x1c", "\x85", " ", "<|endoftext|>", "<|", "Σ", "İ", "中", "ß", "!", "...", "ing", "thing", "é", "\U0001f600", "_", "\x00"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 30))) for _ in range(600)]
    own = TokenBytes(packing.word_bpe())
    own.MOST = 50  # so that what is kept is dropped again and again
    for at in range(0, 600, 40):
        for text, raw in zip(texts[at : at + 40], own.encode(texts[at : at + 40]), strict=True):
            assert np.frombuffer(raw, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text
