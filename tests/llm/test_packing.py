"""Packing: nothing lost, nothing too full, nothing split without need, few containers."""

import os
import random
from collections import Counter

import pytest

from spindrift.llm import packing as P


def best_fit(lengths, capacity):
    """Plain best-fit decreasing, item by item."""
    room = []
    for n in sorted(lengths, reverse=True):
        fit = [i for i, r in enumerate(room) if r >= n]
        if fit:
            room[min(fit, key=lambda i: room[i])] -= n
        else:
            room.append(capacity - n)
    return len(room)


@pytest.mark.parametrize("seed", range(8))
def test_plan_packs_like_best_fit(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 50, 100])
    lengths = [rng.choice([rng.randint(1, capacity), rng.randint(1, max(1, capacity // 5)), 3]) for _ in range(rng.choice([1, 40, 700]))]
    slots, used = P.plan(Counter(lengths), capacity)
    filled, taken = Counter(), Counter()
    for s in slots:
        for rank in range(s.first, s.first + s.n):
            assert (s.length, rank) not in taken
            taken[s.length, rank] += 1
            filled[s.container + (rank - s.first) // s.each] += s.length
    assert {n: sum(1 for length, _ in taken if length == n) for n in set(lengths)} == Counter(lengths)
    assert max(filled.values()) <= capacity and set(filled) == set(range(used))
    assert used == best_fit(lengths, capacity)


def test_plan_edges():
    assert P.plan({}, 10) == ([], 0)
    assert P.plan({10: 3}, 10)[1] == 3 and P.plan({5: 3}, 10)[1] == 2
    for bad in ({0: 1}, {11: 1}):
        with pytest.raises(ValueError):
            P.plan(bad, 10)
    slots, used = P.plan({4: 10**12, 2: 10**12}, 10)  # counts, not items
    assert used == 6 * 10**11 and len(slots) < 10


def test_pack(spark, monkeypatch):
    monkeypatch.setattr(P, "RANK_BLOCK", 50)
    rng = random.Random(1)
    sizes = [(i, rng.choice([0, 7, 7, 7, rng.randint(1, 100), rng.randint(100, 350)])) for i in range(600)] + [(5, 7), (5, 7), (700, None), (701, 100), (702, 200), (703, -3)]
    rows = P.pack(spark.createDataFrame(sizes, "doc_id bigint, n_tokens bigint").repartition(7), 100).collect()
    full = Counter()
    by_doc = {}
    for r in rows:
        full[r.container_id] += r.n_tokens
        by_doc.setdefault(r.doc_id, []).append((r.piece, r.token_start, r.n_tokens))
    assert max(full.values()) <= 100 and set(full) == set(range(len(full)))
    for i in {i for i, n in sizes if n and n > 0} - {5}:
        n = dict(sizes)[i]
        assert sorted(by_doc[i]) == [(k, 100 * k, min(100, n - 100 * k)) for k in range(-(-n // 100))]
    assert not {700, 703} & set(by_doc) and len(by_doc[5]) >= 2
    assert len(full) <= -(-sum(full.values()) // 100) + 2
    assert P.pack(spark.createDataFrame([], "doc_id bigint, n_tokens bigint"), 100).collect() == []


@pytest.mark.skipif(not os.path.exists(P.VOCABULARY), reason="no vocabulary here")
def test_documents(spark):
    texts = [(1, "The cat sat."), (2, None), (3, ""), (4, "<|endoftext|>"), (5, "spike " * 40_000), (6, "ü" * 3000), (1, "The cat sat.")]
    df = spark.createDataFrame([(*t, "x") for t in texts], "doc_id bigint, text string, n_tokens string")
    counts = {r.doc_id: r.n_tokens for r in P.token_counts(df).collect()}
    assert counts[1] == 4 and counts[2] == counts[3] == 0 and counts[4] > 1 and counts[5] >= 40_000
    rows = P.pack_documents(df).collect()
    total = Counter()
    for r in rows:
        total[r.doc_id] += r.n_tokens
    assert total == {1: 8, 4: counts[4], 5: counts[5], 6: counts[6]}
    assert sum(r.doc_id == 1 for r in rows) == 2
