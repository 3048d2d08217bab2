import random
from collections import defaultdict

import pytest

from motifmill.llm.packing import best_fit_decreasing, pack_items


def naive(sizes, capacity):
    left, where = [], []
    for size in sizes:
        fits = [(r, i) for i, r in enumerate(left) if r >= size]
        if fits:
            tight = min(r for r, _ in fits)
            i = next(i for r, i in fits if r == tight)
        else:
            left.append(capacity)
            i = len(left) - 1
        left[i] -= size
        where.append(i)
    return where, sorted(left)


@pytest.mark.parametrize("capacity", [1, 7, 64, 100])
def test_finds_the_tightest_bin(capacity):
    rng = random.Random(capacity)
    for _ in range(40):
        sizes = sorted((rng.randint(0, capacity) for _ in range(rng.randint(0, 60))), reverse=True)
        where = best_fit_decreasing(sizes, capacity)
        left = defaultdict(lambda: capacity)
        for s, b in zip(sizes, where):
            left[b] -= s
        assert sorted(left.values()) == naive(sizes, capacity)[1]


def test_every_item_has_a_place(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice([None, 0, 3, 40, 99, 100, 101, 250, 1000]), "x") for i in range(800)] + [(5, 40, "x")] * 3
    df = spark.createDataFrame(rows, "item bigint, size bigint, shard string")
    got = pack_items(df, "item", "size", [("small", 100), ("large", 256)], len(rows), items_per_shard=200).collect()
    for kind, capacity in (("small", 100), ("large", 256)):
        own = [r for r in got if r["container_kind"] == kind]
        held, pieces = defaultdict(int), defaultdict(list)
        for r in own:
            held[r["shard"], r["bin_no"]] += r["piece_size"]
            pieces[r["item"]].append(r["piece_size"])
        assert max(held.values()) <= capacity and len({r["shard"] for r in own}) == 5
        want = defaultdict(list)
        for i, size, _ in rows:
            size = size or 0
            want[i] += [capacity] * (size // capacity) + ([size % capacity] if size % capacity or not size else [])
        assert {i: sorted(p) for i, p in pieces.items()} == {i: sorted(p) for i, p in want.items()}
        assert sum(held.values()) / (capacity * len(held)) > 0.9


def test_empty(spark):
    assert pack_items(spark.createDataFrame([], "item bigint, size bigint"), "item", "size", [("a", 5)], 0).count() == 0
