import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from motifmill.operators.intervals import coalesce_blocks, decompose, gaps, merge_siblings, periods, uncovered


def union(intervals):
    out = []
    for s, e in sorted(intervals):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [tuple(x) for x in out]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 63), st.integers(1, 30)), max_size=12))
def test_blocks_make_the_union(pairs):
    intervals = [(s, min(64, s + n)) for s, n in pairs]
    starts, ends = (np.array([x[i] for x in intervals], dtype=np.int64) for i in (0, 1))
    owner, level, first = decompose(starts, ends, 6)
    for i, (s, e) in enumerate(intervals):
        covered = sorted(x for o, k, f in zip(owner, level, first) if o == i for x in range(f, f + 2**k))
        assert covered == list(range(s, e))
    first, level = merge_siblings(*uncovered(first, level), 6)
    assert all(f % 2**k == 0 for f, k in zip(first, level))
    assert list(zip(*(x.tolist() for x in coalesce_blocks(first, level, 6)))) == union(intervals)


def test_periods_and_gaps_across_regions(spark):
    rng = random.Random(7)
    rows = []
    for chrom in ("a", "b", "s", "entity"):
        for _ in range(300):
            s = rng.randint(-50, 3000)
            rows.append((chrom, s, s + rng.choice([1, 2, 5, 40, 300]), "extra"))
    rows += rows[:100] + [("a", 10, 10, ""), ("a", 20, 5, ""), ("a", 5, None, ""), (None, 1, 9, ""), ("a", None, 9, ""), ("one", 4, 9, "")]
    rows += [("wide", 0, 5000, ""), ("wide", 5000, 5001, ""), ("wide", 6000, 6001, "")]
    df = spark.createDataFrame(rows, "s string, first bigint, e bigint, region string")
    for bits in (4, 8, 20):
        want, want_gaps = set(), set()
        for chrom in {r[0] for r in rows} - {None}:
            merged = union([(s, e) for c, s, e, _ in rows if c == chrom and s is not None and e is not None and e > s])
            want |= {(chrom, *m) for m in merged}
            want_gaps |= {(chrom, a[1], b[0]) for a, b in zip(merged, merged[1:])}
        got = periods(df, "s", "first", "e", region_bits=bits).collect()
        assert len(got) == len(want) and {tuple(r) for r in got} == want
        assert {tuple(r) for r in gaps(df, "s", "first", "e", region_bits=bits).collect()} == want_gaps
        short = gaps(df, "s", "first", "e", 2, 10, region_bits=bits).collect()
        assert {tuple(r) for r in short} == {g for g in want_gaps if 2 <= g[2] - g[1] <= 10}


def test_empty_table(spark):
    df = spark.createDataFrame([], "c string, s bigint, e bigint")
    assert periods(df, "c", "s", "e").count() == 0 and gaps(df, "c", "s", "e").count() == 0
