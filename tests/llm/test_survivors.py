import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from motifmill.llm.survivors import Field, survivors

SCHEMA = "id bigint, k1 string, k2 string, s bigint, e bigint, grade int, weight double, at timestamp, _n string"


def fields():
    return [Field("grade", F.col("grade"), F.col("grade").between(1, 3), (-F.col("grade"),)), Field("weight", F.col("weight"), F.col("weight").between(0, 1), (F.col("weight"),))]


def expected(rows):
    groups = {}
    for r in rows:
        if None not in (r[1], r[2], r[3], r[4]) and r[4] > r[3]:
            groups.setdefault((r[1], r[2]), []).append(r)
    out = []
    for key, members in groups.items():
        members.sort(key=lambda r: r[3])
        islands, reach = [], None
        for r in members:
            if reach is None or r[3] >= reach:
                islands.append([])
                reach = r[4]
            islands[-1].append(r)
            reach = max(reach, r[4])
        for island in islands:
            stamp = lambda r: r[7] or datetime(1900, 1, 1)
            graded = [r for r in island if r[5] is not None and 1 <= r[5] <= 3]
            weighted = [r for r in island if r[6] is not None and 0 <= r[6] <= 1]
            g = max(graded, key=lambda r: (-r[5], stamp(r), -r[0]), default=None)
            w = max(weighted, key=lambda r: (r[6], stamp(r), -r[0]), default=None)
            out.append((*key, min(r[3] for r in island), max(r[4] for r in island), len(island), min(r[0] for r in island), g and g[0], g and g[5], w and w[0], w and w[6]))
    return sorted(out, key=repr)


@pytest.mark.parametrize("bits", [3, 6, 16])
def test_agrees_with_sweeping(spark, bits):
    rng = random.Random(11)
    rows = []
    for i in range(700):
        s = rng.randint(-40, 1500)
        rows.append((i, rng.choice(["hot", "hot", "c1", None]), rng.choice(["A", "AC", None, "B", "B"]), s, s + rng.choice([0, 1, 3, 9, 9, 30, 170]), rng.choice([None, 0, 1, 2, 3, 9]), rng.choice([None, -1.0, 0.2, 0.9, 0.9, 1.5]), rng.choice([None, datetime(2024, 1, 1) + timedelta(days=rng.randint(0, 5))]), "x"))
    rows += [(*r[:4], None, *r[5:]) for r in rows[:5]] + rows[:60]
    got = survivors(spark.createDataFrame(rows, SCHEMA), ["k1", "k2"], "s", "e", "id", "at", fields(), block_bits=bits).collect()
    found = sorted(((r["k1"], r["k2"], r["group_start"], r["group_end"], r["n_rows"], r["first_id"], r["grade_from"], r["grade"], r["weight_from"], r["weight"]) for r in got), key=repr)
    assert found == expected(rows)


def test_touching_is_no_duplicate_and_chains_are(spark):
    base = ("c", "A")
    rows = [(i, *base, s, e, 1, 0.5, None, "") for i, (s, e) in enumerate([(0, 10), (10, 20), (15, 100), (90, 200), (200, 201)])]
    got = survivors(spark.createDataFrame(rows, SCHEMA), ["k1", "k2"], "s", "e", "id", "at", fields(), block_bits=4).orderBy("first_id").collect()
    assert [(r["group_start"], r["group_end"], r["n_rows"]) for r in got] == [(0, 10, 1), (10, 200, 3), (200, 201, 1)]


def test_empty(spark):
    assert survivors(spark.createDataFrame([], SCHEMA), ["k1", "k2"], "s", "e", "id", "at", fields()).count() == 0
