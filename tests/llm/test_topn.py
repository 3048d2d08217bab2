import random

import pyarrow as pa
import pytest

from motifmill.llm import topn
from motifmill.llm.topn import top_n_per_group

SCHEMA = "g string, score bigint, a bigint, b bigint, rank_no string"


def expected(rows, n):
    out = []
    for g in {r[0] for r in rows} - {None}:
        members = sorted((r for r in rows if r[0] == g and r[1] is not None), key=lambda r: (-r[1], r[2] is None, r[2] or 0, r[3]))
        out += [(g, i + 1, r[1], r[2], r[3]) for i, r in enumerate(members[:n])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("partitions", [1, 7])
def test_agrees_with_sorting(spark, partitions):
    rng = random.Random(2)
    rows = [("hot" if rng.random() < 0.4 else f"g{rng.randint(0, 60)}", rng.choice([None, *range(12)]), rng.choice([None, 1, 2, 3]), i, "x") for i in range(2500)]
    rows += [(None, 5, 1, 9000, "x"), ("solo", None, 1, 9001, "x"), ("one", -4, 1, 9002, "x")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(partitions)
    got = top_n_per_group(df, "g", "score", ["a", "b"], 5).collect()
    assert sorted(((r["g"], r["rank_no"], r["score"], r["a"], r["b"]) for r in got), key=repr) == expected(rows, 5)


def test_repeated_rows_have_their_own_ranks(spark):
    df = spark.createDataFrame([("g", 7, 1, 1, "")] * 8, SCHEMA)
    assert sorted(r["rank_no"] for r in top_n_per_group(df, "g", "score", ["a", "b"], 5).collect()) == [1, 2, 3, 4, 5]


def test_nan_and_empty(spark):
    df = spark.createDataFrame([("g", float("nan"), 1), ("g", 2.5, 2), ("h", None, 3)], "g string, score double, id bigint")
    assert [(r["id"], r["rank_no"]) for r in top_n_per_group(df, "g", "score", ["id"], 3).collect()] == [(2, 1)]
    assert top_n_per_group(df.where("false"), "g", "score", ["id"], 3).count() == 0


@pytest.mark.parametrize("hot_groups", [0, 1, 100])
def test_hot_groups_or_none(spark, hot_groups):
    rng = random.Random(4)
    rows = [(rng.choice(["hot", "warm", "warm", f"g{rng.randint(0, 300)}"]), rng.choice([7, 7, 7, *range(8)]), rng.choice([None, 1]), i, "x") for i in range(3000)]
    got = top_n_per_group(spark.createDataFrame(rows, SCHEMA).repartition(9), "g", "score", ["a", "b"], 4, hot_groups=hot_groups).collect()
    assert sorted(((r["g"], r["rank_no"], r["score"], r["a"], r["b"]) for r in got), key=repr) == expected(rows, 4)


def test_a_task_with_many_groups_holds_few_rows(monkeypatch):
    monkeypatch.setattr(topn, "_FLUSH", 100)
    batches = [pa.RecordBatch.from_pydict({"g": [f"g{i}" for i in range(j, j + 60)], "score": [1] * 60, "a": list(range(60))}) for j in range(0, 6000, 60)]
    out = list(topn._local_best("g", "score", ["a"], 2)(iter(batches)))
    assert len(out) > 40 and sum(b.num_rows for b in out) == 6000
    one = [pa.RecordBatch.from_pydict({"g": ["h"] * 60, "score": list(range(j, j + 60)), "a": [0] * 60}) for j in range(0, 6000, 60)]
    (kept,) = topn._local_best("g", "score", ["a"], 2)(iter(one))
    assert kept.column("score").to_pylist() == [5999, 5998] and kept.column("_bound").to_pylist() == [None, 5998]


def test_the_table_is_read_once_and_only_thinned_rows_go_on(spark):
    df = spark.createDataFrame([("hot", i, 0, i, "") for i in range(4000)] + [(f"g{i}", 1, 0, i, "") for i in range(50)], SCHEMA).repartition(8)
    plan = top_n_per_group(df, "g", "score", ["a", "b"], 3)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan and "BroadcastHashJoin" in plan
