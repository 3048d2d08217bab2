from collections import Counter

from pyspark.sql import functions as F

from motifmill.operators.skew import ROUTE, place, skew_free_aggregate


def steps():
    partial = [F.count(F.lit(1)).alias("n"), F.sum("v").alias("total"), F.max("label").alias("label")]
    return partial, [F.sum("n").alias("n"), F.sum("total").alias("total"), F.max("label").alias("label")]


def rows():
    out = [(i, "hot" if i % 3 == 0 else f"k{i % 97}", i, "x") for i in range(3000)]
    return [*out, *out[:50], (-1, None, 5, "x")]


def test_hot_key_is_cut_and_results_are_whole(spark):
    data = rows()
    df = spark.createDataFrame(data, "id bigint, k string, v bigint, _bucket string")
    other = spark.createDataFrame([("hot", "H"), ("k1", "one"), ("absent", "no"), (None, "null")], "k string, label string")
    got = {r["k"]: (r["n"], r["total"], r["label"]) for r in skew_free_aggregate(df, ["k"], F.col("id"), *steps(), len(data), other, tasks=6).collect()}
    count, total = Counter(), Counter()
    for _, k, v, _ in data:
        if k is not None:
            count[k] += 1
            total[k] += v
    assert got == {k: (count[k], total[k], {"hot": "H", "k1": "one"}.get(k)) for k in count}


def test_no_task_holds_much_more_than_its_share(spark):
    df = spark.createDataFrame(rows(), "id bigint, k string, v bigint, x string").dropna(subset=["k"])
    plan = place(df, ["k"], 3050, tasks=6)
    routed = plan.fragment(df, F.col("id")).groupBy(ROUTE).count().collect()
    assert max(r["count"] for r in routed) < 1.35 * 3050 / 6
    assert max(plan.task_loads) < 1.35 * 3050 / 6
    hot = [r for r in plan.heavy.collect() if r["k"] == "hot"]
    assert len(hot) == 1 and len(set(hot[0]["_mm_shards"])) >= 2


def test_empty_and_all_null(spark):
    schema = "id bigint, k string, v bigint, label string"
    assert skew_free_aggregate(spark.createDataFrame([], schema), ["k"], F.col("id"), *steps(), 0).count() == 0
    assert skew_free_aggregate(spark.createDataFrame([(1, None, 1, "a")], schema), ["k"], F.col("id"), *steps(), 1).count() == 0
