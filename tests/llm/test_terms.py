import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from motifmill.llm.terms import mark_by_spread, term_frequencies


def test_agrees_with_counting(spark):
    rng = random.Random(5)
    pairs = [("hot" if rng.random() < 0.4 else rng.choice([None, "", f"t{rng.randint(0, 40)}"]), rng.choice([None, *range(30)])) for _ in range(4000)]
    pairs += pairs[:200]
    df = spark.createDataFrame([(a, b, "x") for a, b in pairs], "term string, r bigint, n string").repartition(6)
    occurrences, records = Counter(), defaultdict(set)
    for t, r in pairs:
        if t is not None and r is not None:
            occurrences[t] += 1
            records[t].add(r)
    got = term_frequencies(df, F.col("term"), F.col("r"), partitions=5).collect()
    assert {r["term"]: (r["occurrences"], r["records"]) for r in got} == {t: (occurrences[t], len(records[t])) for t in occurrences}
    assert len(got) == len(occurrences)


def test_marks_and_empty(spark):
    df = spark.createDataFrame([("a", 1, 1), ("b", 9, 3), ("c", 9, 8)], "term string, occurrences bigint, records bigint")
    assert {r["term"]: r["mark"] for r in mark_by_spread(df, 10, 2, 0.5).collect()} == {"a": "rare", "b": None, "c": "common"}
    empty = spark.createDataFrame([], "t string, r string")
    assert term_frequencies(empty, F.col("t"), F.col("r")).count() == 0
