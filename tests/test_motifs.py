import random

from pyspark.sql import functions as F

from motifmill.functions.motifs import canonical_motif, clean_motif, is_lyndon, is_primitive, least_rotation, primitive_root_length
from motifmill.operators.index import count_occurrences
from motifmill.plans.repeats import enumerate_motifs


def root(s):
    return next(s[:d] for d in range(1, len(s) + 1) if len(s) % d == 0 and s[:d] * (len(s) // d) == s)


def rotation(s):
    return min(s[i:] + s[:i] for i in range(len(s)))


def test_motif_algebra_agrees_with_definitions(spark):
    rng = random.Random(3)
    words = ["".join(rng.choice("ACGT"[: rng.randint(1, 4)]) for _ in range(rng.randint(1, 12))) * rng.randint(1, 3) for _ in range(400)] + ["A", "AT" * 80, "ACGTACG"]
    df = spark.createDataFrame([(w,) for w in words], "m string")
    m = F.col("m")
    for row in df.select("m", primitive_root_length(m).alias("q"), is_primitive(m).alias("p"), least_rotation(m).alias("r"), is_lyndon(m).alias("l"), canonical_motif(m).alias("c")).collect():
        assert row["q"] == len(root(row["m"]))
        assert row["p"] == (root(row["m"]) == row["m"])
        assert row["r"] == rotation(row["m"])
        assert row["l"] == (row["p"] and row["r"] == row["m"])
        assert row["c"] == rotation(root(row["m"]))


def test_dirty_motifs(spark):
    rows = [(" ta ",), ("\tacac",), ("",), ("   ",), (None,)]
    got = spark.createDataFrame(rows, "m string").select(clean_motif(F.col("m")).alias("c"), canonical_motif(F.col("m")).alias("k"), least_rotation(F.col("m")).alias("r")).collect()
    assert [r["c"] for r in got] == ["TA", "ACAC", None, None, None]
    assert [r["k"] for r in got] == ["AT", "AC", None, None, None]
    assert got[2]["r"] == "" and got[4]["r"] is None


def test_enumeration_counts(spark):
    counts = {r["k"]: r["count"] for r in enumerate_motifs(spark, [1, 2, 3, 4, 5, 6]).groupBy("k").count().collect()}
    assert counts == {1: 4, 2: 6, 3: 20, 4: 60, 5: 204, 6: 670}


def test_pattern_counts_overlap(spark):
    df = spark.createDataFrame([("AAAA",), ("",), ("A.A",)], "t string")
    assert [r[0] for r in df.select(count_occurrences(F.col("t"), "AA")).collect()] == [3, 0, 0]
    assert [r[0] for r in df.select(count_occurrences(F.col("t"), ".")).collect()] == [0, 0, 1]
    assert [r[0] for r in df.select(count_occurrences(F.col("t"), "")).collect()] == [4, 0, 3]
