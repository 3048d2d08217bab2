import math
import random
from collections import defaultdict

import numpy as np
import pytest

from motifmill.llm.mixing import Target, mix_sources, poisson_cdf, solve_mean

SCHEMA = "id bigint, source string, size bigint, copy_no string"


def corpus():
    rng = random.Random(3)
    shares = {"big": 0.75, "mid": 0.2, "small": 0.05}
    rows = [(i, rng.choices(list(shares), list(shares.values()))[0], rng.choice([None, 0, *range(20, 400)]), "x") for i in range(6000)]
    return rows + [(9000, None, 50, "x"), (9001, "unknown", 50, "x")]


def test_shares_are_reached(spark):
    targets = [Target("big", 0.5, 1), Target("mid", 0.3, 3), Target("small", 0.2, 4)]
    rows = corpus()
    mix = mix_sources(spark.createDataFrame(rows, SCHEMA), "id", "source", "size", targets)
    copies = mix.copies.collect()
    sizes = defaultdict(int)
    for r in copies:
        sizes[r["source"]] += r["size"]
    whole = sum(sizes.values())
    report = {r["source"]: r for r in mix.shares.collect()}
    for t in targets:
        assert abs(sizes[t.source] / whole - t.share) < 0.01
        assert math.isclose(report[t.source]["actual_share"], sizes[t.source] / whole)
        assert report[t.source]["most_copies"] <= t.max_repeats and report[t.source]["size_mixed"] == sizes[t.source]
    assert set(sizes) == {"big", "mid", "small"}
    numbers = defaultdict(list)
    for r in copies:
        numbers[r["record"]].append(r["copy_no"])
    assert all(sorted(v) == list(range(1, len(v) + 1)) for v in numbers.values())
    keys = [r["position_key"] for r in copies]
    assert keys == sorted(keys)
    assert len({r["source"] for r in copies[:50]}) > 1
    # the scarcest source is used up
    small = [r for r in rows if r[1] == "small" and r[2]]
    assert report["small"]["n_copies"] == 4 * len(small)


def test_same_seed_same_mix_and_other_seed_another(spark):
    df = spark.createDataFrame(corpus(), SCHEMA)
    targets = [Target("big", 0.6, 1), Target("mid", 0.4, 2)]
    a, b, c = (sorted((r["record"], r["copy_no"]) for r in mix_sources(df.repartition(p), "id", "source", "size", targets, seed=s).copies.collect()) for p, s in ((2, 1), (5, 1), (2, 2)))
    assert a == b and a != c


def test_counts_follow_the_poisson_distribution():
    cdf = poisson_cdf(1.5, 4)
    assert cdf == pytest.approx([sum(math.exp(-1.5) * 1.5**i / math.factorial(i) for i in range(j + 1)) for j in range(4)])
    mean = solve_mean(np.ones(4096), 4096 * 0.7, 3)
    expected = sum(1 - c for c in poisson_cdf(mean, 3))
    assert expected == pytest.approx(0.7, abs=1e-3)


def test_empty_and_missing_sources(spark):
    empty = mix_sources(spark.createDataFrame([], SCHEMA), "id", "source", "size", [Target("a", 1.0, 2)])
    assert empty.copies.count() == 0 and [r["actual_share"] for r in empty.shares.collect()] == [0.0]
    one = mix_sources(spark.createDataFrame([(1, "a", 10, "")], SCHEMA), "id", "source", "size", [Target("a", 0.5, 2), Target("b", 0.5, 2)])
    assert one.copies.count() == 2 and {r["source"]: r["actual_share"] for r in one.shares.collect()} == {"a": 1.0, "b": 0.0}


@pytest.mark.parametrize("share", [0.9, 0.3, 0.02])
def test_a_smaller_mix_keeps_the_shares(spark, share):
    targets = [Target("big", 0.5, 1), Target("mid", 0.3, 3), Target("small", 0.2, 4)]
    df = spark.createDataFrame(corpus(), SCHEMA)
    most = sum(r["expected_size"] for r in mix_sources(df, "id", "source", "size", targets).shares.collect())
    report = mix_sources(df, "id", "source", "size", targets, total_size=share * most).shares.collect()
    for r in report:
        assert math.isclose(r["expected_size"], share * most * r["target_share"])
        assert abs(r["size_mixed"] - r["expected_size"]) < 0.02 * r["expected_size"] + 2000
        assert r["most_copies"] <= r["max_repeats"] and r["poisson_mean"] < 700
    with pytest.raises(ValueError, match="allow a mix of"):
        mix_sources(df, "id", "source", "size", targets, total_size=1.01 * most)


def test_counts_of_every_source_are_drawn(spark):
    targets = [Target("big", 0.5, 1), Target("mid", 0.3, 3), Target("small", 0.2, 4)]
    mix = mix_sources(spark.createDataFrame(corpus(), SCHEMA), "id", "source", "size", targets, use_up=False)
    for r in mix.shares.collect():
        assert abs(r["actual_share"] - r["target_share"]) < 0.01 and r["poisson_mean"] <= r["max_repeats"] + 1e-6
        assert 0 < r["n_copies"] < r["max_repeats"] * r["n_records"]
    drawn = {}
    for r in mix.copies.collect():
        if r["source"] == "small":
            drawn[r["record"]] = drawn.get(r["record"], 0) + 1
    assert set(drawn.values()) == {1, 2, 3, 4}


def test_sizes_are_made_once(spark):
    from pyspark.sql import functions as F

    sized = spark.createDataFrame(corpus(), SCHEMA).withColumn("size", F.udf(lambda x: x, "bigint")("size"))
    mix = mix_sources(sized, "id", "source", "size", [Target("big", 0.5, 1), Target("mid", 0.5, 2)])
    for frame in (mix.copies, mix.shares):
        assert "EvalPython" not in frame._jdf.queryExecution().executedPlan().toString()
