"""Mixing sources to target weights by Poisson replication.

A record's number of copies is the Poisson distribution, inverted at a uniform number made of its id by a seeded
hash, cut at the source's greatest number of repeats. Each source's Poisson mean is set so that the copies of
the source add up to its target size; the sums are taken over all records, in narrow hash classes, so the mean
is right for the copies really drawn and not only on average. What reaches the driver is one row for each
target source and hash class, whatever the number of records. Sizes are made once: rows with their size and
hash are written down, and sums and copies are both made of those.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from motifmill.session import checkpointed

CLASSES = 4096


@dataclass(frozen=True)
class Target:
    source: str
    share: float
    max_repeats: int


def uniform(record: Column, seed: int) -> Column:
    """A number in [0, 1) made of the record's id alone."""
    return F.pmod(F.xxhash64(record, F.lit(seed)), F.lit(1 << 52)) / F.lit(float(1 << 52))


def poisson_cdf(mean: float, up_to: int) -> list[float]:
    """P(N <= j) for j = 0 .. up_to - 1: the numbers of copies j + 1 begin there."""
    term, total, out = math.exp(-mean), 0.0, []
    for j in range(up_to):
        total += term
        out.append(total)
        term *= mean / (j + 1)
    return out


def _drawn(sizes: np.ndarray, mean: float, cap: int) -> float:
    """Size of the copies at a Poisson mean; ``sizes`` by hash class, evenly spread within a class."""
    n = len(sizes)
    above = np.concatenate([np.cumsum(sizes[::-1])[::-1], [0.0]])
    total = 0.0
    for c in poisson_cdf(mean, cap):
        at = min(c, 1.0) * n
        i = min(int(at), n - 1)
        total += above[i + 1] + sizes[i] * (1 - min(at - i, 1.0))
    return total


def solve_mean(sizes: np.ndarray, wanted: float, cap: int) -> float:
    """Poisson mean at which copies of at most ``cap`` a record add up to ``wanted``."""
    if wanted >= cap * sizes.sum() * (1 - 1e-9):
        return 700.0
    low, high = 0.0, 700.0
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if _drawn(sizes, middle, cap) < wanted else (low, middle)
    return (low + high) / 2


@dataclass(frozen=True)
class Mix:
    copies: DataFrame
    shares: DataFrame


def mix_sources(df: DataFrame, record: str, source: str, size: str, targets: list[Target], seed: int = 17, total_size: float | None = None, use_up: bool = True) -> Mix:
    """The mix, shuffled globally, and a report of the shares reached.

    ``copies`` has a row for each copy: (position_key, record, copy_no, source, size), in order of the hash
    ``position_key``. ``total_size`` is the size of the mix; more than the targets and caps allow raises. Without
    it the mix is as large as they allow: the scarcest source is then used up, each record ``max_repeats`` times.
    Without ``use_up`` it is as large as Poisson means of at most ``max_repeats`` allow, so that the counts of
    every source, the scarcest too, are drawn. Records without a source, of a source without a target, or of
    size 0 or null have no part. Sources without records reach a share of 0; the shares of the rest keep their
    proportion. ``expected_size`` in the report is what a source was to contribute, ``size_mixed`` what it does.
    """
    spark = df.sparkSession
    listed = df.select(F.col(record).alias("record"), F.col(source).alias("source"), F.col(size).cast("bigint").alias("size")).where(F.col("source").isin([t.source for t in targets]))
    rows = checkpointed(listed.withColumn("_u", uniform(F.col("record"), seed))).where("size > 0")
    classes = rows.groupBy("source", F.floor(F.col("_u") * CLASSES).cast("int").alias("_class")).agg(F.sum("size").alias("_size")).collect()
    sizes = {t.source: np.zeros(CLASSES) for t in targets}
    for row in classes:  # bounded: target sources x classes
        sizes[row["source"]][row["_class"]] = row["_size"]
    present = [t for t in targets if sizes[t.source].sum() > 0 and t.share > 0 and t.max_repeats > 0]
    weight = sum(t.share for t in present)
    most = min((t.max_repeats * sizes[t.source].sum() * weight / t.share for t in present), default=0.0)
    whole = most if use_up else min((_drawn(sizes[t.source], float(t.max_repeats), t.max_repeats) * weight / t.share for t in present), default=0.0)
    if total_size is not None:
        if total_size > most:
            raise ValueError(f"the targets and caps allow a mix of {most:.0f}, not of {total_size:.0f}")
        whole = total_size
    wanted = {t.source: whole * t.share / weight for t in present}
    means = {t.source: solve_mean(sizes[t.source], wanted[t.source], t.max_repeats) for t in present}
    limits = spark.createDataFrame([(t.source, poisson_cdf(means[t.source], t.max_repeats)) for t in present], "source string, _cdf array<double>")
    report = spark.createDataFrame([(t.source, float(t.share), int(t.max_repeats), float(means.get(t.source, 0.0)), float(wanted.get(t.source, 0.0))) for t in targets], "source string, target_share double, max_repeats int, poisson_mean double, expected_size double")
    counted = rows.join(F.broadcast(limits), "source").withColumn("_n", F.size(F.filter("_cdf", lambda c: F.col("_u") >= c)))
    copies = (
        counted.where("_n > 0")
        .withColumn("copy_no", F.explode(F.sequence(F.lit(1), F.col("_n"))))
        .select(F.xxhash64("record", "copy_no", F.lit(seed + 1)).alias("position_key"), "record", "copy_no", "source", "size")
        .orderBy("position_key", "record", "copy_no")
    )
    sums = counted.groupBy("source").agg(F.count(F.lit(1)).alias("n_records"), F.sum("size").alias("size_available"), F.sum("_n").alias("n_copies"), F.sum(F.col("size") * F.col("_n")).alias("size_mixed"), F.max("_n").alias("most_copies"))
    total = F.sum("size_mixed").over(Window.partitionBy(F.lit(0)))  # over the report: one row for each target
    numbers = [F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c) for c in ("n_records", "size_available", "n_copies", "size_mixed", "most_copies")]
    shares = report.join(sums, "source", "left").select("source", "target_share", F.coalesce(F.col("size_mixed") / total, F.lit(0.0)).alias("actual_share"), "max_repeats", "poisson_mean", "expected_size", *numbers)
    return Mix(copies, shares)
