"""Numbering rows of a distributed table without gathering them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from motifmill.session import checkpointed


def number_rows(df: DataFrame, order: list[Column | str], name: str) -> DataFrame:
    """Adds ``name``, the place from 0 of each row in ``order``.

    Rows are range-sorted, and each partition adds the sizes of those before it to its own count: no task holds
    the whole.
    """
    placed = checkpointed(df.orderBy(*order).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()))
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))  # a row for each partition
    return placed.join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1)).drop("_part", "_at", "_before")


def number_within(df: DataFrame, per: list[str], blocks: list[str], last: list[Column | str], name: str) -> DataFrame:
    """Adds ``name``, the place from 0 of each row among those of equal ``per``, in order of ``blocks`` and then ``last``.

    Rows are numbered within blocks of equal ``per`` and ``blocks``, and the sizes of the blocks before are added, so
    a group that holds most rows is spread over its blocks. None of these columns may be null.
    """
    keys = list(dict.fromkeys([*per, *blocks]))
    rows = checkpointed(df)
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*per).orderBy(*[b for b in blocks if b not in per]).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*keys, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy(*keys).orderBy(*last)) - 1
    return rows.withColumn("_inside", inside).join(offsets, keys).withColumn(name, F.col("_before") + F.col("_inside")).drop("_before", "_inside")


def first_within(df: DataFrame, per: list[str], order: list[Column | str], n: int, name: str) -> DataFrame:
    """The ``n`` first rows in ``order`` of each group ``per``, with their place ``name`` from 0.

    Each task thins its own rows to ``n`` of a group before they are shuffled.
    """
    ranked = df.withColumn(name, F.row_number().over(Window.partitionBy(*per).orderBy(*order))).where(F.col(name) <= n)
    return ranked.withColumn(name, F.col(name) - 1)
