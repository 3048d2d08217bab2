"""Per-key work without stragglers: fragment and replicate by estimated load.

Keys are packed to tasks by load. A key that would overload its task is cut into a proportionate number of
shards which go to different tasks, and the matching side of a join is copied to those shards only. The
placement is bounded by the number of tasks, never by the number of keys: only keys that hold a quarter of a
task's fair share or more are placed one by one (at most four times as many as tasks); all others share hash
buckets (eight times as many as tasks) that are packed as units.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motifmill.session import shuffle_width

ROUTE = "_mm_route"
_BUCKETS_PER_TASK = 8
_HEAVY_SHARE = 0.25


@dataclass(frozen=True)
class Placement:
    """Where rows go: the tasks of each heavy key's shards, and the task of each bucket of light keys."""

    keys: tuple[str, ...]
    tasks: int
    heavy: DataFrame
    buckets: DataFrame
    task_loads: tuple[float, ...]

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.tasks * _BUCKETS_PER_TASK))

    def _routed(self, df: DataFrame) -> DataFrame:
        return df.withColumn("_mm_bucket", self._bucket()).join(F.broadcast(self.heavy), list(self.keys), "left").join(F.broadcast(self.buckets), "_mm_bucket", "left")

    def fragment(self, df: DataFrame, spread: Column) -> DataFrame:
        """``df`` with the task of each row in ``_mm_route``; rows of a heavy key go to its shards by the hash of ``spread``."""
        shard = F.get(F.col("_mm_shards"), F.pmod(F.xxhash64(spread), F.size("_mm_shards")).cast("int"))
        light = F.coalesce(F.col("_mm_task"), F.pmod(F.col("_mm_bucket"), F.lit(self.tasks)).cast("int"))
        return self._routed(df).withColumn(ROUTE, F.when(F.col("_mm_shards").isNotNull(), shard).otherwise(light)).drop("_mm_shards", "_mm_task", "_mm_bucket").repartitionById(self.tasks, ROUTE)

    def replicate(self, df: DataFrame) -> DataFrame:
        """The matching side: one copy of a row for each task that holds a shard of its key."""
        light = F.coalesce(F.col("_mm_task"), F.pmod(F.col("_mm_bucket"), F.lit(self.tasks)).cast("int"))
        return self._routed(df).withColumn(ROUTE, F.explode(F.coalesce(F.array_distinct("_mm_shards"), F.array(light)))).drop("_mm_shards", "_mm_task", "_mm_bucket").repartitionById(self.tasks, ROUTE)


def pack(loads: list[tuple[object, float]], tasks: int) -> tuple[list[int], list[float]]:
    """Longest-processing-time packing: the task of each load, and the resulting load of each task."""
    heap = [(0.0, t) for t in range(tasks)]
    where = [0] * len(loads)
    for i in sorted(range(len(loads)), key=lambda i: (-loads[i][1], i)):
        load, t = heapq.heappop(heap)
        where[i] = t
        heapq.heappush(heap, (load + loads[i][1], t))
    totals = [0.0] * tasks
    for load, t in heap:
        totals[t] = load
    return where, totals


def place(df: DataFrame, keys: list[str], total_rows: int, tasks: int | None = None, loads: DataFrame | None = None) -> Placement:
    """Plan for ``df`` by the row counts of its keys, or by ``loads`` (keys and ``_mm_load``) where they are known already.

    ``total_rows`` is an upper bound of the rows of ``df`` and sets a task's fair share. The counts are
    combined on the map side, so a hot key costs no task more than its own partition; the driver receives at
    most 12 rows a task. Rows with a null in a key must be removed before.
    """
    spark = df.sparkSession
    tasks = tasks or shuffle_width(spark)
    fair = max(1.0, total_rows / tasks)
    heavy_from = max(1.0, fair * _HEAVY_SHARE)
    bucket = F.pmod(F.xxhash64(*keys), F.lit(tasks * _BUCKETS_PER_TASK))
    loads = (df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_mm_load")) if loads is None else loads).withColumn("_mm_big", F.col("_mm_load") >= heavy_from)
    units = loads.groupBy(
        F.when(~F.col("_mm_big"), bucket).alias("_mm_bucket"),
        *[F.when(F.col("_mm_big"), F.col(k)).alias(k) for k in keys],
    ).agg(F.sum("_mm_load").alias("_mm_load"))
    items: list[tuple[object, float]] = []
    for row in units.collect():  # bounded: buckets + heavy keys
        if row["_mm_bucket"] is not None:
            items.append((int(row["_mm_bucket"]), float(row["_mm_load"])))
        else:
            shards = math.ceil(row["_mm_load"] / fair)
            items.extend((tuple(row[k] for k in keys), row["_mm_load"] / shards) for _ in range(shards))
    where, totals = pack(items, tasks)
    heavy: dict[tuple, list[int]] = {}
    buckets = []
    for (unit, _), task in zip(items, where):
        if isinstance(unit, tuple):
            heavy.setdefault(unit, []).append(task)
        else:
            buckets.append((unit, task))
    fields = {f.name: f for f in df.schema.fields}
    key_types = ", ".join(f"`{k}` {fields[k].dataType.simpleString()}" for k in keys)
    return Placement(
        tuple(keys),
        tasks,
        spark.createDataFrame([(*k, t) for k, t in heavy.items()], f"{key_types}, _mm_shards array<int>"),
        spark.createDataFrame(buckets, "_mm_bucket bigint, _mm_task int"),
        tuple(totals),
    )


def skew_free_aggregate(df: DataFrame, keys: list[str], spread: Column, partial: list[Column], final: list[Column], total_rows: int, matching: DataFrame | None = None, tasks: int | None = None, loads: DataFrame | None = None) -> DataFrame:
    """Aggregate ``df`` by ``keys``, optionally joined to ``matching``, with no task far larger than the others.

    ``partial`` aggregates the rows of one shard and ``final`` merges the shards of a key (as many rows as the
    key has shards). Rows with a null key are left out: a null is never a key. ``matching`` is joined from the
    left, so keys without a match stay. ``loads`` gives the rows of each key where the caller has them cheaper than
    by counting ``df``. Empty input gives an empty result.
    """
    rows = df.dropna(subset=keys)
    plan = place(rows, keys, total_rows, tasks, loads)
    routed = plan.fragment(rows, spread)
    if matching is not None:
        routed = routed.join(plan.replicate(matching.dropna(subset=keys)), [ROUTE, *keys], "left")
    return routed.groupBy(ROUTE, *keys).agg(*partial).groupBy(*keys).agg(*final)
