"""Top N items within every group, by lower bounds from the partitions.

A partition's own N-th best score of a group bounds the group's N-th best score from below. Each partition
keeps its N best rows of each group and reports that bound; the greatest bound of a group is joined back, rows
below it are filtered away, and the survivors are ranked. The table is read once: what the partitions keep is
written down, and bounds and survivors are both made of it.

For the groups that most partitions fill, at most ``HOT_GROUPS`` of them, the bounds are broadcast, so their rows
are filtered before any of them moves, and the survivors are ranked in shards first. All other groups meet their
bound where they are ranked.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from motifmill.operators.arrowstream import changes
from motifmill.session import checkpointed

#: Groups whose bounds are broadcast; bounds what the broadcast holds, not what the result holds.
HOT_GROUPS = 10_000
_SHARDS = 32
_FLUSH = 100_000


def _local_best(group: str, score: str, ties: list[str], n: int):
    order = [(group, "ascending"), (score, "descending"), *((t, "ascending") for t in ties)]

    def thin(table: pa.Table) -> tuple[pa.Table, np.ndarray]:
        table = table.sort_by(order)
        at = np.arange(table.num_rows)
        starts = np.flatnonzero(changes(table, [group]))
        rank = at - np.repeat(starts, np.diff(np.append(starts, table.num_rows)))
        keep = rank < n
        return table.filter(pa.array(keep)), rank[keep]

    def bounded(table: pa.Table, rank: np.ndarray) -> Iterator[pa.RecordBatch]:
        scores = table.column(score).combine_chunks()
        bound = pc.if_else(pa.array(rank == n - 1), scores, pa.scalar(None, scores.type))
        yield from table.append_column("_bound", bound).combine_chunks().to_batches(max_chunksize=50_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                rows += batch.num_rows
            if rows >= _FLUSH:
                table, rank = thin(pa.Table.from_batches(held))
                held, rows = table.to_batches(), table.num_rows
                if rows > _FLUSH // 2:  # many groups: these rows go out with a bound of their own, so that memory stays bounded
                    yield from bounded(table, rank)
                    held, rows = [], 0
        if held:
            yield from bounded(*thin(pa.Table.from_batches(held)))

    return run


def top_n_per_group(df: DataFrame, group: str, score: str, ties: list[str], n: int, keep: list[str] | None = None, hot_groups: int = HOT_GROUPS) -> DataFrame:
    """The ``n`` rows of greatest ``score`` of each ``group``, ties by smaller ``ties`` in turn, with ``rank_no`` from 1.

    Rows with a null group, or a null or NaN score, have no place. Null ties come last. Rows equal in group,
    score and all ties may come in any order, but each has its own rank. A group of fewer than ``n`` rows comes
    out whole. ``keep`` names further columns to carry (default: none).
    """
    columns = list(dict.fromkeys([group, score, *ties, *(keep or [])]))
    rows = df.select(*columns).where(F.col(group).isNotNull() & F.col(score).isNotNull())
    if isinstance(df.schema[score].dataType, (T.DoubleType, T.FloatType)):
        rows = rows.where(~F.isnan(score))
    schema = T.StructType([*(T.StructField(f.name, f.dataType, True) for f in rows.schema.fields), T.StructField("_bound", rows.schema[score].dataType, True)])
    local = checkpointed(rows.mapInArrow(_local_best(group, score, ties, n), schema))
    bounds = local.where(F.col("_bound").isNotNull()).groupBy(group).agg(F.max("_bound").alias("_least"), F.count(F.lit(1)).alias("_lists"))
    hot = bounds.where("_lists > 1").orderBy(F.desc("_lists"), group).limit(hot_groups).select(group, "_least")
    order = [F.desc(score), *(F.asc_nulls_last(t) for t in ties)]

    def ranked(table: DataFrame, *within: str) -> DataFrame:
        return table.withColumn("rank_no", F.row_number().over(Window.partitionBy(group, *within).orderBy(*order))).where(F.col("rank_no") <= n)

    kept = local.drop("_bound")
    above = kept.join(F.broadcast(hot), group).where(F.col(score) >= F.col("_least")).drop("_least").withColumn("_shard", F.pmod(F.spark_partition_id(), F.lit(_SHARDS)))
    of_hot = ranked(ranked(above, "_shard").drop("_shard", "rank_no"))
    rest = kept.join(F.broadcast(hot.select(group)), group, "left_anti").join(bounds.select(group, "_least"), group, "left")
    of_rest = ranked(rest.where(F.col("_least").isNull() | (F.col(score) >= F.col("_least"))).drop("_least"))
    return of_hot.unionByName(of_rest)
