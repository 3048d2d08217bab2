"""Overlapping and gapped intervals: coverage by canonical dyadic blocks.

An interval is cut into dyadic blocks ``[i * 2^k, (i + 1) * 2^k)``. Two blocks are either nested or disjoint,
so a union is made by dropping blocks that an ancestor covers and merging sibling pairs upward; adjacent blocks
are then joined into periods. An entity's axis is cut into regions of ``2^region_bits`` positions, which are
blocks themselves: work is spread over (entity, region), so an entity that holds a third of all rows is spread
like any other, and what one task must hold is bounded by the region's size. Each task first thins out the
blocks of its own rows, so repeated rows never reach the shuffle. Only the ends of the regions are compared
across regions: at most one row for each (entity, region).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from motifmill.operators.arrowstream import changes, whole_groups
from motifmill.session import checkpointed

REGION_BITS = 20
_LEVEL_BITS = 5
_FLUSH = 200_000


def decompose(starts: np.ndarray, ends: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Canonical dyadic blocks of half-open intervals in ``[0, 2^bits)``: interval number, level, first position."""
    owner, level, first = [], [], []
    rows = np.arange(len(starts))
    left, right = starts.astype(np.int64), ends.astype(np.int64)
    for k in range(bits + 1):
        live = left < right
        if not live.any():
            break
        rows, left, right = rows[live], left[live], right[live]
        whole = np.full(len(rows), k == bits)
        low = ((left & 1) == 1) | whole
        high = ((right & 1) == 1) & ~whole
        for take, block in ((low, left[low]), (high, right[high] - 1)):
            owner.append(rows[take])
            level.append(np.full(len(block), k, dtype=np.int64))
            first.append(block << k)
        left, right = (left + 1) >> 1, right >> 1
        if k == bits:
            break
    empty = np.zeros(0, dtype=np.int64)
    return tuple(np.concatenate(x) if x else empty for x in (owner, level, first))


def uncovered(first: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Blocks without those that an ancestor or an equal block covers, in order."""
    order = np.lexsort((-level, first))
    first, level = first[order], level[order]
    reach = np.maximum.accumulate(first + (np.int64(1) << level)) if len(first) else first
    keep = np.ones(len(first), dtype=bool)
    keep[1:] = first[1:] >= reach[:-1]
    return first[keep], level[keep]


def merge_siblings(first: np.ndarray, level: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Disjoint blocks with every complete sibling pair below level ``bits`` replaced by its parent, bottom up."""
    firsts, levels = [], []
    promoted = np.zeros(0, dtype=np.int64)
    for k in range(bits + 1):
        here = np.concatenate([first[level == k], promoted])
        here.sort()
        paired = np.zeros(len(here), dtype=bool)
        promoted = np.zeros(0, dtype=np.int64)
        if k < bits and len(here) > 1:
            size = np.int64(1) << k
            leads = np.zeros(len(here), dtype=bool)
            leads[:-1] = (((here[:-1] >> k) & 1) == 0) & (here[1:] == here[:-1] + size)
            paired = leads.copy()
            paired[1:] |= leads[:-1]
            promoted = here[leads]
        rest = here[~paired]
        firsts.append(rest)
        levels.append(np.full(len(rest), k, dtype=np.int64))
    first, level = np.concatenate(firsts), np.concatenate(levels)
    order = np.argsort(first, kind="stable")
    return first[order], level[order]


def coalesce_blocks(first: np.ndarray, level: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Periods [start, end) of disjoint, ordered blocks; blocks of different regions of ``2^bits`` are never joined."""
    if not len(first):
        return first, first
    last = first + (np.int64(1) << level)
    new = np.ones(len(first), dtype=bool)
    new[1:] = (first[1:] != last[:-1]) | ((first[1:] >> bits) != (first[:-1] >> bits))
    begins = np.flatnonzero(new)
    return first[begins], last[np.append(begins[1:], len(first)) - 1]


def _ordinals(table: pa.Table, keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
    new = changes(table, keys)
    return np.cumsum(new) - 1, np.flatnonzero(new)


def _to_blocks(bits: int):
    """Per task: intervals to blocks, thinned and merged, one row for each (entity, region) and flush."""

    def flush(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held).sort_by([("entity", "ascending"), ("region", "ascending")])
        group, begins = _ordinals(table, ["entity", "region"])
        owner, level, first = decompose(table.column("s").to_numpy(), table.column("e").to_numpy(), bits)
        first, level = merge_siblings(*uncovered(first + (group[owner] << bits), level), bits)
        codes = ((first & ((1 << bits) - 1)) << _LEVEL_BITS | level).astype(np.int32)
        offsets = np.searchsorted(first >> bits, np.arange(len(begins) + 1)).astype(np.int32)
        heads = table.take(pa.array(begins)).select(["entity", "region"]).combine_chunks()
        yield pa.RecordBatch.from_arrays([*(heads.column(k).combine_chunks() for k in ("entity", "region")), pa.ListArray.from_arrays(pa.array(offsets), pa.array(codes))], ["entity", "region", "blocks"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                rows += batch.num_rows
            if rows >= _FLUSH:
                yield from flush(held)
                held, rows = [], 0
        if held:
            yield from flush(held)

    return run


def _to_periods(bits: int):
    """Per task: blocks of whole (entity, region) groups to periods, gaps between them, and each region's extent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ["entity", "region"], at_least=2_000):
            group, begins = _ordinals(table, ["entity", "region"])
            blocks = table.column("blocks").combine_chunks()
            codes = blocks.flatten().to_numpy().astype(np.int64)
            of = np.repeat(group, np.diff(blocks.offsets.to_numpy()))
            first, level = merge_siblings(*uncovered((codes >> _LEVEL_BITS) + (of << bits), codes & ((1 << _LEVEL_BITS) - 1)), bits)
            start, end = coalesce_blocks(first, level, bits)
            run_group = start >> bits
            regions = table.column("region").to_numpy()[begins]
            shift = (regions[run_group] - run_group) << bits
            start, end = start + shift, end + shift
            inner = np.flatnonzero(run_group[1:] == run_group[:-1])
            heads = np.flatnonzero(np.append(True, run_group[1:] != run_group[:-1]))
            tails = np.append(heads[1:], len(start)) - 1
            edge = ((start & ((1 << bits) - 1)) == 0) | ((end & ((1 << bits) - 1)) == 0)
            names = table.column("entity").take(pa.array(begins))
            for kind, owner, s, e in (
                ("gap", run_group[inner], end[inner], start[inner + 1]),
                ("extent", run_group[heads], start[heads], end[tails]),
                ("edge", run_group[edge], start[edge], end[edge]),
                ("period", run_group[~edge], start[~edge], end[~edge]),
            ):
                yield pa.RecordBatch.from_arrays([names.take(pa.array(owner)).combine_chunks(), pa.array(np.full(len(s), kind)), pa.array(s, pa.int64()), pa.array(e, pa.int64())], ["entity", "kind", "s", "e"])

    return run


def coverage_parts(df: DataFrame, entity: str, start: str, end: str, region_bits: int = REGION_BITS) -> DataFrame:
    """Rows (entity, kind, s, e), the entity as text, from which periods and gaps are read off.

    Invalid intervals are left out: a null entity, start or end, or an end not after the start. ``kind`` is
    ``period`` (inside one region), ``edge`` (a period that touches a region's end, perhaps continued in the
    next), ``gap`` (inside one region) or ``extent`` (first covered to last covered position of a region).
    """
    size = 1 << region_bits
    spans = (
        df.select(F.col(entity).cast("string").alias("entity"), F.col(start).cast("bigint").alias("_a"), F.col(end).cast("bigint").alias("_b"))
        .where(F.col("entity").isNotNull() & (F.col("_b") > F.col("_a")))
        .withColumn("region", F.explode(F.sequence(F.expr(f"shiftright(_a, {region_bits})"), F.expr(f"shiftright(_b - 1, {region_bits})"))))
        .select("entity", "region", F.greatest(F.col("_a") - F.col("region") * size, F.lit(0)).alias("s"), F.least(F.col("_b") - F.col("region") * size, F.lit(size)).alias("e"))
    )
    blocks = spans.mapInArrow(_to_blocks(region_bits), "entity string, region bigint, blocks array<int>")
    return blocks.repartition("entity", "region").sortWithinPartitions("entity", "region").mapInArrow(_to_periods(region_bits), "entity string, kind string, s bigint, e bigint")


def gaps(df: DataFrame, entity: str, start: str, end: str, min_gap: int = 1, max_gap: int | None = None, region_bits: int = REGION_BITS) -> DataFrame:
    """Maximal uncovered stretches (entity, gap_start, gap_end) between the intervals of an entity.

    Nothing comes out before the first or after the last interval, for entities with one period, and for an
    empty table. Touching intervals leave no gap. ``min_gap`` and ``max_gap`` bound the length of a gap.
    """
    parts = checkpointed(coverage_parts(df, entity, start, end, region_bits).where("kind in ('gap', 'extent')"))
    before = Window.partitionBy("entity").orderBy("s")
    between = parts.where("kind = 'extent'").select(F.col("entity").alias(entity), F.lag("e").over(before).alias("gap_start"), F.col("s").alias("gap_end"))
    inner = parts.where("kind = 'gap'").select(F.col("entity").alias(entity), F.col("s").alias("gap_start"), F.col("e").alias("gap_end"))
    length = F.col("gap_end") - F.col("gap_start")
    found = inner.unionByName(between).where(length >= max(1, min_gap))
    return found if max_gap is None else found.where(length <= max_gap)


def periods(df: DataFrame, entity: str, start: str, end: str, region_bits: int = REGION_BITS) -> DataFrame:
    """Maximal covered periods (entity, period_start, period_end): overlapping, nested and touching intervals merge."""
    parts = checkpointed(coverage_parts(df, entity, start, end, region_bits).where("kind in ('period', 'edge')"))
    inner = parts.where("kind = 'period'").select(F.col("entity").alias(entity), F.col("s").alias("period_start"), F.col("e").alias("period_end"))
    ordered = Window.partitionBy("entity").orderBy("s")
    chained = (
        parts.where("kind = 'edge'")
        .withColumn("_new", F.when(F.lag("e").over(ordered) == F.col("s"), 0).otherwise(1))
        .withColumn("_chain", F.sum("_new").over(ordered))
        .groupBy(F.col("entity").alias(entity), "_chain")
        .agg(F.min("s").alias("period_start"), F.max("e").alias("period_end"))
        .drop("_chain")
    )
    return inner.unionByName(chained)
