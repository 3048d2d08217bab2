"""Best representative of each group of duplicates, field by field.

Duplicates are rows of equal keys whose intervals share a position, directly or through further such rows.
Each surviving field is the maximum of a composite struct (priorities, timestamp, smaller id, value) over the
group's rows with a usable value. Maxima of structs can be taken in steps: rows of equal keys and interval are
combined on the map side, so repeated deliveries of one row cost nothing later.

A key's axis is cut into blocks of ``2^block_bits`` positions which are swept apart from each other, so a hot
key is spread. An interval that reaches into later blocks leaves a carry row there, and only the groups that
lie across a block's end (at most two for each key and block) are chained over the blocks. Those lie in blocks
that an interval enters or leaves, so only these few blocks are swept for the chains.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from motifmill.session import checkpointed, small

BLOCK_BITS = 16


@dataclass(frozen=True)
class Field:
    """A field to survive: rows where ``usable`` holds compete, greater ``priority`` first.

    ``value`` is carried along with the priorities; ``read`` makes the field of the winning (priorities ``p0``,
    ``p1``, ..., ``value``) and the group's keys, so that what they tell already need not be carried.
    """

    name: str
    value: Column | None
    usable: Column
    priority: tuple[Column, ...] = ()
    read: Callable[[Column], Column] = lambda best: best["value"]

    def candidate(self, timestamp: str, row_id: str) -> Column:
        value = [] if self.value is None else [self.value.alias("value")]
        return F.when(self.usable, F.struct(*(p.alias(f"p{i}") for i, p in enumerate(self.priority)), F.col(timestamp).alias("at"), (-F.col(row_id)).alias("neg_id"), *value))


def survivors(df: DataFrame, keys: list[str], start: str, end: str, row_id: str, timestamp: str, fields: list[Field], block_bits: int = BLOCK_BITS) -> DataFrame:
    """One row for each duplicate group: keys, ``group_start``, ``group_end``, ``n_rows``, ``first_id`` and, for
    each field, ``<name>`` and ``<name>_from`` (the id of the row that gave it; null where no row is usable).

    Ties go to the later ``timestamp`` (null is earliest), then to the smaller id. Rows with a null key, start
    or end, or an end not after the start, belong to no group. Touching intervals are not duplicates. Rows that
    come several times count each time in ``n_rows``. An empty table gives an empty result.
    """
    best = {f.name: f.candidate(timestamp, row_id) for f in fields}
    valid = df.where(F.col(end) > F.col(start))
    rows = valid.dropna(subset=keys).select(*keys, F.col(start).alias("_s"), F.col(end).alias("_e"), F.col(row_id).alias("_id"), *(c.alias(f"_best_{n}") for n, c in best.items()))
    merge = [F.max(f"_best_{n}").alias(f"_best_{n}") for n in best]
    block = F.expr(f"shiftright(_s, {block_bits})")
    last_block = F.expr(f"shiftright(_e - 1, {block_bits})")
    spans = rows.groupBy(*keys, "_s", "_e").agg(F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_first"), *merge).withColumn("_block", block)
    carries = checkpointed(
        valid.where(F.expr(f"shiftright({end} - 1, {block_bits}) > shiftright({start}, {block_bits})"))  # few rows: before anything is made of the keys
        .dropna(subset=keys)
        .select(*keys, F.col(start).alias("_s"), F.col(end).alias("_e"))
        .select(*keys, "_e", F.explode(F.sequence(block + 1, last_block)).alias("_block"))
        .groupBy(*keys, "_block")
        .agg(F.max("_e").alias("_e"))
        .select("*", F.shiftleft("_block", block_bits).alias("_s"), F.lit(1).alias("_carry"))
    )
    swept = Window.partitionBy(*keys, "_block").orderBy("_s", F.desc("_carry"))
    reach = F.max("_e").over(swept.rowsBetween(Window.unboundedPreceding, -1))

    def grouped(rows: DataFrame) -> DataFrame:
        return (
            rows.withColumn("_new", F.when(F.col("_s") < reach, 0).otherwise(1))
            .withColumn("_group", F.sum("_new").over(swept.rowsBetween(Window.unboundedPreceding, 0)))
            .groupBy(*keys, "_block", "_group")
            .agg(F.min("_s").alias("_s"), F.max("_e").alias("_e"), F.coalesce(F.sum("_n"), F.lit(0)).alias("_n"), F.min("_first").alias("_first"), F.max("_carry").alias("_head"), *merge)
            .withColumn("_tail", F.coalesce(F.col("_e") > F.shiftleft(F.col("_block") + 1, block_bits), F.lit(False)))
        )

    marked = spans.withColumn("_carry", F.lit(0)).unionByName(carries, allowMissingColumns=True).repartition(*keys, "_block")
    entered = small(carries.select(*(F.col(k).alias(f"_in_{k}") for k in keys), F.explode(F.array(F.col("_block") - 1, F.col("_block"))).alias("_in__block")).distinct())
    # null-safe, as is ``_tail``: the optimizer would put null checks below the exchange, which both uses then could not share
    crossed = marked.join(entered, reduce(and_, (F.col(k).eqNullSafe(F.col(f"_in_{k}")) for k in (*keys, "_block")))).select(*marked.columns)
    along = Window.partitionBy(*keys).orderBy("_block", "_group")
    across = (
        grouped(crossed)
        .where("_head = 1 or _tail")
        .withColumn("_chain", F.sum(1 - F.col("_head")).over(along))
        .groupBy(*keys, "_chain")
        .agg(F.min("_s").alias("_s"), F.max("_e").alias("_e"), F.sum("_n").alias("_n"), F.min("_first").alias("_first"), *merge)
    )
    groups = grouped(marked)
    wanted = [*keys, "_s", "_e", "_n", "_first", *(f"_best_{n}" for n in best)]
    whole = groups.where("_head = 0 and not _tail").select(*wanted).unionByName(across.select(*wanted))
    return whole.select(
        *keys,
        F.col("_s").alias("group_start"),
        F.col("_e").alias("group_end"),
        F.col("_n").alias("n_rows"),
        F.col("_first").alias("first_id"),
        *(F.when(F.col(f"_best_{f.name}").isNotNull(), f.read(F.col(f"_best_{f.name}"))).alias(f.name) for f in fields),
        *((-F.col(f"_best_{n}.neg_id")).alias(f"{n}_from") for n in best),
    )
