"""Frequency of every distinct term: an external sort by range of (term, record) pairs, scanned in runs.

Pairs are combined within each input partition first, so a hot pair reaches the sort once per partition. The
range partitioning is by term and record together: a term with a third of all pairs is cut over many
partitions, and since equal pairs always meet in one partition, the runs of a term's parts add up exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motifmill.operators.arrowstream import changes, whole_groups
from motifmill.session import checkpointed, shuffle_width

_FLUSH = 200_000


def _combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of one partition with their counts."""

    def merged(held: list[pa.Table]) -> pa.Table:
        counted = pa.concat_tables(held).group_by(["term", "record"]).aggregate([("n", "sum")])
        return counted.rename_columns(["term", "record", "n"]).select(["term", "record", "n"])

    held, rows = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(pa.Table.from_batches([batch]).append_column("n", pa.array(np.ones(batch.num_rows, dtype=np.int64))))
            rows += batch.num_rows
        if rows >= _FLUSH:
            held = [merged(held)]
            rows = held[0].num_rows
            if rows > _FLUSH // 2:  # mostly different pairs: they go on as they are, the scan adds up what comes again
                yield from held[0].combine_chunks().to_batches(max_chunksize=50_000)
                held, rows = [], 0
    if held:
        yield from merged(held).combine_chunks().to_batches(max_chunksize=50_000)


def _scan_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted pairs to (term, occurrences, records): a run of equal pairs is one record."""
    for table in whole_groups(batches, ["term", "record"]):
        runs = changes(table, ["term", "record"])
        starts = np.flatnonzero(changes(table, ["term"]))
        occurrences = np.add.reduceat(table.column("n").to_numpy(), starts)
        records = np.add.reduceat(runs.astype(np.int64), starts)
        yield pa.RecordBatch.from_arrays([table.column("term").take(pa.array(starts)).combine_chunks(), pa.array(occurrences), pa.array(records)], ["term", "occurrences", "records"])


def term_frequencies(df: DataFrame, term: Column, record: Column, partitions: int | None = None) -> DataFrame:
    """(term, occurrences, records) of every distinct term: rows it is in, and distinct records it is in.

    Rows with a null term or record do not count; the empty string is a term like any other. Repeated rows
    count as often as they come. An empty table gives an empty result.
    """
    pairs = df.select(term.cast("string").alias("term"), record.cast("string").alias("record")).where("term is not null and record is not null")
    counted = checkpointed(pairs.mapInArrow(_combine, "term string, record string, n bigint"))  # the range partitioning reads it twice
    ordered = counted.repartitionByRange(partitions or shuffle_width(df.sparkSession), "term", "record").sortWithinPartitions("term", "record")
    parts = ordered.mapInArrow(_scan_runs, "term string, occurrences bigint, records bigint")
    return parts.groupBy("term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))


def mark_by_spread(frequencies: DataFrame, total_records: int, rare_at_most: int, common_share: float) -> DataFrame:
    """Adds ``mark``: 'rare' in at most ``rare_at_most`` records, else 'common' in at least ``common_share`` of all, else null."""
    return frequencies.withColumn("mark", F.when(F.col("records") <= rare_at_most, F.lit("rare")).when(F.col("records") >= F.lit(common_share * total_records), F.lit("common")))
