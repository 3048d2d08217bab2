"""The three detectors of tandem repeats and their union.

All give rows (seq_ord, chrom, start, end, motif, copies, length, tier, confidence) and the columns ``_a``, ``_b``, ``_c``
by which the order of emission is restored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from motifmill.functions.motifs import least_rotation, primitive_root
from motifmill.operators.intervals import periods
from motifmill.operators.kmers import chunks, fingerprints, kmer_fingerprints
from motifmill.operators.runs import period_runs
from motifmill.session import checkpointed, shuffle_width, small

_AREA_BITS = 16
_NEAR = 1024  # length of the pieces of text in which anchors are compared
REPEAT_COLUMNS = ["seq_ord", "chrom", "start", "end", "motif", "copies", "length", "tier", "confidence"]
#: Fixed values of the long-read detector: window and step, periods tried, score to pass, anchor length, shortest read.
WINDOW, STEP, PERIOD_FROM, PERIOD_TO, MIN_SCORE, ANCHOR, MIN_READ = 500, 100, 10, 165, 0.7, 50, 1000


def _repeat(start: Column, end: Column, motif: Column, copies: Column, tier: int, confidence: Column, order: tuple[Column, Column, Column]) -> list[Column]:
    return [
        start.cast("bigint").alias("start"),
        end.cast("bigint").alias("end"),
        motif.alias("motif"),
        copies.cast("double").alias("copies"),
        (end - start).cast("bigint").alias("length"),
        F.lit(tier).alias("tier"),
        confidence.cast("double").alias("confidence"),
        *(c.alias(n) for c, n in zip(order, ("_a", "_b", "_c"))),
    ]


def tier1(seqs: DataFrame, motifs: DataFrame, max_k: int = 6, min_copies: int = 2, maximal_only: bool = True) -> DataFrame:
    """Short repeats: chains of ``min_copies`` or more adjacent copies of a dictionary motif (``motif``, ``k``).

    A chain is dropped if the base before or after it would begin a further copy. In terms of runs of period k:
    the chain of the motif inside a run begins at the motif's first place in the run, and is kept only if that is
    the run's start and the run is a whole number of copies. With ``maximal_only`` false every chain is given.
    """
    runs = period_runs(seqs.select("seq_ord", "seq", "n"), 1, max_k)
    if maximal_only:
        # the run is a whole number of copies and begins with the motif: its first unit is the motif itself
        runs = runs.where((F.col("z") - F.col("a")) % F.col("p") == 0)
        known = runs.join(small(motifs.select(F.col("motif").alias("seed"), F.col("k").alias("p"))), ["seed", "p"]).withColumn("_least", F.col("seed")).withColumn("_start", F.col("a"))
    else:
        least = runs.withColumn("_least", least_rotation(F.col("seed"))).withColumn("_start", F.col("a") + F.instr(F.concat("seed", "seed"), F.col("_least")) - 1)
        known = least.join(small(motifs.select(F.col("motif").alias("_least"), F.col("k").alias("p"))), ["_least", "p"])
    chained = known.withColumn("_copies", F.floor((F.col("z") + F.col("p") - F.col("_start")) / F.col("p"))).where(F.col("_copies") >= min_copies)
    end = F.col("_start") + F.col("_copies") * F.col("p")
    calls = chained.select("seq_ord", *_repeat(F.col("_start"), end, F.col("_least"), F.col("_copies"), 1, F.lit(1.0), (F.col("p").cast("bigint"), F.col("_least"), F.col("_start"))))
    return _named(calls, seqs)


def _named(calls: DataFrame, seqs: DataFrame) -> DataFrame:
    return calls.join(seqs.select("seq_ord", "chrom"), "seq_ord").select(*REPEAT_COLUMNS, "_a", "_b", "_c")


def tier2_runs(seqs: DataFrame, min_period: int = 10, max_period: int = 1000, lift_cap: bool = False) -> DataFrame:
    """Runs that the medium detector folds: periods from ``min_period`` to ``max_period``, capped at 64 unless lifted."""
    cap = max_period if lift_cap else min(max_period, max(64, min_period))
    return period_runs(seqs.select("seq_ord", "seq", "n"), min_period, cap, forbidden="N$", cap_by_length=True)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs in order of (seq_ord, p, a) to repeats: a run counts from where the repeat before it ends, if two copies are left."""
    owner, cursor = None, 0
    for batch in batches:
        out: list[tuple] = []
        for seq, p, a, z, root in zip(*(batch.column(i).to_pylist() for i in range(5))):
            if (seq, p) != owner:
                owner, cursor = (seq, p), 0
            first, q = max(a, cursor), len(root)
            if z - first >= p:
                turn = (first - a) % q
                cursor = first + (z + p - first) // q * q
                out.append((seq, p, first - (first - a) // q * q, cursor, root[turn:] + root[:turn]))
        columns = zip(*out) if out else [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string()))], ["seq_ord", "p", "start", "end", "motif"])


def tier2(seqs: DataFrame, min_period: int = 10, max_period: int = 1000, lift_cap: bool = False) -> DataFrame:
    """Medium repeats: two or more exact adjacent copies, found by scanning each period from left to right.

    A scan goes on behind the end of each repeat. The runs of a sequence and period are read in order as a stream,
    of which only the scan's place is kept. The motif is reduced to its primitive root and extended by whole copies;
    equal results of several periods are one.
    """
    runs = tier2_runs(seqs, min_period, max_period, lift_cap).select("seq_ord", "p", "a", "z", primitive_root(F.col("seed")).alias("root"))
    ordered = runs.repartition("seq_ord", "p").sortWithinPartitions("seq_ord", "p", "a")
    hits = ordered.mapInArrow(_scan, "seq_ord bigint, p int, start bigint, end bigint, motif string")
    once = hits.groupBy("seq_ord", "start", "end", "motif").agg(F.min("p").alias("p"))
    length = F.col("end") - F.col("start")
    calls = once.select("seq_ord", *_repeat(F.col("start"), F.col("end"), F.col("motif"), F.floor(length / F.length("motif")), 2, F.lit(0.95), (F.col("p").cast("bigint"), F.lit(""), F.col("end"))))
    return _named(calls, seqs)


def read_windows(reads: DataFrame) -> DataFrame:
    """(read_idx, win_start, win, anchor): windows of long enough reads, and the bases before each window."""
    text = F.upper("read_seq")
    starts = F.sequence(F.lit(0), F.length("_read") - WINDOW - 1, F.lit(STEP))
    return (
        reads.select("read_idx", text.alias("_read"))
        .where(F.length("_read") >= MIN_READ)
        .repartition(shuffle_width(reads.sparkSession), "read_idx")  # few bytes, much work
        .select("read_idx", "_read", F.explode(starts).alias("win_start"))
        .select("read_idx", F.col("win_start").cast("bigint").alias("win_start"), F.substring("_read", F.col("win_start") + 1, F.lit(WINDOW)).alias("win"), F.when(F.col("win_start") >= ANCHOR, F.substring("_read", F.col("win_start") + 1 - ANCHOR, F.lit(ANCHOR))).otherwise(F.left("_read", F.col("win_start"))).alias("anchor"))
    )


@F.pandas_udf(T.StructType([T.StructField("period", T.IntegerType()), T.StructField("matches", T.IntegerType())]))
def best_period(windows: pd.Series) -> pd.DataFrame:
    """Smallest period with the greatest number of positions equal to the window's own first unit."""
    codes = np.frombuffer("".join(windows).encode("latin-1", "replace"), dtype=np.uint8).reshape(len(windows), -1)
    width = codes.shape[1]
    best, of = np.zeros(len(codes), dtype=np.int32), np.zeros(len(codes), dtype=np.int32)
    for p in range(PERIOD_FROM, PERIOD_TO + 1):
        matches = (codes == codes[:, np.arange(width) % p]).sum(axis=1).astype(np.int32)
        better = matches > best
        best[better], of[better] = matches[better], p
    return pd.DataFrame({"period": of, "matches": best})


def window_periodicity(reads: DataFrame) -> DataFrame:
    """(read_idx, win_start, motif, copies, confidence, anchor) of the windows that repeat themselves well enough."""
    scored = read_windows(reads).withColumn("_best", best_period("win"))
    score = F.col("_best.matches") / F.lit(float(WINDOW))
    return scored.where(score > MIN_SCORE).select("read_idx", "win_start", F.left("win", F.col("_best.period")).alias("motif"), (F.lit(WINDOW) / F.col("_best.period")).cast("int").alias("copies"), score.alias("confidence"), "anchor")


@F.pandas_udf(T.StructType([T.StructField("h1", T.LongType()), T.StructField("h2", T.LongType())]))
def _anchor_fingerprint(anchors: pd.Series) -> pd.DataFrame:
    both = [fingerprints(a.encode("latin-1", "replace"), ANCHOR) for a in anchors]
    return pd.DataFrame({"h1": [int(a[0]) for a, _ in both], "h2": [int(b[0]) for _, b in both]}, dtype="int64")


def anchor_map(seqs: DataFrame, windows: DataFrame) -> DataFrame:
    """(anchor, seq_ord, hit): anchors that occur exactly once in a sequence, and where.

    Anchors and reference k-mers are joined on 128-bit fingerprints, and the text of those that meet is compared. The
    first window of a read has no full anchor.
    """
    anchors = windows.where(F.length("anchor") == ANCHOR).select("anchor").distinct()
    wanted = anchors.select("anchor", _anchor_fingerprint("anchor").alias("_f")).select("anchor", "_f.h1", "_f.h2")
    bases = seqs.select("seq_ord", "seq", "n")
    met = kmer_fingerprints(bases, ANCHOR).join(wanted, ["h1", "h2"]).withColumn("base", F.floor(F.col("pos") / _NEAR) * _NEAR)
    text = chunks(bases, ANCHOR - 1, _NEAR).select("seq_ord", "base", "chunk")
    same = met.join(text, ["seq_ord", "base"]).where(F.substring("chunk", (F.col("pos") - F.col("base") + 1).cast("int"), F.lit(ANCHOR)) == F.col("anchor"))
    return same.groupBy("anchor", "seq_ord").agg(F.count(F.lit(1)).alias("_n"), F.min("pos").alias("hit")).where("_n = 1").drop("_n")


def scored_windows(reads: DataFrame) -> DataFrame:
    """Windows that repeat themselves and have a full anchor, scored once and written down: what ``tier3_calls`` places."""
    return checkpointed(window_periodicity(reads).where(F.length("anchor") == ANCHOR))


def tier3_calls(seqs: DataFrame, reads: DataFrame, windows: DataFrame | None = None) -> DataFrame:
    """Calls of single windows, placed on every sequence where the window's anchor is unique."""
    windows = scored_windows(reads) if windows is None else windows
    placed = windows.join(anchor_map(seqs, windows), "anchor")
    start = F.col("hit") + ANCHOR
    return placed.select("seq_ord", "read_idx", "win_start", *_repeat(start, start + F.length("motif") * F.col("copies"), F.col("motif"), F.col("copies"), 3, F.col("confidence"), (start, F.lit(""), start + F.length("motif") * F.col("copies"))))


def consolidate(calls: DataFrame) -> DataFrame:
    """Merges, in order of start and end, each call with the one before if it has the same motif and begins not after its end.

    The copies of merged calls are halved pairwise, as a running average of two would: the first of m calls weighs
    2^-(m-1), the i-th 2^-(m-i+1). The confidence is the least. Ties in order go by read and window.

    Calls of different covered periods of a sequence never merge, so each period is merged by itself.
    """
    block = lambda c: F.expr(f"shiftright({c}, {_AREA_BITS})")
    covered = periods(calls, "seq_ord", "start", "end").select(F.col("seq_ord").cast("bigint").alias("seq_ord"), F.col("period_start").alias("_area"), "period_end", F.explode(F.sequence(block("period_start"), block("period_end - 1"))).alias("_block"))
    calls = calls.withColumn("_block", block("start")).join(covered, ["seq_ord", "_block"]).where((F.col("start") >= F.col("_area")) & (F.col("start") < F.col("period_end")))
    by_place = Window.partitionBy("seq_ord", "_area").orderBy("start", "end", "read_idx", "win_start")
    stretch = Window.partitionBy("seq_ord", "_area", "_stretch").orderBy("start", "end", "read_idx", "win_start")
    reach = F.max("end").over(stretch.rowsBetween(Window.unboundedPreceding, -1))
    island = Window.partitionBy("seq_ord", "_area", "_stretch", "_island")
    nth = F.row_number().over(island.orderBy("start", "end", "read_idx", "win_start"))
    total = F.count(F.lit(1)).over(island)
    weight = F.when(F.col("_nth") == 1, F.pow(F.lit(2.0), 1 - F.col("_m"))).otherwise(F.pow(F.lit(2.0), F.col("_nth") - F.col("_m") - 1))
    return (
        calls.withColumn("_stretch", F.when(F.lag("motif").over(by_place) == F.col("motif"), 0).otherwise(1))
        .withColumn("_stretch", F.sum("_stretch").over(by_place.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("_island", F.when(F.col("start") <= reach, 0).otherwise(1))
        .withColumn("_island", F.sum("_island").over(stretch.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("_nth", nth)
        .withColumn("_m", total)
        .groupBy("seq_ord", "_area", "_stretch", "_island", "motif")
        .agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum(weight * F.col("copies")).alias("copies"), F.min("confidence").alias("confidence"))
        .select("seq_ord", *_repeat(F.col("start"), F.col("end"), F.col("motif"), F.col("copies"), 3, F.col("confidence"), (F.col("start"), F.lit(""), F.col("end"))))
    )


def tier3(seqs: DataFrame, reads: DataFrame) -> DataFrame:
    """Very long repeats by long-read evidence: scored windows, placed by unique anchors, merged."""
    return _named(consolidate(tier3_calls(seqs, reads)), seqs)


def all_repeats(seqs: DataFrame, motifs: DataFrame, reads: DataFrame | None = None, use_tier1: bool = True, use_tier2: bool = True, use_tier3: bool = False, max_k: int = 6, min_period: int = 10, max_period: int = 1000, lift_cap: bool = False) -> DataFrame:
    """Union of the chosen tiers, nothing removed between them. Tier 3 needs ``reads``; without any tier the result is empty.

    Periods of tier 2 end at 64 unless ``lift_cap`` lets them go on to ``max_period``.
    """
    parts = []
    if use_tier1:
        parts.append(tier1(seqs, motifs, max_k))
    if use_tier2:
        parts.append(tier2(seqs, min_period, max_period, lift_cap))
    if use_tier3 and reads is not None:
        parts.append(tier3(seqs, reads))
    if not parts:
        return tier1(seqs.where("false"), motifs, max_k)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


#: Order in which repeats are written: by sequence, tier, then as each detector goes through the sequence.
EMISSION = ["seq_ord", "tier", "_a", "_b", "_c"]
