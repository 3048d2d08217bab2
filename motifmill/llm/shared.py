"""Long exact spans shared between records: seed, extend, keep the maximal ones.

Exact copies are classes: one representative of each is compared, the rest is membership. Seeds are k-mers
chosen by winnowing so that every clean stretch of ``span`` bases holds one. They first travel as a hash, a record and a
place, and only those found in two records go on: they are looked up in the texts again and given the
``span - k`` bases to either side, two bits each, which is all that is needed to tell whether the match around a
seed reaches ``span``. Such a match shares at least half of these bases on one side, so seeds are joined on the seed and
the half beside it: a seed in many records is split by what stands beside it, and records that share no more than the seed are
not compared. Matches of seeds on one diagonal overlap wherever the records go on matching, so their union is the
maximal span.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from motifmill.llm.spans import anchors, concatenated, window_fingerprints
from motifmill.operators.intervals import periods
from motifmill.session import BROADCAST_ROWS, checkpointed, small


def _pack(codes: np.ndarray) -> np.ndarray:
    """Rows of 2-bit codes to bytes; the width must be a multiple of four."""
    parts = codes.reshape(len(codes), -1, 4)
    return (parts[:, :, 0] | parts[:, :, 1] << 2 | parts[:, :, 2] << 4 | parts[:, :, 3] << 6).astype(np.uint8)


def _unpack(packed: np.ndarray) -> np.ndarray:
    return np.stack([packed >> s & 3 for s in (0, 2, 4, 6)], axis=2).reshape(len(packed), -1)


def _binary(rows: np.ndarray) -> pa.Array:
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(rows.shape[1]), len(rows), [None, pa.py_buffer(np.ascontiguousarray(rows).tobytes())]).cast(pa.binary())


def _bytes(column: pa.Array) -> list[bytes]:
    return column.cast(pa.binary()).to_pylist()


def _half(span: int, k: int) -> int:
    """Bases beside a seed of which a match of ``span`` shares this many on one side (no more than fit 62 bits)."""
    return min(-(-(span - k) // 2), 31)


def _light(span: int, k: int):
    """Texts to seeds (anchor, record, pos)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                codes, starts = concatenated(_bytes(batch.column(1)))
                pos, hashes = anchors(codes, span, k)
                of = np.searchsorted(starts, pos, side="right") - 1
                yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), batch.column(0).take(pa.array(of)), pa.array(pos - starts[of])], ["anchor", "record", "pos"])

    return run


def _surrounded(span: int, k: int):
    """Texts with places of seeds to (anchor, record, pos, left, right, around, beside_left, beside_right).

    ``left`` and ``right`` count clean bases beside the seed; the half beside it is -1 where it is not clean.
    """
    reach = span - k
    before = reach + 1
    width = -(-(before + k + reach) // 4) * 4
    half = _half(span, k)
    place = np.int64(4) ** np.arange(half, dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            codes, starts = concatenated(_bytes(batch.column(1)))
            padded = np.concatenate([np.full(before, 4, dtype=np.uint8), codes, np.full(width, 4, dtype=np.uint8)])
            seeds = batch.column(2).flatten()
            of = np.repeat(np.arange(batch.num_rows), pc.list_value_length(batch.column(2)).to_numpy())
            where, anchor = (seeds.field(c).to_numpy() for c in ("pos", "anchor"))
            for at in range(0, len(where), 20_000):
                part = slice(at, at + 20_000)
                around = padded[(where[part] + starts[of[part]])[:, None] + np.arange(width)]
                dirty = around == 4
                left = np.where(dirty[:, :before].any(axis=1), np.argmax(dirty[:, before - 1 :: -1][:, :before], axis=1), before)
                tail = dirty[:, before + k : before + k + reach]
                right = np.where(tail.any(axis=1), np.argmax(tail, axis=1), reach)
                around[dirty] = 0
                beside = [np.where(clean >= half, (around[:, i : i + half] * place).sum(axis=1), -1) for clean, i in ((left, before - half), (right, before + k))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor[part]), batch.column(0).take(pa.array(of[part])), pa.array(where[part]), pa.array(left.astype(np.int32)), pa.array(right.astype(np.int32)), _binary(_pack(around)), *map(pa.array, beside)],
                    ["anchor", "record", "pos", "left", "right", "around", "beside_left", "beside_right"],
                )

    return run


_SEED = "anchor bigint, record bigint, pos bigint, left int, right int, around binary, beside_left bigint, beside_right bigint"


def _runs(span: int):
    """Adds (step, copies): seeds of one record with equal anchor and
    surroundings that follow each other in a batch at one step below ``span`` are one row, ``step`` 0 for one alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            anchor, record, pos, left, right = (batch.column(c).to_numpy() for c in ("anchor", "record", "pos", "left", "right"))
            around = np.frombuffer(b"".join(batch.column("around").to_pylist()), dtype=np.uint8).reshape(len(pos), -1)
            order = np.lexsort((pos, anchor, record))
            same = (around[order[1:]] == around[order[:-1]]).all(axis=1)
            for x in (anchor, record, left, right):
                same &= x[order[1:]] == x[order[:-1]]
            gap = np.diff(pos[order])
            linked = same & (gap < span)
            goes_on = linked.copy()
            goes_on[1:] &= ~linked[:-1] | (gap[1:] == gap[:-1])
            begins = np.flatnonzero(np.concatenate([[True], ~goes_on]))
            copies = np.diff(np.append(begins, len(order)))
            step = np.where(copies > 1, np.append(gap, 0)[begins], 0)
            kept = batch.take(pa.array(order[begins]))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(step), pa.array(copies)], [*batch.schema.names, "step", "copies"])

    return run


def _extend(span: int, k: int):
    """Per pair of seed runs: the matches around their seeds that reach ``span`` bases; ``first`` if it begins within reach.

    Runs of one step give a match for each diagonal, which unites those of its seeds: they overlap, as the step is
    below ``span``. Runs of two steps give a match for each pair of seeds.
    """
    reach = span - k
    before = reach + 1
    width = -(-(before + k + reach) // 4)
    half = _half(span, k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            col = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            a, b = (_unpack(np.frombuffer(b"".join(col[c].to_pylist()), dtype=np.uint8).reshape(-1, width)) for c in ("around_a", "around_b"))
            same = a == b
            num = {n: col[n].to_numpy() for n in ("record_a", "record_b", "pos_a", "pos_b", "left_a", "left_b", "right_a", "right_b", "step_a", "step_b", "copies_a", "copies_b")}
            seed = same[:, before : before + k].all(axis=1)
            lead = np.minimum.accumulate(same[:, before - 1 :: -1][:, :before], axis=1).sum(axis=1)
            trail = np.minimum.accumulate(same[:, before + k : before + k + reach], axis=1).sum(axis=1)
            lead = np.minimum(lead, np.minimum(num["left_a"], num["left_b"]))
            trail = np.minimum(trail, np.minimum(num["right_a"], num["right_b"]))
            # a pair that shares the halves on both sides is met twice: here it counts by the left one
            keep = seed & (lead + k + trail >= span) & (col["left_half"].to_numpy(zero_copy_only=False) | (lead < half))
            num = {n: x[keep] for n, x in num.items()}
            lead, bases, m, n = lead[keep], (lead + k + trail)[keep], num["copies_a"], num["copies_b"]
            along = (num["step_a"] == num["step_b"]) | (m == 1) | (n == 1)
            ends = np.cumsum(np.where(along, m + n - 1, m * n))
            for at in range(0, int(ends[-1]) if len(ends) else 0, 200_000):
                number = np.arange(at, min(at + 200_000, int(ends[-1])))
                row = np.searchsorted(ends, number, side="right")
                nth = number - np.append(0, ends)[row]
                one, a, b = along[row], m[row], n[row]
                diagonal = nth - (a - 1)
                i = np.where(one, np.maximum(-diagonal, 0), nth // b)
                j = np.where(one, np.maximum(diagonal, 0), nth % b)
                more = np.where(one, np.minimum(a - i, b - j) - 1, 0)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x) for x in (num["record_a"][row], num["record_b"][row], num["pos_a"][row] + i * num["step_a"][row] - lead[row], num["pos_b"][row] + j * num["step_b"][row] - lead[row], bases[row] + more * num["step_a"][row], lead[row] <= reach)],
                    ["record_a", "record_b", "start_a", "start_b", "bases", "first"],
                )

    return run


def exact_classes(df: DataFrame, record: str, text: str) -> DataFrame:
    """(record, representative): records whose text is the same up to case share the smallest id of their class."""
    keyed = df.where(F.col(text).isNotNull()).select(F.col(record).alias("record"), F.md5(F.upper(text)).alias("_key"))
    least = keyed.groupBy("_key").agg(F.min("record").alias("representative"))
    return keyed.join(least, "_key").select("record", "representative")


def class_members(df: DataFrame, record: str, text: str, span: int = 100) -> DataFrame:
    """(record, representative, holds_span) of every record with a text: its class of exact copies, and whether the text
    has ``span`` clean bases in a row, so that the records of the class share them with each other."""
    holds = df.select(F.col(record).alias("record"), F.col(text).rlike(f"(?i)[ACGT]{{{span}}}").alias("holds_span"))
    return exact_classes(df, record, text).join(holds, "record")


def seed_rows(df: DataFrame, record: str, text: str, span: int = 100, k: int = 50) -> DataFrame:
    """Seeds of two records or more with what is around them, as runs."""
    rows = df.where(F.length(text) >= span).select(F.col(record).cast("bigint").alias("record"), F.col(text).alias("text"))
    light = rows.mapInArrow(_light(span, k), "anchor bigint, record bigint, pos bigint")
    spread = light.groupBy("anchor").agg(F.min("record").alias("_least"), F.max("record").alias("_most"))  # combined on the map side
    common = checkpointed(light.join(spread.where("_least < _most").select("anchor"), "anchor"))
    places = common.groupBy("record").agg(F.collect_list(F.struct("pos", "anchor")).alias("seeds"))  # no more than a text has
    if common.count() <= BROADCAST_ROWS:
        places = F.broadcast(places)
    around = rows.join(places, "record").select("record", "text", "seeds").mapInArrow(_surrounded(span, k), _SEED)
    return around.mapInArrow(_runs(span), f"{_SEED}, step bigint, copies bigint")


def seed_matches(df: DataFrame, record: str, text: str, span: int = 100, k: int = 50, places: bool = True) -> DataFrame:
    """Matches of at least ``span`` bases around the seeds that two records share, smaller record first.

    Without ``places`` seeds of equal surroundings are one in a record, and a pair of records has one match for each
    pair of surroundings, wherever they occur.
    """
    seeds = seed_rows(df, record, text, span, k)
    if not places:
        seeds = seeds.groupBy("anchor", "record", "left", "right", "around", "beside_left", "beside_right").agg(F.min("pos").alias("pos")).withColumns({"step": F.lit(0).cast("bigint"), "copies": F.lit(1).cast("bigint")})
    seeds = checkpointed(seeds)  # read by both sides
    halves = F.array(*(F.struct(F.lit(left).alias("left_half"), F.col(c).alias("beside")) for left, c in ((True, "beside_left"), (False, "beside_right"))))
    keyed = seeds.select("*", F.inline(halves)).where("beside >= 0")
    sides = [keyed.select("anchor", "left_half", "beside", *(F.col(c).alias(f"{c}_{s}") for c in ("record", "pos", "left", "right", "around", "step", "copies"))) for s in "ab"]
    pairs = sides[0].join(sides[1], ["anchor", "left_half", "beside"]).where("record_a < record_b").drop("anchor", "beside")
    return pairs.mapInArrow(_extend(span, k), "record_a bigint, record_b bigint, start_a bigint, start_b bigint, bases bigint, first boolean")


def _representatives(df: DataFrame, classes: DataFrame, record: str) -> DataFrame:
    """One row of each class, and rows without a text; texts are only shuffled where there are very many copies."""
    return df.join(small(classes.where("record != representative").select(F.col("record").alias(record))), record, "left_anti")


def sharing_classes(df: DataFrame, record: str, text: str, span: int = 100, k: int = 50) -> tuple[DataFrame, DataFrame]:
    """Pairs (record_a, record_b) of representatives that share a stretch, and the membership of all records."""
    classes = checkpointed(exact_classes(df, record, text))
    # a maximal match begins within reach of its first seed: that seed alone reports the pair
    pairs = seed_matches(_representatives(df, classes, record), record, text, span, k, places=False).where("first").select("record_a", "record_b").distinct()
    return pairs, classes


def sharing_pairs(df: DataFrame, record: str, text: str, span: int = 100, k: int = 50) -> DataFrame:
    """(record_a, record_b), smaller first: every pair of records that share, ignoring case, a stretch of ``span``
    or more consecutive bases A, C, G or T read in the same direction.

    Records with a null, empty or shorter text share nothing. Copies of one text are expanded to pairs here,
    as the result asks for pairs; ``sharing_classes`` has the same without that.
    """
    pairs, classes = sharing_classes(df, record, text, span, k)
    a, b = (classes.select(F.col("representative").alias(f"record_{s}"), F.col("record").alias(f"member_{s}")) for s in "ab")
    between = pairs.join(a, "record_a").join(b, "record_b").select(F.least("member_a", "member_b").alias("record_a"), F.greatest("member_a", "member_b").alias("record_b"))
    long_enough = df.where(F.col(text).rlike(f"(?i)[ACGT]{{{span}}}")).select(F.col(record).alias("member"))
    copied = classes.where("record != representative").select("representative").distinct()
    groups = classes.join(copied, "representative", "left_semi").join(long_enough, F.col("record") == F.col("member"), "left_semi")
    within = groups.select("representative", F.col("record").alias("record_a")).join(groups.select("representative", F.col("record").alias("record_b")), "representative").where("record_a < record_b").select("record_a", "record_b")
    return between.unionByName(within)


def maximal_spans(df: DataFrame, record: str, text: str, span: int = 100, k: int = 50) -> DataFrame:
    """(record_a, record_b, start_a, start_b, bases) of every maximal match between representatives of the classes."""
    classes = checkpointed(exact_classes(df, record, text))
    found = seed_matches(_representatives(df, classes, record), record, text, span, k).withColumn("_shift", F.col("start_b") - F.col("start_a"))
    along = Window.partitionBy("record_a", "record_b", "_shift").orderBy("start_a")
    before = F.max(F.col("start_a") + F.col("bases")).over(along.rowsBetween(Window.unboundedPreceding, -1))
    return (
        found.withColumn("_new", F.when(F.col("start_a") < before, 0).otherwise(1))
        .withColumn("_island", F.sum("_new").over(along.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("record_a", "record_b", "_shift", "_island")
        .agg(F.min("start_a").alias("start_a"), F.min("start_b").alias("start_b"), F.max(F.col("start_a") + F.col("bases")).alias("_end"))
        .select("record_a", "record_b", "start_a", "start_b", (F.col("_end") - F.col("start_a")).alias("bases"))
    )


def _stretches(span: int, k: int):
    """Per seed: (w1, w2, record, start) of every clean stretch of ``span`` bases that holds the seed."""
    reach = span - k
    before = reach + 1
    width = -(-(before + k + reach) // 4)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2_000):
                part = batch.slice(at, 2_000)
                record, pos, left, right = (part.column(i).to_numpy() for i in range(4))
                codes = _unpack(np.frombuffer(b"".join(part.column(4).to_pylist()), dtype=np.uint8).reshape(-1, width))[:, : before + k + reach]
                w1, w2 = window_fingerprints(codes, span)
                shift = np.arange(w1.shape[1])  # the stretch begins at pos - before + shift
                good = (before - shift[None, :] <= left[:, None]) & (shift[None, :] - 1 <= right[:, None]) & (shift[None, :] >= 1)
                row, column = np.nonzero(good)
                yield pa.RecordBatch.from_arrays([pa.array(w1[good]), pa.array(w2[good]), pa.array(record[row]), pa.array(pos[row] - before + column)], ["w1", "w2", "record", "start"])

    return run


def shared_stretches(df: DataFrame, record: str, text: str, span: int = 100, k: int = 50) -> DataFrame:
    """(record, start) of every stretch of ``span`` bases that another record has too.

    Nothing is paired: a stretch is shared if its 128-bit fingerprint occurs in two records, so a stretch that a
    third of all records hold costs no more than as many others. Only seeds found in two records are looked into.
    """
    seeds = seed_rows(df, record, text, span, k)
    # each copy in a run has the same surroundings
    each = seeds.select("record", "left", "right", "around", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("copies") - 1)).alias("_nth"), "pos", "step")
    stretches = each.select("record", (F.col("pos") + F.col("_nth") * F.col("step")).alias("pos"), "left", "right", "around").mapInArrow(_stretches(span, k), "w1 bigint, w2 bigint, record bigint, start bigint")
    spread = stretches.groupBy("w1", "w2").agg(F.min("record").alias("_least"), F.max("record").alias("_most"))
    return stretches.join(spread.where("_least < _most").select("w1", "w2"), ["w1", "w2"], "left_semi").select("record", "start")


def shared_bases(df: DataFrame, record: str, text: str, span: int = 100, k: int = 50, by_spans: bool = False) -> DataFrame:
    """(record, n_bases, shared_bases): for each record the bases in stretches that also occur in another record.

    Every record comes out; null and empty texts have 0 of 0 bases. A record with exact copies shares all its
    clean stretches of ``span`` or more bases. ``by_spans`` unites the maximal spans of all pairs; otherwise the same
    is told without pairs, by the stretches that two records have.
    """
    classes = checkpointed(exact_classes(df, record, text))
    if by_spans:
        spans = maximal_spans(df, record, text, span, k)
        sides = [spans.select(F.col(f"record_{s}").cast("string").alias("owner"), F.col(f"start_{s}").alias("s"), (F.col(f"start_{s}") + F.col("bases")).alias("e")) for s in "ab"]
        covered = sides[0].unionByName(sides[1])
    else:
        found = shared_stretches(_representatives(df, classes, record), record, text, span, k)
        covered = found.select(F.col("record").cast("string").alias("owner"), F.col("start").alias("s"), (F.col("start") + span).alias("e"))
    by_match = periods(covered, "owner", "s", "e").groupBy("owner").agg(F.sum(F.col("period_end") - F.col("period_start")).alias("_matched"))
    copies = classes.groupBy("representative").agg(F.count(F.lit(1)).alias("_copies"))
    clean = F.aggregate(F.regexp_extract_all(F.upper(text), F.lit(f"([ACGT]{{{span},}})"), F.lit(1)), F.lit(0).cast("bigint"), lambda s, x: s + F.length(x))
    return (
        df.select(F.col(record).alias("record"), F.coalesce(F.length(text), F.lit(0)).cast("bigint").alias("n_bases"), F.coalesce(clean, F.lit(0)).alias("_clean"))
        .join(classes, "record", "left")
        .join(copies, "representative", "left")
        .join(by_match, F.col("representative").cast("string") == F.col("owner"), "left")
        .select("record", "n_bases", F.when(F.col("_copies") > 1, F.col("_clean")).otherwise(F.coalesce("_matched", F.lit(0))).cast("bigint").alias("shared_bases"))
    )
