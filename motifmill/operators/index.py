"""Full-text index of each sequence as tables: suffix array, BWT, counts, ranks, intervals, LCP.

Every sequence is indexed with one '$' at its end. Suffixes are ranked by their first 16 characters, packed in two
numbers, with one range sort over all sequences: no task sorts a whole sequence, and whatever one task sorts is read
as a stream. A suffix that begins with a period of up to 8 characters is ranked by how long the period goes on and by
what ends it, so that a run of N or a short tandem array of any length leaves no ties. The ties that are left are
broken by the next 256 characters, and then by doubling: a class of suffixes that agree in m characters is ranked by
the ranks of the suffixes m characters later. A round reads and writes tied suffixes only. What is found is written
to the checkpoint folder.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from motifmill.operators.arrowstream import changes, whole_groups
from motifmill.operators.kmers import CHUNK, chunks
from motifmill.operators.patterns import Group, found_rows, groups, listed, lookup_of, looked_up, motif_places, split, whole_rows
from motifmill.operators.runs import period_runs
from motifmill.session import BROADCAST_ROWS, checkpointed, shuffle_width, written

PREFIX = 16
#: Characters of a text up to which one task ranks all its suffixes, where only intervals are asked for.
WHOLE = 1 << 20
_PERIOD = 8
_BLOCK = 4096
_TEXT, _NEAR = 256, 1024  # characters of the second key, and length of the pieces of text that it is read from
_ENDS_HIGH = 1 << 62  # a period that a greater character ends: the longer, the lesser
_SIGN = np.uint64(1 << 63)


def indexed_text(seqs: DataFrame) -> DataFrame:
    """Sequences with the end mark '$' that the index needs; ``n`` counts it."""
    return seqs.select(*[c for c in seqs.columns if c not in ("seq", "n")], F.concat("seq", F.lit("$")).alias("seq"), (F.col("n") + 1).alias("n"))


def char_counts(texts: DataFrame) -> DataFrame:
    """(seq_ord, ch, total, cumulative): how often each character is in a text, and how many lesser ones there are."""
    per_chunk = chunks(texts, 0, spread=False).select("seq_ord", F.explode(F.split("chunk", "")).alias("ch")).where("ch != ''")
    totals = per_chunk.groupBy("seq_ord", "ch").agg(F.count(F.lit(1)).alias("total"))
    lesser = Window.partitionBy("seq_ord").orderBy("ch").rowsBetween(Window.unboundedPreceding, -1)
    return totals.withColumn("cumulative", F.coalesce(F.sum("total").over(lesser), F.lit(0)))


def _suffix_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks to (seq_ord, pos, k0, k1, tail, ch): the first 16 bytes of each suffix, how its period ends, the character before."""
    for batch in batches:
        for owner, base, body, left, text, periodic in zip(*(batch.column(i).to_pylist() for i in range(6))):
            codes = np.frombuffer(text.encode("latin-1", "replace"), dtype=np.uint8)
            padded = np.concatenate([codes, np.zeros(PREFIX, dtype=np.uint8)]).astype(np.uint64)
            packed = np.zeros(body + 8, dtype=np.uint64)
            for j in range(8):
                packed |= padded[j : j + body + 8] << np.uint64(56 - 8 * j)
            packed = (packed ^ _SIGN).view(np.int64)
            tail = np.zeros(body, dtype=np.int64)
            for run in periodic or ():
                low, high = max(run["a"] - base, 0), min(run["e"] - PREFIX - base, body - 1)
                length = run["e"] - base - np.arange(low, high + 1)
                tail[low : high + 1] = _ENDS_HIGH - length if run["ends_high"] else length
            before = np.concatenate([[ord(left) if left else ord("$")], codes[: body - 1]])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(body, owner, dtype=np.int64)), pa.array(base + np.arange(body)), pa.array(packed[:body]), pa.array(packed[8 : 8 + body]), pa.array(tail), pa.array(before.astype(np.int32))],
                ["seq_ord", "pos", "k0", "k1", "tail", "ch"],
            )


def _period_length(tail: np.ndarray) -> np.ndarray:
    return np.where(tail == 0, PREFIX, np.where(tail < _ENDS_HIGH >> 1, tail, _ENDS_HIGH - tail))


def _common_bytes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Leading bytes in which packed numbers agree."""
    differ = (a ^ b).astype(">i8").view(np.uint8).reshape(-1, 8) != 0
    return np.where(differ.any(axis=1), differ.argmax(axis=1), 8)


_RANKED = "part int, seq_ord bigint, pos bigint, at bigint, ties bigint, k0 bigint, k1 bigint, tail bigint, lcp bigint, ch int"


def _rank_sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted keys of one partition with the place ``at`` of each class of equal keys among the partition's rows of its
    sequence, and the class's LCP with the class before it (-1 for the partition's first)."""
    part, done, owner, begun, last = TaskContext.get().partitionId(), 0, None, 0, None
    for table in whole_groups(batches, ["seq_ord", "k0", "k1", "tail"]):
        n = table.num_rows
        seq, k0, k1, tail = (table.column(c).to_numpy() for c in ("seq_ord", "k0", "k1", "tail"))
        first = np.flatnonzero(changes(table, ["seq_ord", "k0", "k1", "tail"]))
        klass = np.repeat(np.arange(len(first)), np.diff(np.append(first, n)))
        new_seq = np.append(seq[0] != owner, seq[1:] != seq[:-1])
        starts = np.where(new_seq, done + np.arange(n), begun if last is not None else 0)
        starts = np.maximum.accumulate(starts)
        before = [np.append(c[0] if last is None else x, c[first[1:] - 1]) for c, x in zip((k0, k1, tail), last or (0, 0, 0))]
        high = _common_bytes(k0[first], before[0])
        lcp = np.where(high < 8, high, 8 + _common_bytes(k1[first], before[1]))
        whole = lcp == PREFIX
        lcp[whole] = np.minimum(_period_length(tail[first]), _period_length(before[2]))[whole]
        lcp[new_seq[first]] = 0
        if last is None:
            lcp[0] = -1
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(n, part, dtype=np.int32)), *(table.column(c).combine_chunks() for c in ("seq_ord", "pos")), pa.array((done + first)[klass] - starts), pa.array(np.diff(np.append(first, n))[klass]), *map(pa.array, (k0, k1, tail)), pa.array(lcp[klass]), table.column("ch").combine_chunks()],
            ["part", "seq_ord", "pos", "at", "ties", "k0", "k1", "tail", "lcp", "ch"],
        )
        owner, begun, last, done = seq[-1], starts[-1], (k0[-1], k1[-1], tail[-1]), done + n


@dataclass(frozen=True)
class Index:
    """``table``: (seq_ord, rank, pos, ch, k0, k1, tail, class_rank, lcp), ``lcp`` known for the first of each class of
    equal keys. ``tied``: of it, the rows of classes of two or more. ``levels``: the tied classes (seq_ord, pos, rank,
    agree) before each round, whose members agree in ``agree`` characters; the first round goes by the text ``near``,
    the others by doubling."""

    table: DataFrame
    tied: DataFrame
    levels: list[DataFrame]
    near: DataFrame


def _with_text(rows: DataFrame, near: DataFrame, at: str, name: str) -> DataFrame:
    """Adds the text of up to 256 characters that begins at ``at``, null behind the end."""
    return (
        rows.withColumn("base", F.floor(F.col(at) / _NEAR) * _NEAR)
        .join(near, ["seq_ord", "base"], "left")
        .withColumn(name, F.nullif(F.substring("chunk", (F.col(at) - F.col("base") + 1).cast("int"), F.lit(_TEXT)), F.lit("")))
        .drop("base", "chunk")
    )


def _agree() -> Column:
    tail = F.col("tail")
    return F.when(tail == 0, F.lit(PREFIX)).when(tail < _ENDS_HIGH >> 1, tail).otherwise(F.lit(_ENDS_HIGH) - tail).cast("bigint")


def _broken(later: DataFrame) -> DataFrame:
    """Tied classes (seq_ord, pos, rank, agree) broken by ``_later``, of which ``_more`` characters agree where it is equal."""
    group = Window.partitionBy("seq_ord", "rank").orderBy(F.asc_nulls_first("_later"))
    steps = later.withColumn("_step", F.rank().over(group) - 1).withColumn("_ties", F.count(F.lit(1)).over(group.rangeBetween(0, 0)))
    return checkpointed(steps.select("seq_ord", "pos", (F.col("rank") + F.col("_step")).cast("bigint").alias("rank"), "_ties", (F.col("agree") + F.coalesce("_more", F.lit(0))).alias("agree")))


def build(seqs: DataFrame) -> Index:
    """The index of every sequence (an empty one has the suffix '$' alone), sequences known by ``seq_ord``."""
    texts = indexed_text(seqs)
    expected = F.ascii(F.substring("seed", ((F.col("z") + F.col("p") - F.col("a")) % F.col("p") + 1).cast("int"), F.lit(1)))
    periodic = period_runs(texts, 1, _PERIOD, min_length=PREFIX).select("seq_ord", "a", (F.col("z") + F.col("p")).alias("e"), (F.col("following") > expected).alias("ends_high"))
    within = periodic.select("seq_ord", F.struct("a", "e", "ends_high").alias("_run"), F.explode(F.sequence(F.floor(F.col("a") / CHUNK), F.floor((F.col("e") - PREFIX) / CHUNK))).alias("_no"))
    of_chunk = within.groupBy("seq_ord", (F.col("_no") * CHUNK).alias("base")).agg(F.collect_list("_run").alias("_runs"))  # no more than a chunk has room for
    keys = chunks(texts, PREFIX).join(of_chunk, ["seq_ord", "base"], "left").select("seq_ord", "base", "body_len", "left", "chunk", "_runs").mapInArrow(_suffix_keys, "seq_ord bigint, pos bigint, k0 bigint, k1 bigint, tail bigint, ch int")
    order = ["seq_ord", "k0", "k1", "tail"]
    sorted_keys = keys.repartitionByRange(shuffle_width(seqs.sparkSession), *order).sortWithinPartitions(*order)
    parts = written(sorted_keys.mapInArrow(_rank_sorted, _RANKED))
    earlier = Window.partitionBy("seq_ord").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.groupBy("seq_ord", "part").agg(F.count(F.lit(1)).alias("_n")).withColumn("_offset", F.sum("_n").over(earlier)).where("_offset > 0").drop("_n")  # at most one sequence goes on into a partition
    base = parts.join(F.broadcast(offsets), ["seq_ord", "part"], "left").withColumn("rank", F.col("at") + F.coalesce("_offset", F.lit(0))).withColumn("class_rank", F.col("rank")).withColumn("ch", F.char("ch")).drop("part", "at", "_offset")
    columns = ["seq_ord", "rank", "pos", "ch", "k0", "k1", "tail", "class_rank", "lcp"]
    untied, classes = base.where("ties = 1").select(*columns), base.where("ties > 1")
    level = checkpointed(classes.select("seq_ord", "pos", "rank", _agree().alias("agree")))
    levels, settled, latest = [], None, None
    near = checkpointed(chunks(texts, _TEXT, _NEAR).select("seq_ord", "base", "chunk"))
    ranks_of = base.select("seq_ord", "pos", "rank", _agree().alias("agree")).persist()  # read in each round of doubling
    while n := level.count():
        levels.append(level)
        if len(levels) == 1:
            by_text = _with_text(level.withColumn("_next", F.col("pos") + F.col("agree")), near, "_next", "_later")
            found = _broken(by_text.withColumn("_more", F.length("_later").cast("bigint")))
            latest = found.select("seq_ord", "pos", "rank", "agree")
            settled = found.where("_ties = 1").select("seq_ord", "pos", "rank", "agree")
            level = found.where("_ties > 1").select("seq_ord", "pos", "rank", "agree")
            continue
        wanted = level.select("seq_ord", (F.col("pos") + F.col("agree")).alias("pos")).distinct()
        later = ranks_of.join(F.broadcast(wanted) if n <= BROADCAST_ROWS else wanted, ["seq_ord", "pos"])
        newer = latest.select("seq_ord", "pos", F.col("rank").alias("_newer"), F.col("agree").alias("_more"))
        later = later.join(newer, ["seq_ord", "pos"], "left").select("seq_ord", "pos", F.coalesce("_newer", "rank").alias("rank"), F.coalesce("_more", "agree").alias("agree"))
        later = later.select("seq_ord", F.col("pos").alias("_next"), F.col("rank").alias("_later"), F.col("agree").alias("_more"))
        found = _broken(level.withColumn("_next", F.col("pos") + F.col("agree")).join(later, ["seq_ord", "_next"], "left"))
        latest = found.select("seq_ord", "pos", "rank", "agree").unionByName(settled)
        settled = settled.unionByName(found.where("_ties = 1").select("seq_ord", "pos", "rank", "agree"))
        level = found.where("_ties > 1").select("seq_ord", "pos", "rank", "agree")
    ranks_of.unpersist()
    if settled is None:
        return Index(untied, untied.where("false"), levels, near)
    tied = checkpointed(classes.drop("rank", "ties").join(settled.select("seq_ord", "pos", "rank"), ["seq_ord", "pos"]).select(*columns))
    return Index(untied.unionByName(tied), tied, levels, near)


def _built(source: DataFrame | Index) -> Index:
    return source if isinstance(source, Index) else build(source)


def suffix_array(source: DataFrame | Index) -> DataFrame:
    """(seq_ord, rank, pos): start of the suffix at each rank, of sequences or of their index."""
    return _built(source).table.select("seq_ord", "rank", "pos")


def bwt(source: DataFrame | Index) -> DataFrame:
    """(seq_ord, rank, ch): the character before the suffix at each rank."""
    return _built(source).table.select("seq_ord", "rank", "ch")


def _block(rank: str = "rank") -> Column:
    return F.floor(F.col(rank) / _BLOCK)


def _above_blocks(rows: DataFrame) -> DataFrame:
    """(seq_ord, ch, block, above): how often a character stands above each block of ranks in which it stands."""
    counts = rows.groupBy("seq_ord", "ch", _block().alias("block")).agg(F.count(F.lit(1)).alias("_n"))
    above = Window.partitionBy("seq_ord", "ch").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return counts.select("seq_ord", "ch", "block", F.coalesce(F.sum("_n").over(above), F.lit(0)).alias("above"))


def occurrence_ranks(source: DataFrame | Index) -> DataFrame:
    """(seq_ord, rank, ch, occ, lf): how often a row's own character stands above it, and the row it leads to.

    Rows are counted in blocks of ranks, to which the counts of the blocks above are added.
    """
    rows = _built(source).table.select("seq_ord", "rank", "ch").withColumn("block", _block())
    above = _above_blocks(rows)
    totals = rows.groupBy("seq_ord", "ch").agg(F.count(F.lit(1)).alias("_n"))
    lesser = Window.partitionBy("seq_ord").orderBy("ch").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("seq_ord", "ch", F.coalesce(F.sum("_n").over(lesser), F.lit(0)).alias("_lesser"))
    inside = F.row_number().over(Window.partitionBy("seq_ord", "ch", "block").orderBy("rank")) - 1
    counted = rows.withColumn("_inside", inside).join(above.join(starts, ["seq_ord", "ch"]), ["seq_ord", "ch", "block"])
    occ = (F.col("above") + F.col("_inside")).cast("bigint")
    return counted.select("seq_ord", "rank", "ch", occ.alias("occ"), (F.col("_lesser") + occ).alias("lf"))


def rank_lookups(source: DataFrame | Index, wanted: DataFrame) -> DataFrame:
    """``wanted`` (seq_ord, ch, place, and more) with ``occ``: how often ``ch`` is among the first ``place`` rows of the BWT.

    Any character at any place: 0 for one that is not there or a place of 0 or less; a place behind the end counts all.
    Rows with a null in seq_ord, ch or place have 0. Wanted rows and BWT rows meet in blocks of ranks, each counted
    through once.
    """
    rows = _built(source).table.select("seq_ord", "rank", "ch")
    per_block = rows.groupBy("seq_ord", "ch", _block().alias("block")).agg(F.count(F.lit(1)).alias("_n"))
    asked = wanted.withColumn("_asked", F.struct(*wanted.columns))
    events = rows.select("seq_ord", "ch", _block().alias("block"), F.col("rank").alias("_at"), F.lit(1).alias("_one"), F.lit(None).cast(asked.schema["_asked"].dataType).alias("_asked"))
    asked = asked.select("seq_ord", "ch", F.greatest(_block("place"), F.lit(0)).alias("block"), (F.col("place") - 1).cast("bigint").alias("_at"), F.lit(0).alias("_one"), "_asked")
    before = Window.partitionBy("seq_ord", "ch").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = per_block.unionByName(asked.select("seq_ord", "ch", "block", F.lit(0).cast("bigint").alias("_n")).distinct()).groupBy("seq_ord", "ch", "block").agg(F.sum("_n").alias("_n"))
    above = blocks.select("seq_ord", "ch", "block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_above"))
    along = Window.partitionBy("seq_ord", "ch", "block").orderBy("_at", F.desc("_one")).rowsBetween(Window.unboundedPreceding, 0)
    counted = events.unionByName(asked).withColumn("_inside", F.sum("_one").over(along)).where("_asked is not null")
    return counted.join(above, ["seq_ord", "ch", "block"], "left").select("_asked.*", (F.coalesce("_above", F.lit(0)) + F.when(F.col("ch").isNull() | F.col("seq_ord").isNull() | F.col("_at").isNull(), 0).otherwise(F.col("_inside"))).cast("bigint").alias("occ"))


def preceding_characters(source: DataFrame | Index, intervals: DataFrame) -> DataFrame:
    """(seq_ord, motif, ch, n): how often each character stands before a motif, counted in the motif's slice of the BWT
    (``intervals``: seq_ord, motif, first_rank, last_rank) as the difference of two ranks; '$' is the start of the text."""
    index = _built(source)
    alphabet = index.table.select("seq_ord", "ch").distinct()
    ends = F.array(F.struct(F.col("first_rank").alias("place"), F.lit(-1).alias("sign")), F.struct((F.col("last_rank") + 1).alias("place"), F.lit(1).alias("sign")))
    wanted = intervals.join(alphabet, "seq_ord").select("seq_ord", "motif", "ch", F.inline(ends))
    return rank_lookups(index, wanted).groupBy("seq_ord", "motif", "ch").agg(F.sum(F.col("sign") * F.col("occ")).alias("n")).where("n > 0")


def occurrence_checkpoints(source: DataFrame | Index, every: int = 128) -> DataFrame:
    """(seq_ord, ch, prefix, occ): occurrences of each character in the first ``prefix`` rows, for multiples of
    ``every`` and the whole; a character not yet seen counts 0."""
    rows = _built(source).table.select("seq_ord", F.floor(F.col("rank") / every).alias("block"), "ch")
    counts = rows.groupBy("seq_ord", "block", "ch").agg(F.count(F.lit(1)).alias("_n"))
    sizes = counts.groupBy("seq_ord").agg(F.sum("_n").alias("n"))
    blocks = sizes.select("seq_ord", "n", F.explode(F.sequence(F.lit(0).cast("bigint"), F.ceil(F.col("n") / every).cast("bigint"))).alias("block"))
    grid = blocks.join(counts.select("seq_ord", "ch").distinct(), "seq_ord")
    before = Window.partitionBy("seq_ord", "ch").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return grid.join(counts, ["seq_ord", "block", "ch"], "left").select("seq_ord", "ch", F.least(F.col("block") * every, F.col("n")).cast("bigint").alias("prefix"), F.coalesce(F.sum("_n").over(before), F.lit(0)).cast("bigint").alias("occ"))


def sampled(source: DataFrame | Index, rate: int = 32) -> DataFrame:
    """Every ``rate``-th row of the suffix array."""
    return suffix_array(source).where(F.col("rank") % rate == 0)


def _prefix_runs(patterns: list[str]):
    """Rows (seq_ord, rank, k0) to (seq_ord, motif, first_rank, last_rank) of the rows in a row that begin with a pattern."""
    names, lengths = pa.array(patterns, pa.string()), {}
    for i, p in enumerate(patterns):
        lengths.setdefault(len(p), []).append((int.from_bytes(p.encode("latin-1", "replace"), "big"), i))
    tables = [(k, *(np.array(x) for x in zip(*sorted(v)))) for k, v in sorted(lengths.items())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seq, rank = (batch.column(i).to_numpy() for i in range(2))
            key = batch.column(2).to_numpy().view(np.uint64) ^ _SIGN
            for k, values, numbers in tables:
                values = values.astype(np.uint64)
                own = key >> np.uint64(64 - 8 * k)
                at = np.minimum(np.searchsorted(values, own), len(values) - 1)
                hit = np.flatnonzero(values[at] == own)
                if len(hit):
                    which, owner, place = numbers[at[hit]], seq[hit], rank[hit]
                    first = np.flatnonzero(np.append(True, (which[1:] != which[:-1]) | (owner[1:] != owner[:-1])))
                    yield pa.RecordBatch.from_arrays([pa.array(owner[first]), names.take(pa.array(which[first])), pa.array(np.minimum.reduceat(place, first)), pa.array(np.maximum.reduceat(place, first))], ["seq_ord", "motif", "first_rank", "last_rank"])

    return run


def _suffix_ranks(group: Group) -> np.ndarray:
    """For each byte of a group of whole texts with end mark: the place of its suffix among all, text by text, -1 between
    the texts. Sorted by as many characters as a number holds, then ties are doubled."""
    codes = group.codes
    inside = np.flatnonzero(np.arange(len(codes)) - group.first[group.piece] < group.size[group.piece])
    letters = np.unique(codes[inside])
    symbol = np.zeros(256, dtype=np.int64)
    symbol[letters] = np.arange(1, len(letters) + 1)
    bits, pieces = int(len(letters)).bit_length(), int(len(group.first) - 1).bit_length()
    key, reach = symbol[codes], 1
    outside = np.ones(len(codes), dtype=bool)
    outside[inside] = False
    key[outside] = 0
    while 2 * reach * bits + pieces <= 63 and reach < PREFIX:
        key = (key << (reach * bits)) | np.append(key[reach:], np.zeros(reach, dtype=np.int64))[: len(key)]
        reach *= 2
    key = (key | (group.piece << (reach * bits)))[inside]
    order = np.argsort(key)
    key, order = key[order], inside[order]
    ranks = np.full(len(codes), -1)
    start = np.append(True, key[1:] != key[:-1])
    classes = np.maximum.accumulate(np.where(start, np.arange(len(order)), 0))
    ranks[order] = classes
    tied = np.flatnonzero(~start | ~np.append(start[1:], True))
    at, classes = order[tied], classes[tied]
    while len(at):  # two of a class go on for ``reach`` characters at least, so what is there is in the text or just behind it
        second = classes * (len(order) + 1) + ranks[at + reach] + 1
        by = np.argsort(second)
        at, classes, second = at[by], classes[by], second[by]
        n = np.arange(len(at))
        new_class, start = np.append(True, classes[1:] != classes[:-1]), np.append(True, second[1:] != second[:-1])
        classes = classes + np.maximum.accumulate(np.where(start, n, 0)) - np.maximum.accumulate(np.where(new_class, n, 0))
        ranks[at] = classes
        left = ~start | ~np.append(start[1:], True)
        at, classes, reach = at[left], classes[left], 2 * reach
    return ranks


def _whole_intervals(token: str, names: pa.Array):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = lookup_of(token, names)
        for group in groups(batches, "$", PREFIX):
            ranks, found = _suffix_ranks(group), []
            first = np.cumsum(group.size) - group.size
            rows = np.full(int(group.size.sum()), -1)
            for k, place, which in lookup.find(group.codes, group.room):
                rank = ranks[place]
                if 8 * len(place) > len(rows):
                    rows[rank] = which
                    rank = np.flatnonzero(rows >= 0)
                    which = rows[rank]
                    rows[rank] = -1
                else:
                    by = np.argsort(rank)
                    rank, which = rank[by], which[by]
                piece = np.searchsorted(first, rank, side="right") - 1 if len(rank) < 1000 else np.repeat(np.arange(len(first)), group.size)[rank]
                begins = np.append(True, (which[1:] != which[:-1]) | (piece[1:] != piece[:-1]))  # the rows of a pattern follow each other
                low, high = rank[begins], rank[np.append(begins[1:], True)]
                piece = piece[begins]
                found.append((piece, lookup.numbers[k][which[begins]], low - first[piece], high - first[piece]))
            yield from found_rows(lookup, group, found, ["first_rank", "last_rank"])

    return run


def motif_intervals(seqs: DataFrame, motifs: DataFrame, index: Index | None = None) -> DataFrame:
    """(seq_ord, motif, first_rank, last_rank): the rows whose suffixes begin with a pattern of ``motifs.motif``, of any length.

    Without an index, texts of up to ``WHOLE`` characters are ranked where they are read and only intervals leave the
    task; an index is made of longer ones alone. An empty or null pattern has no row.
    """
    if index is not None:
        return _index_intervals(seqs, motifs, index)
    parts = listed(motifs)
    whole, others = split(seqs, WHOLE)
    found = looked_up(whole_rows(whole), parts, _whole_intervals, "seq_ord bigint, motif string, first_rank bigint, last_rank bigint")
    return found if others.isEmpty() else found.unionByName(_index_intervals(others, motifs, build(others)))


def _index_intervals(seqs: DataFrame, motifs: DataFrame, index: Index) -> DataFrame:
    """The same from an index: patterns of up to 8 characters are read off the packed keys; longer ones are located in the
    text and their places looked up in the suffix array."""
    rows = index.table
    short = [r["motif"] for r in motifs.where("length(motif) between 1 and 8").select("motif").distinct().limit(200_001).collect()]  # bounded
    long = motifs.where("length(motif) > 8") if len(short) <= 200_000 else motifs
    places = motif_places(seqs, long).join(rows.select("seq_ord", "pos", "rank"), ["seq_ord", "pos"]).select("seq_ord", "motif", F.col("rank").alias("first_rank"), F.col("rank").alias("last_rank"))
    parts = places
    if short and len(short) <= 200_000:
        parts = rows.select("seq_ord", "rank", "k0").mapInArrow(_prefix_runs(sorted(short)), "seq_ord bigint, motif string, first_rank bigint, last_rank bigint")
        if not long.isEmpty():
            parts = parts.unionByName(places)
    return parts.groupBy("seq_ord", "motif").agg(F.min("first_rank").alias("first_rank"), F.max("last_rank").alias("last_rank"))


def count_occurrences(text: Column, pattern: str) -> Column:
    """Occurrences of a literal pattern in a text, overlapping ones too; the empty pattern counts every character."""
    if not pattern:
        return F.length(text)
    return F.regexp_count(text, F.lit(f"(?=\\Q{pattern}\\E)"))


def _leading(a: str, b: str) -> Column:
    """Leading bytes in which two packed numbers agree (hex leaves out leading zeros)."""
    x = F.col(a).bitwiseXOR(F.col(b))
    return F.when(x == 0, 8).otherwise(8 - F.ceil(F.length(F.hex(x)) / 2))


def lcp_array(source: DataFrame | Index) -> DataFrame:
    """(seq_ord, rank, pos, lcp): length of the prefix a suffix shares with the one ranked before it; 0 at rank 0.

    Where the keys differ the sort has told it. Pairs with equal keys go on, from the last round of doubling to the
    first, by as much as their class agreed in wherever they were in one class; then their keys differ, or the text
    behind equal keys.
    """
    index = _built(source)
    known = index.table.where("rank = class_rank and lcp >= 0 or rank = 0").select("seq_ord", "rank", "pos", F.greatest("lcp", F.lit(0)).alias("lcp"))
    open_ends = index.table.where("rank = class_rank and lcp < 0 and rank > 0")  # at most one for each partition of the sort
    above = index.table.join(F.broadcast(open_ends.select("seq_ord", (F.col("rank") - 1).alias("rank"))), ["seq_ord", "rank"])
    deep = index.tied.where("rank > class_rank").unionByName(open_ends).select("seq_ord", "rank", "pos")
    ranked = index.tied.unionByName(above).select("seq_ord", (F.col("rank") + 1).alias("rank"), F.col("pos").alias("_j")).distinct()
    pairs = deep.join(ranked, ["seq_ord", "rank"]).withColumn("_i", F.col("pos"))
    for level in reversed(index.levels):
        i, j = (level.select("seq_ord", F.col("pos").alias(f"_{s}"), F.col("rank").alias(f"_r{s}"), F.col("agree").alias(f"_g{s}")) for s in "ij")
        skip = F.when(F.col("_ri") == F.col("_rj"), F.col("_gi")).otherwise(0)
        pairs = pairs.join(i, ["seq_ord", "_i"], "left").join(j, ["seq_ord", "_j"], "left").select("seq_ord", "rank", "pos", (F.col("_i") + skip).alias("_i"), (F.col("_j") + skip).alias("_j"), (skip > 0).alias("_by_text"))
    if index.levels:
        pairs = checkpointed(pairs)  # the last level was the first: those in one class there differ in the text behind
    else:
        pairs = pairs.withColumn("_by_text", F.lit(False))
    texts = _with_text(_with_text(pairs.where("_by_text"), index.near, "_i", "_x"), index.near, "_j", "_y")
    widths = F.array(*(F.lit(_TEXT >> i) for i in range(1, _TEXT.bit_length())))
    same = F.aggregate(widths, F.lit(0), lambda n, w: F.when(F.substring("_x", n + 1, w) == F.substring("_y", n + 1, w), n + w).otherwise(n))
    by_text = texts.select("seq_ord", "rank", "pos", (F.col("_i") - F.col("pos") + F.when(F.col("_x").isNull() | F.col("_y").isNull(), 0).otherwise(same)).cast("bigint").alias("lcp"))
    pairs = pairs.where("not _by_text")
    ends = pairs.select("seq_ord", "rank", F.col("pos").alias("_begin"), (F.col("_i") - F.col("pos")).alias("_done"), F.posexplode(F.array("_i", "_j")).alias("_side", "pos"))
    keyed = ends.join(index.table.select("seq_ord", "pos", "k0", "k1", _agree().alias("_length")), ["seq_ord", "pos"], "left")
    side = lambda c, n: F.max(F.when(F.col("_side") == n, F.col(c))).alias(f"{c}_{n}")
    both = keyed.groupBy("seq_ord", "rank", "_begin", "_done").agg(*(side(c, n) for c in ("k0", "k1", "_length") for n in (0, 1)))
    high, low = _leading("k0_0", "k0_1"), _leading("k1_0", "k1_1")
    rest = F.when(high < 8, high).when(low < 8, 8 + low).otherwise(F.least("_length_0", "_length_1"))
    # behind the end of the text there is no suffix and nothing in common
    found = F.col("_done") + F.when(F.col("k0_0").isNull() | F.col("k0_1").isNull(), 0).otherwise(rest)
    return known.unionByName(by_text).unionByName(both.select("seq_ord", "rank", F.col("_begin").alias("pos"), found.cast("bigint").alias("lcp")))


def lcp_plateaus(source: DataFrame | Index, min_period: int = 10, max_period: int = 1000) -> DataFrame:
    """(seq_ord, threshold, first_rank, last_rank): maximal ranges of ranks whose LCP reaches the sequence's threshold.

    The threshold is 20, or the greatest LCP or ``max_period`` if less, but at least ``min_period``; sequences whose
    greatest LCP is below ``min_period`` have none. Ranges are found in blocks of ranks and joined where they meet.
    """
    lcp = checkpointed(lcp_array(source).where(F.col("lcp") >= min_period).select("seq_ord", "rank", "lcp"))
    most = lcp.groupBy("seq_ord").agg(F.max("lcp").alias("_most"))
    level = F.greatest(F.lit(min_period), F.least(F.lit(max_period), F.col("_most"), F.lit(20))).cast("bigint")
    high = lcp.join(most, "seq_ord").withColumn("threshold", level).where(F.col("lcp") >= F.col("threshold")).withColumn("_block", _block())
    at = Window.partitionBy("seq_ord", "_block").orderBy("rank")
    parts = high.withColumn("_island", F.col("rank") - F.row_number().over(at)).groupBy("seq_ord", "threshold", "_block", "_island").agg(F.min("rank").alias("first_rank"), F.max("rank").alias("last_rank"))
    edge = (F.col("first_rank") % _BLOCK == 0) | ((F.col("last_rank") + 1) % _BLOCK == 0)
    along = Window.partitionBy("seq_ord").orderBy("first_rank")  # at most two for each block
    joined = (
        parts.where(edge)
        .withColumn("_chain", F.when(F.lag("last_rank").over(along) + 1 == F.col("first_rank"), 0).otherwise(1))
        .withColumn("_chain", F.sum("_chain").over(along))
        .groupBy("seq_ord", "threshold", "_chain")
        .agg(F.min("first_rank").alias("first_rank"), F.max("last_rank").alias("last_rank"))
    )
    return parts.where(~edge).select("seq_ord", "threshold", "first_rank", "last_rank").unionByName(joined.drop("_chain"))


def plateau_progressions(seqs: DataFrame, min_period: int = 10, max_period: int = 1000, min_copies: int = 2, index: Index | None = None) -> DataFrame:
    """(seq_ord, start, end, motif, copies, length): neighbours in position within one plateau, a threshold apart.

    Every position from which ``min_copies`` or more such steps follow gives a row, nested ones too. Neighbours that
    share their first ``threshold`` characters repeat them exactly, so a check of similarity would always hold. The
    rank before a plateau shares its prefix but does not belong to it. Motifs are read from the text, whatever their length.
    """
    index = index or build(seqs)
    plateaus = lcp_plateaus(index, min_period, max_period)
    places = plateaus.select("seq_ord", "threshold", "first_rank", F.explode(F.sequence("first_rank", "last_rank")).alias("rank")).join(index.table.select("seq_ord", "rank", "pos"), ["seq_ord", "rank"])
    by_pos = Window.partitionBy("seq_ord", "first_rank").orderBy("pos")
    steps = places.withColumn("_new", F.when(F.col("pos") - F.lag("pos").over(by_pos) == F.col("threshold"), 0).otherwise(1)).withColumn("_island", F.sum("_new").over(by_pos))
    following = F.row_number().over(Window.partitionBy("seq_ord", "first_rank", "_island").orderBy(F.desc("pos")))
    found = steps.withColumn("copies", following.cast("bigint")).where(F.col("copies") >= min_copies).withColumn("base", F.floor(F.col("pos") / CHUNK) * CHUNK)
    longest = max(min_period, min(max_period, 20))  # no threshold is above it
    text = chunks(indexed_text(seqs), longest, max(CHUNK, longest)).select("seq_ord", "base", "chunk")
    length = F.col("copies") * F.col("threshold")
    motif = F.substring("chunk", (F.col("pos") - F.col("base") + 1).cast("int"), F.col("threshold").cast("int"))
    return found.join(text, ["seq_ord", "base"]).select("seq_ord", F.col("pos").alias("start"), (F.col("pos") + length).alias("end"), motif.alias("motif"), F.col("copies").cast("double").alias("copies"), length.alias("length"))
