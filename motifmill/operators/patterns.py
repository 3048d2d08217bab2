"""Literal patterns in sequences: where each occurs, how often and behind what, for a table of patterns of any length.

Patterns are sent to the tasks, ``DICTIONARY`` at a time, and looked up in many sequences at once with NumPy: short ones
in tables, longer ones by hash at the places whose next characters begin a pattern. Sequences of up to ``CHUNK``
characters are finished where they are read, so their results are not shuffled; only those of chunks of longer ones are.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motifmill.operators.kmers import CHUNK, byte_symbols, chunks
from motifmill.session import shuffle_width, written

#: Patterns that are sent to the tasks at once (their text is held there); more are looked up one such part after another.
DICTIONARY = 1_000_000
_GROUP = 1 << 18  # characters that are searched at once
_TABLE = 1 << 22  # most words of one length in a table
_SEEDS = (12, 16, 24, 40, 64)  # lengths at which places that begin no pattern are dropped
_ODD = 0x9E3779B97F4A7C15


class _Filter:
    """Hashes that may be there, by their upper bits."""

    def __init__(self, hashes: np.ndarray):
        bits = min(max(10, (16 * len(hashes)).bit_length()), 24)
        self.shift = np.uint64(64 - bits)
        self.there = np.zeros(1 << bits, dtype=bool)
        self.there[hashes >> self.shift] = True

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        return self.there[hashes >> self.shift]


class _Lookup:
    """Patterns by length, found in tables, or by hash and compared letter by letter."""

    def __init__(self, names: pa.Array):
        self.names, self.numbers = names, {}
        letters, patterns = {}, names.to_pylist()
        for i, p in enumerate(patterns):
            self.numbers.setdefault(len(p), []).append(i)
        for k in sorted(self.numbers):
            letters[k] = np.frombuffer("".join(patterns[i] for i in self.numbers[k]).encode("latin-1", "replace"), dtype=np.uint8).reshape(-1, k)
            self.numbers[k] = np.array(self.numbers[k])
        used = np.unique(np.concatenate([np.unique(x) for x in letters.values()])) if letters else np.zeros(0, dtype=np.uint8)
        self.symbol, self.symbols = np.zeros(256, dtype=np.int32), byte_symbols(3)
        self.symbol[used] = np.arange(1, len(used) + 1)
        self.size, self.tables, self.later, self.powers = len(used) + 1, {}, [], np.ones(1, dtype=np.uint64)
        for k, own in letters.items():
            if self.size**k <= _TABLE and len(np.unique(word := self._words(own))) == len(own):
                self.tables[k] = np.full(self.size**k, -1, dtype=np.int32)
                self.tables[k][word] = np.arange(len(own))
        hashed = {k: own for k, own in letters.items() if k not in self.tables}
        self._grow(max(letters, default=0))
        for k in sorted({*hashed, *(s for s in _SEEDS if s < max(hashed, default=0))}):
            seed = _Filter(np.concatenate([self._hashes(own[:, :k]) for n, own in hashed.items() if n >= k])) if k in _SEEDS else None
            if k in hashed:
                hashes = self._hashes(hashed[k])
                order = np.argsort(hashes, kind="stable")
                self.later.append((k, seed, _Filter(hashes), hashes[order], hashed[k], order))
            else:
                self.later.append((k, seed, None, None, None, None))

    def _words(self, letters: np.ndarray) -> np.ndarray:
        return reduce(lambda w, j: w * self.size + self.symbol[letters[:, j]], range(letters.shape[1]), np.zeros(len(letters), dtype=np.int32))

    def _grow(self, n: int) -> None:
        """Powers of an odd number and of its inverse, up to ``n`` of them."""
        if len(self.powers) <= n:
            self.powers, self.inverse = (np.cumprod(np.append(np.uint64(1), np.full(n, x, dtype=np.uint64))) for x in (_ODD, pow(_ODD, -1, 1 << 64)))

    def _hashes(self, letters: np.ndarray) -> np.ndarray:
        return (self.symbols[letters] * self.powers[: letters.shape[1]]).sum(axis=1, dtype=np.uint64)

    def find(self, codes: np.ndarray, room: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(length, places, which pattern of this length) of all occurrences; each pattern comes in one of them.

        ``room``: how many characters a pattern that begins at a place may have.
        """
        n, word, symbols = len(codes), np.zeros(len(codes) + 1, dtype=np.int32), self.symbol[codes]
        for k in range(1, min(max(self.tables, default=0), n) + 1):
            word = word[: n - k + 1] * np.int32(self.size) + symbols[k - 1 :]
            if k in self.tables:
                which = self.tables[k][word]
                place = np.flatnonzero((which >= 0) & (room[: n - k + 1] >= k))
                if len(place):
                    yield k, place, which[place]
        if not self.later:
            return
        self._grow(n + 1)
        sums = np.append(np.uint64(0), np.cumsum(self.symbols[codes] * self.powers[:n]))
        at = np.flatnonzero(room >= self.later[0][0])
        for k, seed, ends, hashes, letters, order in self.later:
            at = at[room[at] >= k]
            if not len(at):
                return
            own = (sums[at + k] - sums[at]) * self.inverse[at]
            if seed:
                held = np.flatnonzero(seed(own))
                at, own = at[held], own[held]
            if ends is None:
                continue
            held = np.flatnonzero(ends(own))
            place, own = at[held], own[held]
            which = np.searchsorted(hashes, own)
            while True:  # more than one round only where two patterns have one hash
                held = np.flatnonzero(hashes[np.minimum(which, len(hashes) - 1)] == own)
                held = held[which[held] < len(hashes)]
                place, own, which = place[held], own[held], which[held]
                if not len(place):
                    break
                same = (codes[place[:, None] + np.arange(k)] == letters[order[which]]).all(axis=1)
                if same.any():
                    yield k, place[same], order[which[same]]
                place, own, which = place[~same], own[~same], which[~same] + 1


_LOOKUPS: dict[str, _Lookup] = {}


def lookup_of(token: str, names: pa.Array) -> _Lookup:
    """The lookup of these patterns, made once in a Python worker; the last two are held."""
    if token not in _LOOKUPS:
        while len(_LOOKUPS) > 1:
            _LOOKUPS.pop(next(iter(_LOOKUPS)))
        _LOOKUPS[token] = _Lookup(names)
    return _LOOKUPS[token]


@dataclass(frozen=True)
class Group:
    """Pieces of text in one row of bytes, with zeros between them: ``first`` and ``size`` of each, with its end mark;
    for each byte its ``piece`` and how much ``room`` there is in the text for what begins there."""

    owner: pa.Array
    base: np.ndarray
    left: list[str]
    codes: np.ndarray
    first: np.ndarray
    size: np.ndarray
    piece: np.ndarray
    room: np.ndarray


def groups(batches: Iterator[pa.RecordBatch], mark: str = "", gap: int = 0) -> Iterator[Group]:
    """Rows (seq_ord, base, body_len, left, chunk) a few at a time; nothing begins behind ``body_len``."""
    for batch in batches:
        owner, base, body = batch.column(0), batch.column(1).to_numpy(), batch.column(2).to_numpy()
        left, texts = batch.column(3).to_pylist(), batch.column(4).to_pylist()
        a = 0
        while a < len(texts):
            b, held = a + 1, len(texts[a])
            while b < len(texts) and held + len(texts[b]) <= _GROUP:
                held += len(texts[b])
                b += 1
            between = mark + "\0" * gap
            codes = np.frombuffer((between.join(texts[a:b]) + between).encode("latin-1", "replace"), dtype=np.uint8)
            length = np.array([len(t) for t in texts[a:b]])
            whole = length + len(between)
            first = np.cumsum(whole) - whole
            piece = np.repeat(np.arange(b - a), whole)
            at = np.arange(len(codes)) - first[piece]
            yield Group(owner.slice(a, b - a), base[a:b], left[a:b], codes, first, length + len(mark), piece, np.where(at < body[a:b][piece], length[piece] - at, 0))
            a = b


def _tally(keys: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The numbers below ``most`` that occur, and how often."""
    if most > 8 * len(keys) + 1024:
        return np.unique(keys, return_counts=True)
    n = np.bincount(keys, minlength=1)
    held = np.flatnonzero(n)
    return held, n[held]


def found_rows(lookup: _Lookup, group: Group, found: list[tuple[np.ndarray, ...]], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Rows (piece, pattern number, ...) as (seq_ord, motif, ...)."""
    if found:
        piece, number, *rest = (np.concatenate(x) for x in zip(*found))
        yield pa.RecordBatch.from_arrays([group.owner.take(pa.array(piece)), lookup.names.take(pa.array(number)), *map(pa.array, rest)], ["seq_ord", "motif", *names])


def _places(token: str, patterns: pa.Array):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = lookup_of(token, patterns)
        for group in groups(batches):
            for k, place, which in lookup.find(group.codes, group.room):
                piece = group.piece[place]
                yield from found_rows(lookup, group, [(piece, lookup.numbers[k][which], group.base[piece] + place - group.first[piece])], ["pos"])

    return run


def _counts(token: str, patterns: pa.Array):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = lookup_of(token, patterns)
        for group in groups(batches):
            found = []
            for k, place, which in lookup.find(group.codes, group.room):
                size = len(lookup.numbers[k])
                held, n = _tally(group.piece[place] * size + which, len(group.first) * size)
                found.append((held // size, lookup.numbers[k][held % size], n))
            yield from found_rows(lookup, group, found, ["n"])

    return run


def _befores(token: str, patterns: pa.Array):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = lookup_of(token, patterns)
        for group in groups(batches):
            before = np.append(np.uint8(0), group.codes[:-1])
            before[group.first] = np.frombuffer("".join(x or "$" for x in group.left).encode("latin-1", "replace"), dtype=np.uint8)
            letters = np.unique(before)
            symbol, chars = np.zeros(256, dtype=np.int64), pa.array([chr(x) for x in letters], pa.string())
            symbol[letters] = np.arange(len(letters))
            before, found = symbol[before], []
            for k, place, which in lookup.find(group.codes, group.room):
                size = len(lookup.numbers[k])
                held, n = _tally((group.piece[place] * size + which) * len(letters) + before[place], len(group.first) * size * len(letters))
                key, ch = np.divmod(held, len(letters))
                found.append((key // size, lookup.numbers[k][key % size], ch, n))
            for batch in found_rows(lookup, group, found, ["ch", "n"]):
                yield batch.set_column(2, "ch", chars.take(batch.column(2)))

    return run


def split(seqs: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """Sequences that one task can finish, and the others: longer than ``size``, or of a number that is there twice."""
    if seqs.groupBy("seq_ord").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1 or seq_ord is null").isEmpty():
        return seqs.where(F.col("n") <= size), seqs.where(F.col("n") > size)
    return seqs.where("false"), seqs


def whole_rows(seqs: DataFrame) -> DataFrame:
    """Whole sequences in the form of chunks, spread over all tasks."""
    rows = seqs.where("n > 0").select("seq_ord", F.lit(0).cast("bigint").alias("base"), F.col("n").alias("body_len"), F.lit("").alias("left"), F.col("seq").alias("chunk"))
    return rows.repartition(shuffle_width(seqs.sparkSession), "seq_ord")


def _chunked(seqs: DataFrame, longest: int) -> DataFrame:
    return chunks(seqs, longest, max(CHUNK, longest)).select("seq_ord", "base", "body_len", "left", "chunk")


def listed(motifs: DataFrame) -> list[pa.Array]:
    """The distinct patterns, in parts of about ``DICTIONARY``."""
    wanted = motifs.select("motif").where("motif != ''").distinct()
    text = lambda rows: rows.toArrow().column(0).combine_chunks().cast(pa.string())
    few = text(wanted.limit(DICTIONARY + 1))  # bounded by DICTIONARY
    if len(few) <= DICTIONARY:
        return [few]
    wanted = written(wanted)
    parts = -(-wanted.count() // DICTIONARY)
    return [text(wanted.where(F.pmod(F.xxhash64("motif"), F.lit(parts)) == i)) for i in range(parts)]


def looked_up(rows: DataFrame, parts: list[pa.Array], look: Callable, schema: str) -> DataFrame:
    """What ``look`` finds in ``rows``, of all parts of the patterns."""
    return reduce(DataFrame.unionByName, (rows.mapInArrow(look(uuid.uuid4().hex, part), schema) for part in parts))


def _longest(parts: list[pa.Array]) -> int:
    return max((len(p) for part in parts for p in part.to_pylist()), default=1)


def _summed(seqs: DataFrame, motifs: DataFrame, look: Callable, extra: list[str]) -> DataFrame:
    parts = listed(motifs)
    schema = ", ".join(["seq_ord bigint, motif string", *(f"{c} string" for c in extra), "n bigint"])
    whole, others = split(seqs, CHUNK)
    pieces = looked_up(_chunked(others, _longest(parts)), parts, look, schema)
    return looked_up(whole_rows(whole), parts, look, schema).unionByName(pieces.groupBy("seq_ord", "motif", *extra).agg(F.sum("n").alias("n")))


def motif_places(seqs: DataFrame, motifs: DataFrame) -> DataFrame:
    """(seq_ord, motif, pos) of every occurrence, overlapping ones too, of each distinct pattern in ``motifs.motif``.

    Null and empty patterns occur nowhere; no patterns or no sequences give an empty result.
    """
    parts = listed(motifs)
    return looked_up(_chunked(seqs, _longest(parts)), parts, _places, "seq_ord bigint, motif string, pos bigint")


def motif_counts(seqs: DataFrame, motifs: DataFrame) -> DataFrame:
    """(seq_ord, motif, n): occurrences, overlapping ones too, of each pattern that a sequence holds."""
    return _summed(seqs, motifs, _counts, [])


def preceding_characters(seqs: DataFrame, motifs: DataFrame) -> DataFrame:
    """(seq_ord, motif, ch, n): how often each character stands before a pattern, read off the texts; '$' is the start of a text."""
    return _summed(seqs, motifs, _befores, ["ch"])
