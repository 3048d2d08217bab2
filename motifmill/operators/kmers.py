"""Sequences as chunks, k-mers and k-mer fingerprints."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motifmill.session import shuffle_width

CHUNK = 1 << 16
_CUT = 1 << 23  # characters of chunks that leave a task in one batch
_BASE = 0x9E3779B97F4A7C15


def kmer_hashes(values: np.ndarray, k: int, base: int = _BASE) -> np.ndarray:
    """64-bit hash of every k-mer along the last axis of ``values`` (uint64, one random number a symbol).

    Made by doubling: the hash of length a + b is made of those of lengths a and b.
    """
    size = values.shape[-1]
    if size < k:
        return np.zeros((*values.shape[:-1], 0), dtype=np.uint64)
    whole, done, part, length, bits = None, 0, values, 1, k
    while True:
        if bits & 1:
            if whole is None:
                whole, done = part, length
            else:
                m = size - done - length + 1
                whole = whole[..., :m] * np.uint64(pow(base, length, 1 << 64)) + part[..., done : done + m]
                done += length
        bits >>= 1
        if not bits:
            break
        m = part.shape[-1] - length
        part = part[..., :m] * np.uint64(pow(base, length, 1 << 64)) + part[..., length : length + m]
        length *= 2
    h = whole[..., : size - k + 1].copy()
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def sequences(df: DataFrame, seq: str = "seq", keep: tuple[str, ...] = ("seq_ord", "chrom")) -> DataFrame:
    """Records as sequences: upper case, with their length ``n``; null sequences are empty ones."""
    text = F.coalesce(F.upper(F.col(seq)), F.lit(""))
    return df.select(*keep, text.alias("seq"), F.length(text).alias("n"))


def _cut(size: int, halo: int, keep: list[str]):
    columns = [*keep, "n", "base", "body_len", "left", "chunk"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, parts, held = [], [], 0

            def made() -> pa.RecordBatch:
                same = batch.select([*keep, "n"]).take(pa.array(of, pa.int64()))
                rest = zip(*parts) if parts else [()] * 4
                return pa.RecordBatch.from_arrays([*same.columns, *(pa.array(c, t) for c, t in zip(rest, (pa.int64(), pa.int32(), pa.string(), pa.string())))], columns)

            for i, text in enumerate(batch.column(len(keep) + 1).to_pylist()):
                for base in range(0, len(text), size):
                    chunk = text[base : base + size + halo]
                    of.append(i)
                    parts.append((base, min(size, len(text) - base), text[base - 1 : base] if base else "", chunk))
                    held += len(chunk)
                    if held >= _CUT:
                        yield made()
                        of, parts, held = [], [], 0
            yield made()

    return run


def chunks(seqs: DataFrame, halo: int, size: int = CHUNK, keep: tuple[str, ...] = ("seq_ord",), spread: bool = True) -> DataFrame:
    """(keep..., n, base, body_len, left, chunk): pieces of ``size`` characters with the next ``halo`` ones.

    ``left`` is the character before the piece, '' at the start. A record of any length is cut in linear time, and
    later offsets are within a chunk. Empty records have no chunk. With ``spread`` the pieces go to all tasks by
    their place, so that neither few input files nor one long record holds the work up.
    """
    rows = seqs.where("n > 0").select(*keep, "n", "seq")
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]]
    cut = rows.mapInArrow(_cut(size, halo, list(keep)), ", ".join([*fields, "base bigint, body_len int, left string, chunk string"]))
    # a given number, as adaptive execution would merge small but costly partitions again
    return cut.repartition(shuffle_width(seqs.sparkSession), *keep, "base") if spread else cut


def kmers(seqs: DataFrame, k_from: int, k_to: int, size: int = 256, keep: tuple[str, ...] = ("seq_ord",)) -> DataFrame:
    """(keep..., pos, k, kmer): every k-mer of every length from ``k_from`` to ``k_to``."""
    rows = chunks(seqs, k_to, size, keep)
    return (
        rows.select(*keep, "base", "chunk", F.explode(F.sequence(F.lit(0), F.col("body_len") - 1)).alias("_at"))
        .select(*keep, (F.col("base") + F.col("_at")).alias("pos"), F.substring("chunk", F.col("_at") + 1, F.lit(k_to)).alias("_word"))
        .select(*keep, "pos", "_word", F.explode(F.sequence(F.lit(k_from), F.lit(k_to))).alias("k"))
        .where(F.length("_word") >= F.col("k"))
        .select(*keep, "pos", "k", F.left("_word", F.col("k")).alias("kmer"))
    )


def byte_symbols(seed: int) -> np.ndarray:
    """One random odd number for each byte."""
    return np.random.default_rng(seed).integers(1, 1 << 63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def fingerprints(text: bytes, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of every k-mer of ASCII text."""
    codes = np.frombuffer(text, dtype=np.uint8)
    return tuple(kmer_hashes(byte_symbols(seed)[codes], k, base).view(np.int64) for seed, base in ((1, _BASE), (2, 0xD6E8FEB86659FD93)))


def kmer_fingerprints(seqs: DataFrame, k: int, key: str = "seq_ord") -> DataFrame:
    """(key, pos, h1, h2): a 128-bit fingerprint of every k-mer, made chunk by chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for owner, base, body, text in zip(*(batch.column(i).to_pylist() for i in range(4))):
                h1, h2 = (h[:body] for h in fingerprints(text.encode("latin-1", "replace"), k))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h1), owner, dtype=np.int64)), pa.array(base + np.arange(len(h1))), pa.array(h1), pa.array(h2)], [key, "pos", "h1", "h2"])

    return chunks(seqs, k - 1, keep=(key,)).select(key, "base", "body_len", "chunk").mapInArrow(run, f"{key} bigint, pos bigint, h1 bigint, h2 bigint")
