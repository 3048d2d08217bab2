"""Maximal runs of a period: where a sequence repeats itself at a distance.

``s[i] = s[i + p]`` holds on maximal ranges [a, z) of i; such a range means that [a, z + p) has period p. Both exact
detectors read these runs. They are found chunk by chunk with vector compares; only runs that touch a chunk's
border are stitched together, so a long sequence is spread over tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from motifmill.operators.kmers import CHUNK, chunks

_SCHEMA = "seq_ord bigint, n bigint, p int, a bigint, z bigint, seed string, following int, open_left boolean, open_right boolean"


def _true_ranges(same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], same.view(np.int8), [0]])))
    return edges[::2], edges[1::2]


def _find(min_period: int, max_period: int, cap: bool, forbidden: bytes, min_length: int):
    bad = np.zeros(256, dtype=bool)
    bad[list(forbidden)] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers: list[tuple[np.ndarray, ...]] = []
            seeds: list[str] = []
            for owner, n, base, body, text in zip(*(batch.column(i).to_pylist() for i in range(5))):
                codes = np.frombuffer(text.encode("latin-1", "replace"), dtype=np.uint8)
                good = ~bad[codes]
                for p in range(min_period, min(max_period, max(1, n // 2) if cap else max_period) + 1):
                    m = min(body, len(codes) - p)
                    if m <= 0:
                        break
                    begin, end = _true_ranges((codes[:m] == codes[p : p + m]) & good[:m])
                    left, right = (begin == 0) & (base > 0), (end == body) & (base + body < n)
                    keep = np.flatnonzero(((end - begin) >= max(p, min_length - p)) | left | right)
                    if not len(keep):
                        continue
                    begin, end = begin[keep], end[keep]
                    units = codes[begin[:, None] + np.arange(p)].view(f"S{p}").ravel()
                    seeds += [u.decode("latin-1") for u in units.tolist()]
                    after = np.append(codes, 0)[np.minimum(end + p, len(codes))].astype(np.int64)
                    numbers.append((*(np.full(len(keep), v, dtype=np.int64) for v in (owner, n, p)), base + begin, base + end, after, left[keep], right[keep]))
            owner, n, p, a, z, after, left, right = (np.concatenate(c) for c in zip(*numbers)) if numbers else (np.zeros(0, dtype=np.int64),) * 8
            yield pa.RecordBatch.from_arrays(
                [*map(pa.array, (owner, n)), pa.array(p.astype(np.int32)), *map(pa.array, (a, z)), pa.array(seeds, pa.string()), pa.array(after.astype(np.int32)), *(pa.array(x.astype(bool)) for x in (left, right))],
                names=["seq_ord", "n", "p", "a", "z", "seed", "following", "open_left", "open_right"],
            )

    return run


def period_runs(seqs: DataFrame, min_period: int, max_period: int, forbidden: str = "", cap_by_length: bool = False, chunk: int = CHUNK, min_length: int = 0) -> DataFrame:
    """(seq_ord, n, p, a, z, seed, following): maximal ranges [a, z), at least p long, with s[i] = s[i + p].

    ``seed`` is the first unit s[a : a + p], ``following`` the code of the character s[z + p] that ends the period (0 at
    the end of the text). With ``min_length`` only ranges whose text [a, z + p) is that long are given. Positions with a ``forbidden`` character never match. With
    ``cap_by_length`` periods beyond half a sequence (at least 1) are not looked at. Sequences without a run,
    empty ones among them, give no row. Text is taken as one byte a character.
    """
    found = chunks(seqs, max_period + 1, max(chunk, max_period + 1)).select("seq_ord", "n", "base", "body_len", "chunk").mapInArrow(_find(min_period, max_period, cap_by_length, forbidden.encode(), min_length), _SCHEMA)
    at = Window.partitionBy("seq_ord", "p").orderBy("a")
    whole = found.where("not open_left and not open_right")
    stitched = (
        found.where("open_left or open_right")
        .withColumn("_new", F.when(F.lag("z").over(at) == F.col("a"), 0).otherwise(1))
        .withColumn("_run", F.sum("_new").over(at))
        .groupBy("seq_ord", "n", "p", "_run")
        .agg(F.min("a").alias("a"), F.max("z").alias("z"), F.min_by("seed", "a").alias("seed"), F.max_by("following", "z").alias("following"))
        .where(F.col("z") - F.col("a") >= F.greatest(F.col("p"), min_length - F.col("p")))
    )
    columns = ["seq_ord", "n", "p", "a", "z", "seed", "following"]
    return whole.select(*columns).unionByName(stitched.select(*columns))
