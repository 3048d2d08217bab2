"""Helpers for Arrow batches inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def changes(table: pa.Table, keys: list[str]) -> np.ndarray:
    """True at each row whose keys differ from those of the row before; the first row is True."""
    n = table.num_rows
    new = np.zeros(n, dtype=bool)
    if n:
        new[0] = True
    if n > 1:
        for k in keys:
            c = table.column(k).combine_chunks()
            new[1:] |= pc.fill_null(pc.not_equal(c[1:], c[:-1]), True).to_numpy(zero_copy_only=False)
    return new


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], at_least: int = 100_000) -> Iterator[pa.Table]:
    """Tables of whole groups out of batches that come sorted by ``keys``, each of about ``at_least`` rows.

    Only the last, perhaps unfinished group is carried over, so memory holds ``at_least`` rows and one group.
    """
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if batch.num_rows == 0:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows >= at_least:
            table = pa.Table.from_batches(held)
            starts = np.flatnonzero(changes(table, keys))
            if len(starts) > 1:
                cut = int(starts[-1])
                yield table.slice(0, cut)
                held = table.slice(cut).to_batches()
                rows = table.num_rows - cut
    if held:
        yield pa.Table.from_batches(held)
