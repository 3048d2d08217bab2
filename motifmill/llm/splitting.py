"""Splitting oversized sequences into pieces under a limit, cut inside assembly gaps where that can be done.

Cuts lie in gaps; only a stretch between gaps that is longer than a piece gets forced cuts, as few as its length
asks for. Under these terms the least number of pieces is computed first, by going as far as the limit allows
with each cut. That tells how many cuts there are and how far right each may lie; the same from the end tells how
far left. Equal-length targets are then moved to the strongest gap near by within those bounds, so no limit can fail
afterwards and no piece need be added. All steps go once along the gaps.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class _Gaps:
    """Gaps of a text in order; both of their ends are places to cut."""

    def __init__(self, spans: list[tuple[int, int]]):
        self.starts, self.ends = [s for s, _ in spans], [e for _, e in spans]

    def last(self, place: int) -> int:
        """The last place in a gap that is not behind ``place``; 0 if there is none."""
        i = bisect_right(self.starts, place) - 1
        return min(self.ends[i], place) if i >= 0 else 0

    def first(self, place: int) -> int | None:
        """The first place in a gap that is not before ``place``."""
        i = bisect_left(self.ends, place)
        return max(self.starts[i], place) if i < len(self.starts) else None

    def strongest(self, low: int, high: int, target: float) -> int | None:
        """The place nearest to ``target`` in the longest gap that has one within [low, high]."""
        best = None
        i = bisect_left(self.ends, low)
        while low <= high and i < len(self.starts) and self.starts[i] <= high:
            place = int(min(max(target, self.starts[i], low), self.ends[i], high))
            found = (self.ends[i] - self.starts[i], -abs(place - target), place)
            best = found if best is None else max(best, found)
            i += 1
        return best and best[2]


def _farthest(n: int, gaps: _Gaps, long: list[tuple[int, int, int]], own: int) -> list[tuple[int, int]]:
    """(place, stretch) of each cut, as far right as possible: in the numbered long stretch, or in a gap where that is -1.

    ``long`` has (begin, end, forced cuts) of the stretches that no two gap cuts can span.
    """
    cuts, at, i = [], 0, 0
    while i < len(long) or n - at > own:
        if i < len(long):
            begin, end, forced = long[i]
            if at + (forced + 1) * own >= end:
                cuts += [(min(at + (j + 1) * own, end - 1), i) for j in range(forced)]
                i += 1
            else:
                cuts.append((gaps.last(min(at + own, begin)), -1))
        else:
            cuts.append((gaps.last(at + own), -1))
        at = cuts[-1][0]
    return cuts


def cuts(text: str, max_size: int, overlap: int, gap: re.Pattern) -> list[tuple[int, str]]:
    """(position, 'gap' or 'forced') of each cut. Between two cuts lie at most ``max_size - overlap`` characters."""
    n, own = len(text), max_size - overlap
    if n <= max_size:
        return []
    spans = [m.span() for m in gap.finditer(text)]
    gaps = _Gaps(spans)
    edges = [(0, 0), *spans, (n, n)]
    long = [(a[1], b[0], -(-(b[0] - a[1]) // own) - 1) for a, b in zip(edges, edges[1:]) if b[0] - a[1] > own]
    farthest = _farthest(n, gaps, long, own)
    nearest, following = [0] * len(farthest), n
    for j in range(len(farthest) - 1, -1, -1):
        place, stretch = farthest[j]
        own_zone = max((long[s][1] for _, s in farthest[max(0, j - 1) : j] if s >= 0), default=1)
        nearest[j] = max(following - own, long[stretch][0] + 1) if stretch >= 0 else gaps.first(max(following - own, own_zone))
        following = nearest[j]
    found, at = [], 0
    for j, (place, stretch) in enumerate(farthest):
        step = (n - at) / (len(farthest) - j + 1)
        target = at + step
        low, high = max(nearest[j], at + 1), min(place, at + own)
        if j == 0 and overlap < high and (stretch >= 0 or gaps.last(high) > overlap):
            low = max(low, overlap + 1)  # else the first piece would lie inside the second
        if stretch >= 0:
            at = int(min(max(target, low), high))
        else:
            near = gaps.strongest(max(low, int(target - step / 4)), min(high, int(target + step / 4)), target)
            if near is None:
                aim = min(high, max(low, int(target)))
                near = min((p for p in (gaps.last(aim), gaps.first(aim)) if p is not None and low <= p <= high), key=lambda p: abs(p - target))
            at = near
        found.append((at, "gap" if stretch < 0 else "forced"))
    return found


def _pieces(max_size: int, overlap: int, min_gap: int, with_text: bool):
    gap = re.compile(rf"[Nn]{{{min_gap},}}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {"record": [], "piece_no": [], "piece_start": [], "piece_end": [], "cut_kind": [], "piece": []}
            for record, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ends = [*cuts(text, max_size, overlap, gap), (len(text), "end")]
                if len(ends) > 1 and ends[0][0] <= overlap:
                    ends = ends[1:]  # the second piece begins at 0 too and holds the first
                begin = 0
                for no, (cut, kind) in enumerate(ends):
                    for name, value in zip(out, (record, no, begin, cut, kind, text[begin:cut] if with_text else None)):
                        out[name].append(value)
                    begin = max(0, cut - overlap)
            yield pa.RecordBatch.from_arrays([pa.array(out["record"], pa.int64()), pa.array(out["piece_no"], pa.int32()), *(pa.array(out[c], pa.int64()) for c in ("piece_start", "piece_end")), *(pa.array(out[c], pa.string()) for c in ("cut_kind", "piece"))], list(out))

    return run


def split_records(df: DataFrame, record: str, text: str, max_size: int, overlap: int, min_gap: int = 10, with_text: bool = True) -> DataFrame:
    """(record, piece_no, piece_start, piece_end, cut_kind, piece): pieces of at most ``max_size`` characters.

    Consecutive pieces overlap by ``overlap`` characters, and none lies inside another.
    ``cut_kind`` tells what ends the piece: a 'gap' of ``min_gap`` or more N, 'forced' where none is within
    reach, or the 'end'. Texts within the limit come out as one piece; null texts not at all.
    """
    rows = df.where(F.col(text).isNotNull()).select(F.col(record).cast("bigint").alias("record"), F.col(text).alias("text"))
    return rows.mapInArrow(_pieces(max_size, overlap, min_gap, with_text), "record bigint, piece_no int, piece_start bigint, piece_end bigint, cut_kind string, piece string")
