"""Anchors for long exact matches: winnowed k-mers of many texts at a time (NumPy)."""

from __future__ import annotations

import numpy as np

from motifmill.operators.kmers import kmer_hashes

_CHUNK = 1 << 16
_POS_BITS = np.uint64(22)
#: 2-bit codes of the four bases; every other character ends a stretch.
_CODE = np.full(256, 4, dtype=np.uint8)
for _i, _c in enumerate(b"ACGT"):
    _CODE[_c] = _CODE[_c + 32] = _i
_SYMBOL = np.random.default_rng(20).integers(1, 1 << 63, size=5, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    size, out = 1, values
    while size * 2 <= width:
        out = np.minimum(out[: len(out) - size], out[size:])
        size *= 2
    rest = width - size
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def window_fingerprints(codes: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of every stretch of ``span`` bases along the rows of 2-bit ``codes``."""
    return tuple(kmer_hashes(_SYMBOL[codes] * np.uint64(odd), span, base).view(np.int64) for odd, base in ((1, 0x9E3779B97F4A7C15), (0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)))


def concatenated(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of texts one behind the other, an unclean character between any two, and where each begins."""
    starts = np.cumsum([0, *(len(t) + 1 for t in texts)])[: len(texts)]
    return _CODE[np.frombuffer(b"\n".join(texts), dtype=np.uint8)], starts.astype(np.int64)


def anchors(codes: np.ndarray, span: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the k-mers that winnowing selects.

    Any stretch of ``span`` bases, all of them A, C, G or T in either case, holds a selected k-mer, and equal
    stretches select k-mers at equal places: the leftmost least hash of the stretch's k-mers. ``codes`` may be
    those of many texts, so that short ones cost no more than long ones.
    """
    width = span - k + 1
    positions, hashes = [], []
    for at in range(0, max(len(codes) - span + 1, 0), _CHUNK):
        part = codes[at : at + _CHUNK + span - 1]
        bad = np.concatenate([[0], np.cumsum(part == 4, dtype=np.int32)])
        clean = bad[span:] == bad[:-span]
        if not clean.any():
            continue
        h = kmer_hashes(_SYMBOL[part], k)
        keyed = (h & ~np.uint64((1 << int(_POS_BITS)) - 1)) | np.arange(len(h), dtype=np.uint64)
        chosen = (sliding_min(keyed, width)[clean] & np.uint64((1 << int(_POS_BITS)) - 1)).astype(np.int64)
        chosen = chosen[np.append(True, chosen[1:] != chosen[:-1])]  # a sliding leftmost minimum never goes back
        positions.append(chosen + at)
        hashes.append(h[chosen])
    if not positions:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    pos, first = np.unique(np.concatenate(positions), return_index=True)
    return pos, np.concatenate(hashes)[first]
