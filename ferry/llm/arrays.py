"""Whole texts of an Arrow column as one byte array, and words and shingles in it.

White space and A-Z are single bytes in UTF-8 and never part of another character,
so words can be cut and lower-cased on the bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Bytes of text handled at a time; a longer text is handled alone, whole.
BLOCK = 1 << 21
#: Bytes hashed at a time, so that their numbers stay in a processor's cache.
PIECE = 1 << 15

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True

_U = np.uint64
_BASE, _INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)


def blocks(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) for runs of rows. Null texts are empty."""
    column = column.cast(pa.large_string()).fill_null("")
    if len(column) == 0:
        return
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + BLOCK, side="right")) - 1)
        yield lo, hi, raw[ends[lo] : ends[hi]], ends[lo : hi + 1] - ends[lo]
        lo = hi


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values (the finishing steps of splitmix64)."""
    h = h ^ (h >> _U(30))
    h = h * _U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> _U(27))
    h = h * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


@lru_cache(maxsize=1)
def _both_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers(_BASE, n), _powers(_INVERSE, n)


class Words:
    """Words between white space, A-Z in lower case: where they are and their hashes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data = LOWER[data]
        inside = ~SPACE[data]
        first = np.zeros(len(data) + 1, dtype=bool)
        first[offsets] = True
        before = np.concatenate(([False], inside[:-1])) if len(data) else inside
        self.start = np.flatnonzero(inside & (~before | first[:-1]))
        after = np.concatenate((inside[1:], [False])) if len(data) else inside
        self.end = np.flatnonzero(inside & (~after | first[1:])) + 1
        #: Words of document d are those from at[d] up to at[d + 1].
        self.at = np.searchsorted(self.start, offsets)

    def hashes(self) -> np.ndarray:
        """One 64-bit hash per word, from a running sum over the bytes of a piece. Pieces are
        cut between words; a longer word is a piece of its own."""
        out = np.empty(len(self.start), dtype=np.uint64)
        lo = 0
        while lo < len(out):
            first = self.start[lo]
            hi = max(lo + 1, int(np.searchsorted(self.end, first + PIECE, side="right")))
            start, end = self.start[lo:hi] - first, self.end[lo:hi] - first
            n = int(end[-1])
            up, down = _both_powers(PIECE) if n <= PIECE else (_powers(_BASE, n), _powers(_INVERSE, 1))
            value = self.data[first : first + n].astype(np.uint64)
            value += _U(1)
            value *= up[:n]
            total = np.zeros(n + 1, dtype=np.uint64)
            np.cumsum(value, out=total[1:])
            out[lo:hi] = mixed((total[end] - total[start]) * down[start])
            lo = hi
        return out

    def shingles(self, width: int) -> Iterator[np.ndarray]:
        """Sorted distinct shingle hashes of every document; fewer words make one shingle."""
        h = self.hashes()
        rolled = np.zeros(max(len(h) - width + 1, 0), dtype=np.uint64)
        factor = 1
        for k in range(width):
            factor = factor * 0xD6E8FEB86659FD93 % (1 << 64)
            rolled += h[k : k + len(rolled)] * _U(factor)
        rolled = mixed(rolled + _U(width))
        for lo, hi in zip(self.at[:-1], self.at[1:], strict=True):
            if hi - lo >= width:
                yield np.unique(rolled[lo : hi - width + 1])
            elif hi == lo:
                yield rolled[:0]
            else:
                whole = 0
                for x in h[lo:hi].tolist():
                    whole = (whole * 0xD6E8FEB86659FD93 + x) % (1 << 64)
                yield mixed(np.array([(whole + int(hi - lo)) % (1 << 64)], dtype=np.uint64))
