"""Whole-batch word and hash primitives on Arrow string columns (numpy, no per-word Python).

A word is ``[^\\x20\\x09-\\x0D]+``, unchanged. Texts are handled in slices of about 1 MB,
so memory follows the slice (or one very long text), not the batch or the partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_P = 0x5851F42D4C957F2D | 1  # odd, so it has an inverse modulo 2**64
_WS = np.zeros(256, bool)
_WS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser: spreads every input bit over the output."""
    x = x ^ (x >> np.uint64(33))
    x = x * _M1
    x = x ^ (x >> np.uint64(33))
    x = x * _M2
    return x ^ (x >> np.uint64(33))


def stream(x: np.ndarray, t: int) -> np.ndarray:
    """The t-th pseudo-random 64-bit number of each seed in ``x``."""
    with np.errstate(over="ignore"):
        return mix(x + _GOLD * np.uint64(t + 1))


_BYTE = stream(np.arange(256, dtype=np.uint64), 7)
_POW: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _POW.get("p")
    if have is None or len(have) < n:
        size = max(n, SLICE_BYTES + 1)
        with np.errstate(over="ignore"):
            for key, base in (("p", _P), ("q", pow(_P, -1, 1 << 64))):
                a = np.full(size, np.uint64(base))
                a[0] = 1
                _POW[key] = np.multiply.accumulate(a)
    return _POW["p"], _POW["q"]


def utf8(col) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (from 0) of a string column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = pc.fill_null(col.cast(pa.large_string()), "")
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, np.int64)[col.offset:col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    raw = raw[offsets[0]:offsets[-1]]
    return raw, offsets - offsets[0]


def slices(col, max_bytes: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of texts of at most ``max_bytes``, or one text."""
    raw, off = utf8(col)
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + max_bytes, "right")) - 1)
        yield i, j, raw[off[i]:off[j]], off[i:j + 1] - off[i]
        i = j


class Words:
    """Spans of all words of a slice; the words of text d are ``first[d]:first[d + 1]``."""

    def __init__(self, raw: np.ndarray, off: np.ndarray, separators: np.ndarray = _WS):
        n = len(raw)
        ink = ~separators[raw]
        edge = np.zeros(n + 1, bool)
        edge[off] = True  # a word never runs over the end of a text
        if n:
            left = np.empty(n, bool)
            left[0] = True
            np.logical_not(ink[:-1], out=left[1:])
            right = np.empty(n, bool)
            right[-1] = True
            np.logical_not(ink[1:], out=right[:-1])
            self.start = np.flatnonzero(ink & (left | edge[:-1]))
            self.end = np.flatnonzero(ink & (right | edge[1:])) + 1
        else:
            self.start = self.end = np.zeros(0, np.int64)
        self.raw, self.off = raw, off
        self.first = np.searchsorted(self.start, off)
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(off) - 1), self.count)

    def hashes(self, table: np.ndarray = _BYTE) -> np.ndarray:
        """A 64-bit hash of each word's bytes, each first mapped by ``table``."""
        return span_hashes(table[self.raw], self.start, self.end)


def span_hashes(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the spans of a sequence of 64-bit values, from one prefix sum."""
    p, q = _powers(len(values) + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * p[:len(values)], out=total[1:])
        span = (total[end] - total[start]) * q[start]
        return mix(span + (end - start).astype(np.uint64) * _GOLD)


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of h[i:i+k] for each i up to len(h) - k; empty if there are fewer values."""
    m = len(h) - k + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        out = h[:m].copy()
        for i in range(1, k):
            out *= np.uint64(_P)
            out += h[i:i + m]
        return mix(out)


def inside(first: np.ndarray, k: int) -> np.ndarray:
    """Which k-grams of the joined words lie in one text, as a mask over ``grams(h, k)``."""
    total = int(first[-1])
    ok = np.ones(max(0, total - k + 1), bool)
    for e in range(1, k):  # grams that start in the last k - 1 words of a text cross its end
        at = first[1:-1] - e
        at = at[(at >= 0) & (at < len(ok))]
        ok[at] = False
    return ok
