"""Vectorised word work on Arrow text batches (numpy inside Spark tasks).

Words are the runs of ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z. Both the
separators and the letters are ASCII, so the work runs on UTF-8 bytes: no
Python object is made per word. A word is known by a 64-bit hash: a polynomial
over a fixed random byte table, finished with a mixing step.

Texts are handled in slices of at most ``SLICE`` bytes (a longer text is a
slice of its own), so memory follows the slice and not the Arrow batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE = 1 << 19
_BASE = 0x9E3779B97F4A7C55  # odd: invertible modulo 2^64


def returning_memory(run):
    """A batch function that, when its task's rows are done, returns freed memory to
    the system: Python workers live on between stages and would keep it."""
    def whole(batches):
        import ctypes
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        libc = ctypes.CDLL(None)
        if hasattr(libc, "malloc_trim"):
            libc.malloc_trim(0)

    return whole


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift-multiply rounds)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Hasher:
    """Polynomial hashes of runs of symbols, from one cumulative sum per slice.

    Made inside a task (its tables are not worth sending)."""

    def __init__(self):
        self.byte = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
        self.byte[65:91] = self.byte[97:123]  # A-Z count as a-z
        self.sep = np.zeros(256, bool)
        self.sep[[0x20, 9, 10, 11, 12, 13]] = True
        self.p = self.q = np.zeros(0, np.uint64)

    def runs(self, values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """64-bit hash of each run ``values[start:end]`` of 64-bit symbol values."""
        n = len(values)
        if len(self.p) < n + 1:
            m = max(n, SLICE) + 1
            self.p, self.q = np.full(m, _BASE, np.uint64), np.full(m, pow(_BASE, -1, 1 << 64), np.uint64)
            self.p[0] = self.q[0] = 1
            np.cumprod(self.p, out=self.p)
            np.cumprod(self.q, out=self.q)
        acc = np.empty(n + 1, np.uint64)
        acc[0] = 0
        np.cumsum(values * self.p[:n], out=acc[1:])
        return mix64((acc[end] - acc[start]) * self.q[start] + (end - start).astype(np.uint64))

    def words(self, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Words of consecutive texts: ``(start, end, hash, first word of each text)``.

        ``start``/``end`` are byte places in ``raw``; the last array has one entry
        per text plus the end, like Arrow offsets."""
        n = len(raw)
        if not n:
            z = np.zeros(0, np.int64)
            return z, z, np.zeros(0, np.uint64), np.zeros(len(off), np.int64)
        inside = ~self.sep[raw]
        starts, ends = inside.copy(), inside.copy()
        starts[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        cut = off[1:-1]  # a text starts a word even right after the last text's word
        cut = cut[(cut > 0) & (cut < n)]
        starts[cut] = inside[cut]
        ends[cut - 1] = inside[cut - 1]
        s, e = np.flatnonzero(starts), np.flatnonzero(ends) + 1
        return s, e, self.runs(self.byte[raw], s, e), np.searchsorted(s, off)

    def word_hashes(self, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(hash of every word, first word of each text)``; a long text is cut at
        separators, so only its word hashes are held at once."""
        if len(off) > 2 or len(raw) <= 2 * SLICE:
            _, _, h, first = self.words(raw, off)
            return h, first
        parts, at = [], 0
        while at < len(raw):
            end = at + SLICE
            while end < len(raw) and not self.sep[raw[end]]:
                near = np.flatnonzero(self.sep[raw[end:end + 4096]])
                end = end + int(near[0]) if len(near) else end + 4096
            end = min(end, len(raw))
            parts.append(self.words(raw[at:end], np.array([0, end - at]))[2])
            at = end
        h = np.concatenate(parts)
        return h, np.array([0, len(h)])


def text_slices(col: pa.Array, size: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(first row, end row, bytes, row offsets into those bytes)`` for runs of
    rows of about ``size`` bytes. Null texts are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if not len(col):
        return
    if col.null_count:
        col = col.fill_null("")
    wide = pa.types.is_large_string(col.type)
    _, off, data = col.buffers()
    off = np.frombuffer(off, np.int64 if wide else np.int32)[col.offset:col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(col):
        j = max(i + 1, int(np.searchsorted(off, off[i] + size, "right")) - 1)
        j = min(j, len(col))
        yield i, j, raw[off[i]:off[j]], off[i:j + 1] - off[i]
        i = j
