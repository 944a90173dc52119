"""Vectorised byte-level views of text columns: words, rolling hashes, window minima.

Hashes are polynomials over random byte values modulo 2**64, so the hash of
any stretch is the difference of two prefix values, scaled back to position 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Texts are worked on in slices of about this many bytes, or one text if longer.
SLICE = 1 << 19

BLANK = np.zeros(256, dtype=bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

U = np.uint64


class Lane:
    """One random polynomial hash: byte values, and powers of its base in both directions."""

    def __init__(self, seed: int) -> None:
        rng = np.random.default_rng(seed)
        self.value = rng.integers(1, 2**64, 256, dtype=np.uint64)
        base = int(rng.integers(1, 2**64, dtype=np.uint64)) | 5
        self.steps = U(base), U(pow(base, -1, 2**64))
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.up) < n:
            m = 1 << (n - 1).bit_length()
            out = []
            for step in self.steps:
                a = np.full(m, step, dtype=np.uint64)
                a[0] = 1
                out.append(np.multiply.accumulate(a))
            self.up, self.down = out

    def prefix(self, data: np.ndarray) -> np.ndarray:
        """``len(data) + 1`` prefix values of bytes."""
        return self.sums(self.value[data])

    def sums(self, values: np.ndarray) -> np.ndarray:
        """``len(values) + 1`` prefix values of 64-bit values, such as word hashes."""
        self._grow(len(values) + 1)
        p = np.zeros(len(values) + 1, dtype=np.uint64)
        np.cumsum(values * self.up[: len(values)], out=p[1:])
        return p

    def span(self, p: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Mixed hashes of the stretches ``[start, end)``."""
        return mix((p[end] - p[start]) * self.down[start])

    def windows(self, p: np.ndarray, width: int) -> np.ndarray:
        """Mixed hashes of every stretch of ``width`` bytes, by its start."""
        n = len(p) - width
        return mix((p[width:] - p[:n]) * self.down[:n]) if n > 0 else np.zeros(0, dtype=np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """Finishes a hash so that all its bits depend on all of them (a bijection)."""
    h = (h ^ (h >> U(33))) * U(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> U(29))) * U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U(32))


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and where each text starts (one more than texts); null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, "")
    wide = pa.types.is_large_string(col.type)
    at = np.frombuffer(col.buffers()[1], dtype=np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = col.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def slices(col: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(first text, bytes, starts)`` of runs of whole texts of about ``SLICE`` bytes."""
    if not len(col):
        return
    data, at = buffers(col)
    low = 0
    while low < len(at) - 1:
        high = max(low + 1, int(np.searchsorted(at, at[low] + SLICE, side="right")) - 1)
        yield low, data[at[low] : at[high]], at[low : high + 1] - at[low]
        low = high


def words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and how many words lie before each text's start (one more than texts)."""
    inked = ~BLANK[data]
    if not len(data):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(len(at), dtype=np.int64)
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[at] = True
    first = inked.copy()
    first[1:] &= ~inked[:-1] | edge[1:-1]
    last = inked.copy()
    last[:-1] &= ~inked[1:] | edge[1:-1]
    start = np.flatnonzero(first)
    return start, np.flatnonzero(last) + 1, np.searchsorted(start, at)


def window_argmin(h: np.ndarray, width: int) -> np.ndarray:
    """For each window of ``width`` values, where its least value stands (the leftmost of equals)."""
    n = len(h)
    if n < width:
        return np.zeros(0, dtype=np.int64)
    bits = max(1, int(n - 1).bit_length())
    packed = (h >> U(bits) << U(bits)) | np.arange(n, dtype=np.uint64)
    pad = -n % width
    blocks = np.concatenate([packed, np.full(pad, 2**64 - 1, dtype=np.uint64)]).reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    low = np.minimum(back[: n - width + 1], ahead[width - 1 : n])
    return (low & U((1 << bits) - 1)).astype(np.int64)
