"""Arrow text columns as flat NumPy arrays: bytes, words and their 64-bit hashes, without a Python loop over words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on at once; a longer single text goes alone.
PIECE = 2_000_000
GAP = np.zeros(256, bool)
GAP[[9, 10, 11, 12, 13, 32]] = True
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of uint64 that spreads every bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column one after the other, and where each text starts; null is empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def pieces(batch: pa.RecordBatch, name: str, most: int = PIECE) -> Iterator[pa.RecordBatch]:
    """The batch in slices whose texts hold about `most` bytes, or one text."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(name)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at, before = 0, 0
    while at < len(size):
        to = max(at + 1, int(np.searchsorted(size, before + most, "right")))
        yield batch.slice(at, to - at)
        at, before = to, size[to - 1]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and for each text the index of its first word (one more at the end)."""
    inside = ~GAP[data]
    start, end = inside.copy(), inside.copy()
    edge = offsets[(offsets > 0) & (offsets < len(data))]
    start[1:] &= ~inside[:-1]
    start[edge] = inside[edge]
    end[:-1] &= ~inside[1:]
    end[edge - 1] = inside[edge - 1]
    starts = np.flatnonzero(start)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, offsets)


def powers(n: int) -> np.ndarray:
    out = np.full(n, BASE, np.uint64)
    out[:1] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each word."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    length = ends - starts
    within = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
    with np.errstate(over="ignore"):
        value = (data[np.repeat(starts, length) + within].astype(np.uint64) + np.uint64(1)) * powers(int(length.max()))[within]
        return mix64(np.add.reduceat(value, np.cumsum(length) - length) + length.astype(np.uint64) * BASE)
