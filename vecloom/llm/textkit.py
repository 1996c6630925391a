"""Numpy kernels shared by the text operators: words, hashes and n-grams of whole Arrow batches.

Everything works on the UTF-8 bytes of many rows at once. A null text counts as an empty one. A word is a maximal run
of bytes outside space and 0x09-0x0D; those bytes never occur inside a multi-byte character, so the runs are the
same as over code points.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20
WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_NGRAM = np.uint64(0xC2B2AE3D27D4EB4F)
_powers = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def release() -> None:
    """Gives freed memory back to the system. Workers stay alive between tasks, beside the heap of their executor."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def keep_freed() -> None:
    """Lets the process use freed memory again, up to some 100 MB, instead of asking the system for each large array; until
    `release`. For kernels that make the same temporary arrays over and over."""
    option = getattr(ctypes.CDLL(None), "mallopt", None)
    if option is not None:
        option(-1, 128 << 20)  # M_TRIM_THRESHOLD
        option(-3, 32 << 20)  # M_MMAP_THRESHOLD


def lean(run: Callable) -> Callable:
    """`run`, a function over the batches of a task, that leaves no freed memory behind."""

    @functools.wraps(run)
    def tidy(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return tidy


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finalizer: nearby inputs give unrelated outputs."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _BASE)


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n + 1:
        size = max(n + 1, CHUNK_BYTES + 1)
        tables = []
        for base in (_BASE, _BASE_INVERSE):
            t = np.full(size, base, np.uint64)
            t[0] = 1
            tables.append(np.multiply.accumulate(t))
        if size > 4 * CHUNK_BYTES:  # one very long text: don't keep its tables
            return tables[0], tables[1]
        _powers = (tables[0], tables[1])
    return _powers


def chunks(text: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row past the last, bytes, offsets) of runs of rows with at most `limit` bytes, or of one longer row; of texts or
    of binary values."""
    if isinstance(text, pa.ChunkedArray):
        text = text.combine_chunks()
    binary = pa.types.is_binary(text.type) or pa.types.is_large_binary(text.type)
    text = pc.fill_null(text.cast(pa.large_binary() if binary else pa.large_string()), b"" if binary else "")
    n = len(text)
    if not n:
        return
    _, at, data = text.buffers()
    offsets = np.frombuffer(at, np.int64, n + 1, text.offset * 8)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


class Spans:
    """Prefix hashes of an array of bytes, or of other numbers whose marks are given; gives the hash of any span in O(1)."""

    def __init__(self, data: np.ndarray, marks: np.ndarray = _BYTE):
        self.up, self.down = _power_tables(len(data))
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(marks[data] * self.up[: len(data)], out=self.sums[1:])

    def hash(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        span = (self.sums[ends] - self.sums[starts]) * self.down[starts]
        return mix(span + (ends - starts).astype(np.uint64) * _NGRAM)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and for each row (and past the last) the number of words before it."""
    solid = ~WHITE[data]
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    edge = offsets[(offsets > 0) & (offsets < len(data))]
    first[edge] = solid[edge]
    last[edge - 1] = solid[edge - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def code_points(data: np.ndarray) -> np.ndarray:
    """Number of code points before each byte and in all."""
    out = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=out[1:])
    return out


def ngrams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each position on, across row borders; len(hashes) - n + 1 of them."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    out = hashes[: len(hashes) - n + 1].copy()
    for i in range(1, n):
        out *= _NGRAM
        out += hashes[i : len(hashes) - n + 1 + i]
    return mix(out)


def repeat_rows(bounds: np.ndarray) -> np.ndarray:
    """Row of each item, given the bounds of the rows' items."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


def row_sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=sums[1:])
    return sums[bounds[1:]] - sums[bounds[:-1]]


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int = 5, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct n-word shingles (hashes) of each row, concatenated, and their bounds. A row of fewer words has
    its whole sequence as its one shingle; a row without words has none."""
    if lower:
        data = LOWER[data]
    starts, ends, bounds = words(data, offsets)
    hashes = Spans(data).hash(starts, ends)
    counts = np.diff(bounds)
    owner = repeat_rows(bounds)
    left = bounds[1:][owner] - np.arange(len(hashes))  # words from here to the row's end
    grams = ngrams(hashes, n)
    fits = np.flatnonzero(left[: len(grams)] >= n)
    keys, rows = [grams[fits]], [owner[fits]]
    short = np.flatnonzero((counts > 0) & (counts < n))
    for size in np.unique(counts[short]):
        those = short[counts[short] == size]
        at = bounds[those]
        whole = hashes[at].copy()
        for i in range(1, size):
            whole = whole * _NGRAM + hashes[at + i]
        keys.append(mix(whole + np.uint64(size)))
        rows.append(those)
    key, row = np.concatenate(keys), np.concatenate(rows)
    order = np.lexsort((key, row))
    key, row = key[order], row[order]
    keep = np.ones(len(key), bool)
    keep[1:] = (key[1:] != key[:-1]) | (row[1:] != row[:-1])
    key, row = key[keep], row[keep]
    return key, np.searchsorted(row, np.arange(len(offsets)))
