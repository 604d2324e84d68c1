"""Vectorised scanning of text columns inside Arrow tasks.

A chunk holds whole documents: ``data`` (their UTF-8 bytes, end to end) and ``bounds``
(n + 1 offsets). Hashes are sums of random byte values times powers of an odd number modulo
2**64, so the hash of any span comes from two prefix sums; a bijective mixer follows.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True

_rng = np.random.default_rng(20240607)
BYTE_VALUE = _rng.integers(0, 2**64, 256, dtype=U64)
LOWER_VALUE = BYTE_VALUE.copy()
LOWER_VALUE[65:91] = BYTE_VALUE[97:123]
_BASE, _BASE_INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 2**64)
_powers = [np.ones(1, U64), np.ones(1, U64)]


def release() -> None:
    """Gives memory back to the system, that of long tables of powers as well. A Python worker outlives its task, and the next one may run elsewhere."""
    if len(_powers[0]) > 1 << 17:
        _powers[:] = [np.ones(1, U64), np.ones(1, U64)]
    pa.default_memory_pool().release_unused()
    pa.set_memory_pool(pa.system_memory_pool())  # for later tasks: the C library gives back what others would keep
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def lean_task(task: Callable) -> Callable:
    """A task over batches that leaves no memory behind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from task(batches)
        finally:
            release()

    return run


def lean(function: Callable) -> Callable:
    """The same for a function of one group."""

    def run(group: pa.Table) -> pa.Table:
        out = function(group)
        release()
        return out

    return run


def lean_pair(function: Callable) -> Callable:
    """The same for a function of a key and its group, or of two groups."""

    def run(first, second):  # without hints: Spark infers from them, and knows tables by default
        out = function(first, second)
        release()
        return out

    return run


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse."""
    if len(_powers[0]) < n:
        size = max(n, 1 << 16)
        for i, b in enumerate((_BASE, _BASE_INVERSE)):
            p = np.full(size, b, U64)
            p[0] = 1
            _powers[i] = np.cumprod(p, dtype=U64)
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def prefix_sums(values: np.ndarray) -> np.ndarray:
    out = np.zeros(len(values) + 1, U64)
    np.cumsum(values * powers(len(values))[0], out=out[1:])
    return out


def span_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return mix((sums[ends] - sums[starts]) * powers(len(sums))[1][starts])


def rolling(values: np.ndarray, n: int) -> np.ndarray:
    """Hash of every n consecutive values; empty if there are fewer."""
    if len(values) < n:
        return np.zeros(0, U64)
    s = prefix_sums(values)
    return mix((s[n:] - s[:-n]) * powers(len(s) - n)[1])


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[i], starts[i] + 1, ... (counts[i] of them), one after another."""
    counts = np.asarray(counts, np.int64)
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(counts)
    return np.arange(total) - np.repeat(ends - counts - starts, counts)


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
        column = pc.fill_null(column, "").cast(pa.large_string()).cast(pa.large_binary())
    else:
        column = pc.fill_null(column, b"").cast(pa.large_binary())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[bounds[0] : bounds[-1]], bounds - bounds[0]


def chunks(column: pa.Array, limit: int = 1 << 19) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, data, bounds) of runs of whole documents of about ``limit`` bytes."""
    data, bounds = text_buffers(column)
    lo, n = 0, len(bounds) - 1
    while lo < n:
        hi = min(n, max(lo + 1, int(np.searchsorted(bounds, bounds[lo] + limit, "right")) - 1))
        yield lo, hi, data[bounds[lo] : bounds[hi]], bounds[lo : hi + 1] - bounds[lo]
        lo = hi


def words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words [^\\x20\\x09-\\x0D]+, and each document's first word's index."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(bounds), np.int64)
    inside = ~SEPARATOR[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edges = bounds[(bounds > 0) & (bounds < n)]
    first[edges] = inside[edges]
    last[edges - 1] = inside[edges - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, bounds)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    return span_hash(prefix_sums((LOWER_VALUE if lower else BYTE_VALUE)[data]), starts, ends)


def runs(sorted_keys: np.ndarray) -> np.ndarray:
    """Indices at which a new key begins."""
    if not len(sorted_keys):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.concatenate(([True], sorted_keys[1:] != sorted_keys[:-1])))


class HashSlots:
    """Whole numbers by 64-bit hash: open addressing over whole arrays of hashes at a time."""

    def __init__(self, bits: int = 16):
        self.key, self.slot, self.count = np.zeros(1 << bits, U64), np.full(1 << bits, -1, np.int32), 0

    def get(self, hashes: np.ndarray) -> np.ndarray:
        """The hashes' numbers, -1 for those without one."""
        out, mask = np.full(len(hashes), -1, np.int64), len(self.key) - 1
        place, left = (hashes & U64(mask)).astype(np.int64), np.arange(len(hashes))
        while len(left):
            found = self.slot[place]
            same = (found >= 0) & (self.key[place] == hashes[left])
            out[left[same]] = found[same]
            on = (found >= 0) & ~same
            left, place = left[on], (place[on] + 1) & mask
        return out

    def put(self, hashes: np.ndarray, slots: np.ndarray) -> None:
        """hashes must be distinct and new."""
        if 2 * (self.count + len(hashes)) > len(self.key):
            used = self.slot >= 0
            hashes, slots = np.concatenate([self.key[used], hashes]), np.concatenate([self.slot[used], slots])
            self.__init__((2 * len(hashes)).bit_length())
        self.count += len(hashes)
        mask = len(self.key) - 1
        place = (hashes & U64(mask)).astype(np.int64)
        while len(hashes):
            free = self.slot[place] < 0
            self.key[place[free]] = hashes[free]
            won = free & (self.key[place] == hashes)
            self.slot[place[won]] = slots[won]
            hashes, slots, place = hashes[~won], slots[~won], (place[~won] + 1) & mask
