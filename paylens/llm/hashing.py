"""Polynomial prefix hashes, words and shingles of whole Arrow batches, in numpy.

The prefix hash of a buffer at i is the sum of value(byte j) * BASE ** j for j < i, modulo 2 ** 64. A range's hash is
the difference at its ends times BASE ** -start, so that equal ranges have equal hashes wherever they stand.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_SPACES = np.zeros(256, dtype=bool)
_SPACES[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
# bytes of one step; working arrays take about 60 times as much
STEP = 1 << 20


def mix64(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values; a bijection."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def seeds(n: int, seed: int) -> np.ndarray:
    """n odd 64-bit constants."""
    return mix64(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95) + np.uint64(seed)) | np.uint64(1)


_VALUES = seeds(256, 77)
_tables: dict[int, np.ndarray] = {}


def powers(n: int, base: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1)."""
    known = _tables.get(base)
    if known is None or len(known) < n:
        size = 1 << max(10, (n - 1).bit_length())
        known = np.ones(size, dtype=np.uint64)
        done = 1
        while done < size:
            known[done : 2 * done] = known[:done] * np.uint64(pow(base, done, 1 << 64))
            done *= 2
        if size <= 4 * STEP:
            _tables[base] = known
    return known[:n]


def prefix_hashes(data: np.ndarray, values: np.ndarray = _VALUES) -> np.ndarray:
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(values[data] * powers(len(data), _BASE), out=out[1:])
    return out


def range_hashes(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Not yet spread: see mix64."""
    return (prefix[ends] - prefix[starts]) * powers(len(prefix), _INVERSE)[starts]


def blocks(column: pa.Array, step: int = STEP) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of rows with about `step` bytes; a longer row is a run of its own.

    Null is empty. The bytes are a view of the Arrow buffer.
    """
    if len(column) == 0:
        return
    if column.null_count:
        column = column.fill_null(b"")
    column = column.cast(pa.large_binary())
    ends = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    held = column.buffers()[2]
    data = np.frombuffer(held, dtype=np.uint8) if held is not None else np.zeros(0, dtype=np.uint8)
    row = 0
    while row < len(column):
        last = max(row + 1, int(np.searchsorted(ends, ends[row] + step, side="right")) - 1)
        yield row, data[ends[row] : ends[last]], ends[row : last + 1] - ends[row]
        row = last


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the number of the first word of each row (one more at the end)."""
    inside = ~_SPACES[data]
    before = np.zeros(len(data) + 1, dtype=bool)
    before[1:] = inside
    before[offsets] = False
    starts = np.flatnonzero(inside & ~before[:-1])
    after = np.zeros(len(data) + 1, dtype=bool)
    after[:-1] = inside
    after[offsets] = False
    ends = np.flatnonzero(inside & ~after[1:]) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words, letters A to Z lowered, and the number of the first word of each row."""
    starts, ends, first = words(data, offsets)
    prefix = prefix_hashes(_LOWER[data] if lower else data)
    return mix64(range_hashes(prefix, starts, ends) + (ends - starts).astype(np.uint64)), first


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> list[np.ndarray]:
    """For each row the sorted distinct hashes of its shingles of `width` words; shorter rows are one shingle."""
    hashes, first = word_hashes(data, offsets)
    factors = seeds(width, 5)
    n = max(0, len(hashes) - width + 1)
    total = np.zeros(n, dtype=np.uint64)
    for j in range(width):
        total += hashes[j : j + n] * factors[j]
    total = mix64(total)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= width:
            one = np.sort(total[a : b - width + 1])
            out.append(one[np.concatenate([[True], one[1:] != one[:-1]])])
        elif b > a:
            short = (hashes[a:b] * factors[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)
            out.append(mix64(np.array([short], dtype=np.uint64)))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out
