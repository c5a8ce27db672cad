"""Whole batches of texts as one array of UTF-8 bytes: runs, hashes of runs, windows of words.

The functions work on slices of an Arrow batch, so memory follows a slice (or one very long text), not the batch.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
_M64 = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15
_GAMMA = np.uint64(0x9E3779B97F4A7C15)


def give_back() -> None:
    """Return the memory that a finished task no longer uses; Python workers stay alive between tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library keeps its own counsel
        return


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, element by element."""
    x = np.asarray(x, dtype=np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def keyed(x: np.ndarray, key: int) -> np.ndarray:
    """One hash function of many: the key chooses which."""
    pad = mix(np.array([(key * _BASE + 0x632BE59BD9B4E019) & _M64], dtype=np.uint64))
    return mix(np.asarray(x, dtype=np.uint64) ^ pad)


_BYTE_CODE = mix(np.arange(1, 257, dtype=np.uint64) * _GAMMA)
_powers = np.ones(1, dtype=np.uint64)
_inverse = np.ones(1, dtype=np.uint64)


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers, _inverse
    if len(_powers) < n:
        size = max(n, SLICE_BYTES + 2)
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            table = np.full(size, base, dtype=np.uint64)
            table[0] = 1
            table = np.multiply.accumulate(table)
            if base == _BASE:
                _powers = table
            else:
                _inverse = table
    return _powers, _inverse


class Hashes:
    """Hashes of any stretches of a byte array, overlapping ones too, from one running sum.

    Sums modulo 2^64 have collisions that texts can be made for, of stretches of a thousand bytes and more; words and lines
    have ``run_hashes``.
    """

    def __init__(self, data: np.ndarray):
        powers, self.inverse = _power_tables(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(_BYTE_CODE[data] * powers[: len(data)], out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """64-bit hashes of ``data[start:end]``; equal stretches have equal hashes wherever they stand."""
        raw = (self.sums[ends] - self.sums[starts]) * self.inverse[starts]
        return mix(raw + (ends - starts).astype(np.uint64) * _GAMMA)


# Numbers drawn for every byte at each of the first places of a run; later places are drawn as they come
_NEAR = 64
_DRAWN = mix((np.arange(_NEAR * 256, dtype=np.uint64) + np.uint64(1)) * _GAMMA)


def run_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the bytes of runs that do not overlap, such as words and lines.

    A run's hash adds up a number drawn for each of its (byte, place in the run) pairs, of which no two runs that differ
    have the same set: unlike the sums of ``Hashes`` nothing in the texts can make two collide, only chance, once in 2^64.
    """
    lengths = ends - starts
    if not len(starts):
        return np.empty(0, np.uint64)
    cuts = np.cumsum(lengths) - lengths
    place = np.arange(int(lengths.sum())) - np.repeat(cuts, lengths)
    code = place * 256 + data[place + np.repeat(starts, lengths)]
    drawn = _DRAWN[np.minimum(code, len(_DRAWN) - 1)]
    far = np.flatnonzero(place >= _NEAR)
    if len(far):
        drawn[far] = mix((code[far].astype(np.uint64) + np.uint64(1)) * _GAMMA)
    total = np.zeros(len(starts), dtype=np.uint64)
    full = np.flatnonzero(lengths)
    if len(full):
        total[full] = np.add.reduceat(drawn, cuts[full])
    return mix(total + lengths.astype(np.uint64) * _GAMMA)


def column_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """A string column as its bytes end to end and the n + 1 cuts between rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    _, offsets, data = column.buffers()
    cuts = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1] if offsets else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[cuts[0] : cuts[-1]], cuts - cuts[0]


def slices(cuts: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Stretches of rows with at most ``limit`` bytes, or of one row that is longer."""
    row, rows = 0, len(cuts) - 1
    while row < rows:
        stop = max(row + 1, int(np.searchsorted(cuts, cuts[row] + limit, side="right")) - 1)
        stop = min(stop, rows)
        yield row, stop
        row = stop


def byte_table(*ranges: tuple[int, int]) -> np.ndarray:
    """256 flags, true within the given closed ranges."""
    table = np.zeros(256, dtype=bool)
    for low, high in ranges:
        table[low : high + 1] = True
    return table


WHITE = byte_table((0x20, 0x20), (0x09, 0x0D))


def runs(inside: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of true bytes; a run never crosses a cut between rows."""
    n = len(inside)
    if n == 0:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    first = np.empty(n, dtype=bool)
    first[0] = True
    np.logical_not(inside[:-1], out=first[1:])
    first[cuts[:-1][cuts[:-1] < n]] = True
    last = np.empty(n, dtype=bool)
    last[-1] = True
    np.logical_not(inside[1:], out=last[:-1])
    last[cuts[1:][cuts[1:] > 0] - 1] = True
    return np.flatnonzero(first & inside), np.flatnonzero(last & inside) + 1


def row_ranges(positions: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """For each row the first of the sorted positions in it, and one more at the end."""
    return np.searchsorted(positions, cuts, side="left")


# An odd multiplier for each place in a window
_SLOT = [int(x) | 1 for x in mix(np.arange(1001, 1001 + 64, dtype=np.uint64) * _GAMMA)]


def windows(words: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of ``width`` consecutive words that stay in one row, and where each begins.

    ``bounds`` are the first words of the rows and one more; at most 64 words make a window.
    """
    count = len(words) - width + 1
    if count <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    total = np.zeros(count, dtype=np.uint64)
    for j in range(width):
        total += words[j : j + count] * np.uint64(_SLOT[j])
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    starts = np.flatnonzero(row[:count] == row[width - 1 :])
    return mix(total[starts]), starts
