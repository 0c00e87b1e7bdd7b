"""Vectorised words, lines and hashed n-grams over the UTF-8 bytes of an Arrow column.

A text is cut into words at ASCII white space (0x20, 0x09-0x0D). Hashes are 64-bit
polynomial prefix hashes over random byte values, finished with a mixer; equal
words get equal hashes in every task because all constants are fixed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

# Numpy keeps some arrays of 8 bytes for every byte of a slice.
SLICE_BYTES = 1 << 18

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_PUNCT = np.zeros(256, bool)
_IS_PUNCT[[b for b in range(0x21, 0x7F) if not chr(b).isalnum()]] = True

_rng = np.random.Generator(np.random.PCG64(20240607))
_VALUE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_VALUE_LOWER = _VALUE[_LOWER]
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_GRAM = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, SLICE_BYTES + 65536)
        for at, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[at] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finisher."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Slice:
    """Some consecutive texts: rows first .. first + len(offsets) - 2 of the column."""

    first: int
    data: np.ndarray
    offsets: np.ndarray

    @property
    def rows(self) -> int:
        return len(self.offsets) - 1

    def totals(self, flags: np.ndarray) -> np.ndarray:
        """The sum of a per-byte array in every text."""
        sums = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
        return sums[self.offsets[1:]] - sums[self.offsets[:-1]]


def slices(column: pa.Array, max_bytes: int = SLICE_BYTES) -> Iterator[Slice]:
    """Cut a string column into runs of rows of about `max_bytes`; a longer text stays whole."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    body = column.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        last = max(row + 1, int(np.searchsorted(bounds, bounds[row] + max_bytes, "right")) - 1)
        last = min(last, n)
        yield Slice(row, data[bounds[row] : bounds[last]], bounds[row : last + 1] - bounds[row])
        row = last


@dataclass
class Words:
    """Byte ranges of all words of a slice, and the text (row of the slice) of each."""

    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    counts: np.ndarray


def words(part: Slice) -> Words:
    inside = np.zeros(len(part.data) + 2, bool)
    inside[1:-1] = ~_IS_SPACE[part.data]
    heads = np.zeros(len(part.data) + 1, bool)
    heads[part.offsets] = True
    start = np.flatnonzero(inside[1:-1] & (~inside[:-2] | heads[:-1]))
    end = np.flatnonzero(inside[1:-1] & (~inside[2:] | heads[1:])) + 1
    at = np.searchsorted(start, part.offsets)
    counts = np.diff(at)
    return Words(start, end, np.repeat(np.arange(part.rows), counts), counts)


def trimmed(part: Slice, found: Words) -> Words:
    """The words without ASCII punctuation at both ends; a word of nothing else stays."""
    start, end = found.start.copy(), found.end.copy()
    punct = _IS_PUNCT[part.data] if len(part.data) else np.zeros(0, bool)
    live = np.arange(len(start))
    while len(live):
        live = live[punct[start[live]] & (start[live] + 1 < end[live])]
        start[live] += 1
    live = np.arange(len(end))
    while len(live):
        live = live[punct[end[live] - 1] & (start[live] + 1 < end[live])]
        end[live] -= 1
    return Words(start, end, found.row, found.counts)


def range_hashes(
    part: Slice, start: np.ndarray, end: np.ndarray, lower: bool = False
) -> np.ndarray:
    """A 64-bit hash of every byte range; `lower` folds A-Z."""
    if not len(start):
        return np.zeros(0, np.uint64)
    power, inverse = _power_tables(len(part.data) + 1)
    value = (_VALUE_LOWER if lower else _VALUE)[part.data]
    sums = np.zeros(len(part.data) + 1, np.uint64)
    np.cumsum(value * power[:-1], dtype=np.uint64, out=sums[1:])
    return mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64))


def gram_hashes(hashes: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-word windows inside one text, and the index of their first word."""
    count = len(hashes) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    total = np.zeros(count, np.uint64)
    for j in range(n):
        total += hashes[j : j + count] * _GRAM[j]
    at = np.flatnonzero(row[:count] == row[n - 1 :])
    return mix(total[at]), at
