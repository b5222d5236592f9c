"""Vectorised word handling over Arrow text columns: boundaries, 64-bit hashes and n-grams as numpy arrays.

A word is a maximal run of bytes other than space and \\t-\\r, which for UTF-8 text is the same as
``[^\\x20\\x09-\\x0D]+``. Work goes through chunks of about ``CHUNK_BYTES`` of text (a longer text is a chunk of its own), so
memory doesn't depend on the size of an Arrow batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 18

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
ASCII_LOWER = np.arange(256, dtype=np.uint8)
ASCII_LOWER[ord("A") : ord("Z") + 1] += 32

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_GRAM = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F, 0xEB44ACCAB455D165], np.uint64)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, CHUNK_BYTES + (1 << 16))
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
        if size > 8 * CHUNK_BYTES:  # one huge text must not hold memory for the worker's whole life
            big = tuple(_powers)
            _powers[:] = [x[:1] for x in big]
            return big
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Text:
    """Some consecutive rows of a text column: their UTF-8 bytes, and row r at ``offsets[r]:offsets[r + 1]``."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, first_row: int):
        self.data, self.offsets, self.first_row = data, offsets, first_row
        self.rows = len(offsets) - 1

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and rows of all words, in order."""
        data, offsets = self.data, self.offsets
        if not len(data):
            return (np.zeros(0, np.int64),) * 3
        space = SPACE[data]
        breaks = np.empty(len(data) + 1, bool)
        breaks[0] = breaks[-1] = True
        breaks[1:-1] = space[:-1]
        breaks[offsets[:-1]] = True
        starts = np.flatnonzero(breaks[:-1] & ~space)
        breaks[1:-1] = space[1:]
        breaks[offsets] = True
        ends = np.flatnonzero(breaks[1:] & ~space) + 1
        return starts, ends, np.searchsorted(offsets, starts, "right") - 1

    def span_hashes(self, starts: np.ndarray, ends: np.ndarray, data: np.ndarray | None = None) -> np.ndarray:
        """A 64-bit hash of each span of bytes, equal for equal bytes wherever they stand."""
        return Spans(self.data if data is None else data)(starts, ends)


class Spans:
    """Hashes of any spans of some bytes, from one running sum over them."""

    def __init__(self, data: np.ndarray):
        powers, self.inverses = _power_tables(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[: len(data)], out=self.sums[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.inverses[starts] + (ends - starts).astype(np.uint64))


def grams(hashes: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-grams that lie in one row, and the place of each one's first word."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.flatnonzero(rows[: len(rows) - n + 1] == rows[n - 1 :])
    out = hashes[at] * _GRAM[0]
    for k in range(1, n):
        out += hashes[at + k] * _GRAM[k]
    return mix(out + np.uint64(n)), at


def texts(column: pa.Array, most: int = CHUNK_BYTES) -> Iterator[Text]:
    """The column's rows as chunks; a null counts as an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1)
        last = min(last, n)
        yield Text(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first], first)
        first = last


def row_sums(values: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(rows, weights=values, minlength=n)[:n]
