"""Words of many texts at once: their borders and 64-bit hashes, from the bytes of an Arrow column.

Hashes only choose candidates or name n-grams; operators that need the words themselves
compare bytes.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame

# The code travels with the tasks, so that workers need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SLICE_BYTES = 1 << 20  # texts are hashed together up to this size; a longer one is hashed alone
_ODD = 0x9E3779B97F4A7C15
_GRAM = 0xD6E8FEB86659FD93


def byte_class(word: str) -> np.ndarray:
    """Which bytes belong to words: 'printing' (all but space and \\t to \\r) or 'letters' (digits, letters, non-ASCII)."""
    inside = np.ones(256, dtype=bool)
    if word == "printing":
        inside[[0x20, *range(0x09, 0x0E)]] = False
    else:
        inside[:0x80] = False
        inside[0x30:0x3A] = inside[0x61:0x7B] = inside[0x41:0x5B] = True
    return inside


def lower_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[0x41:0x5B] += 32
    return table


def mix(h: np.ndarray) -> np.ndarray:
    """Spread all bits of 64-bit numbers (the finaliser of SplitMix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def packed(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and where each text starts; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset:column.offset + n + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data else np.zeros(0, np.uint8)
    return data[at[0]:at[-1]], at - at[0]


def kept(documents: DataFrame, keep: list[str] | None, but: str, made: tuple[str, ...]) -> list[str]:
    """The columns to keep: those named, or all but one; a column with the name of a result gives way to it."""
    return [c for c in (documents.columns if keep is None else keep) if c not in made and (keep is not None or c != but)]


class Words:
    """Words of some texts: start and end in `data`, `hash`, and `first`, the number of each text's first word."""

    def __init__(self, data, start, end, hash, first):
        self.data, self.start, self.end, self.hash, self.first = data, start, end, hash, first

    def text(self, a: int, b: int) -> bytes:
        """Words a to b - 1 joined by one space."""
        d = self.data
        return b" ".join(d[s:e].tobytes() for s, e in zip(self.start[a:b].tolist(), self.end[a:b].tolist()))


class Tokeniser:
    """Make one inside a task; it keeps tables that would be large to send."""

    def __init__(self, word: str = "printing", lower: bool = False):
        self.inside, self.lower = byte_class(word), lower_table() if lower else None
        self.power = self.inverse = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.power) <= n:
            n = max(n, SLICE_BYTES) + 1
            with np.errstate(over="ignore"):
                for name, base in (("power", _ODD), ("inverse", pow(_ODD, -1, 1 << 64))):
                    steps = np.full(n, base, np.uint64)
                    steps[0] = 1
                    setattr(self, name, np.multiply.accumulate(steps))

    def slices(self, column: pa.Array) -> Iterator[tuple[int, int, Words]]:
        """(from, to, words) for runs of rows of the column."""
        data, at = packed(column)
        row, rows = 0, len(at) - 1
        while row < rows:
            to = int(np.searchsorted(at, at[row] + SLICE_BYTES, side="right")) - 1
            to = min(max(to, row + 1), rows)
            yield row, to, self.words(data[at[row]:at[to]], at[row:to + 1] - at[row])
            row = to

    def words(self, data: np.ndarray, at: np.ndarray) -> Words:
        if self.lower is not None:
            data = self.lower[data]
        n = len(data)
        self._grow(n)
        inside = self.inside[data]
        edge = np.zeros(n + 1, dtype=bool)  # a word may not go on over these places
        edge[at] = True
        begins = inside.copy()
        begins[1:] &= ~inside[:-1] | edge[1:n]
        stops = inside.copy()
        stops[:-1] &= ~inside[1:] | edge[1:n]
        start, end = np.flatnonzero(begins), np.flatnonzero(stops) + 1
        total = np.zeros(n + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.power[:n], out=total[1:])
            hashes = mix((total[end] - total[start]) * self.inverse[start])
        return Words(data, start, end, hashes, np.searchsorted(start, at))


def grams(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The hash of the words i to i + size - 1 for each i, and whether they lie in one text."""
    h, n = words.hash, len(words.hash)
    if n < size:
        return np.zeros(n, np.uint64), np.zeros(n, dtype=bool)
    total, weight = np.zeros(n - size + 1, np.uint64), 1
    with np.errstate(over="ignore"):
        for j in range(size):
            total += h[j:n - size + 1 + j] * np.uint64(weight)
            weight = weight * _GRAM % (1 << 64)
        out = np.zeros(n, np.uint64)
        out[:n - size + 1] = mix(total)
    return out, left(words) >= size


def left(words: Words) -> np.ndarray:
    """For each word, how many words its text has from it on."""
    ends = np.repeat(words.first[1:], np.diff(words.first))
    return ends - np.arange(len(words.hash))
