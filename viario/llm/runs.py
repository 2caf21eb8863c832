"""Periodic runs of words, found by longest common extensions over a difference cover.

A run is a stretch of words that repeats with period q at least three times and cannot be made
longer. It holds three neighbouring multiples of q, so it is enough to look at the places q, 2q,
3q, .. for each q, n log n in all, and to ask how far the words from there and those q later
agree, forwards and backwards.

Such an extension is answered from a sample of the suffixes. The residues of a difference cover
modulo 64 hold every difference, so any two places reach sampled places together after less
than 64 words; these few are compared. Only sampled suffixes are sorted, by blocks of 64 words
and then by doubling. The extension of two of them is the least common prefix between their
ranks, from a sparse table.
"""

from __future__ import annotations

import hashlib
import sys
from array import array
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F, types as T

from viario.llm.words import kept

cloudpickle.register_pickle_by_value(sys.modules[__name__])

MODULUS = 64
MIN_LENGTH = 24
MIN_EXPONENT = 3
PART_BYTES = 1 << 20    # texts are cut into words by parts of this size
GRID_WORDS = 1 << 15    # texts up to this size share one list of grid places
GRID_PLACES = 1 << 20   # grid places of a longer text looked at together
PAIRS = 1 << 12         # extensions asked for together


def cover(modulus: int) -> np.ndarray:
    """Residues whose differences are all residues: 0 to r - 1 and the multiples of r, for r the root of the modulus."""
    r = int(np.ceil(np.sqrt(modulus)))
    return np.unique(np.concatenate([np.arange(r), np.arange(0, modulus + r, r) % modulus]))


class Cover:
    """The cover, and for two residues after how many steps both are in it."""

    def __init__(self, modulus: int = MODULUS):
        self.modulus = modulus
        self.inside = np.zeros(modulus, dtype=bool)
        self.inside[cover(modulus)] = True
        k = np.arange(modulus)
        steps = self.inside[(k[:, None] + k) % modulus]          # residue, step
        self.steps = (steps[:, None, :] & steps[None, :, :]).argmax(axis=2)


class Extensions:
    """How many words agree from two places of one text on."""

    def __init__(self, words: np.ndarray, cover: Cover):
        self.n, self.cover = len(words), cover
        self.words = np.concatenate([words, np.full(cover.modulus + 1, -1, words.dtype)])
        self.table: list[np.ndarray] | None = None

    def _sort_sample(self) -> None:
        """Ranks of the sampled suffixes, and a sparse table over their common prefixes."""
        v = self.cover.modulus
        places = np.flatnonzero(self.cover.inside[np.arange(self.n) % v])
        m = len(places)
        number = np.full(self.n + 1, -1, np.int64)               # of a place in the sample
        number[places] = np.arange(m)
        step = v if m <= 1 << 15 else 8                           # a long text is sorted by parts of a block
        rank = np.zeros(m, np.int64)
        for at in range(v - step, -1, -step):
            rows = np.ascontiguousarray(self.words[np.minimum(places[:, None] + np.arange(at, at + step), self.n)])
            names = np.unique(rows.view(np.dtype((np.void, rows.dtype.itemsize * step))).ravel(), return_inverse=True)[1]
            rank = np.unique(names.astype(np.int64) * m + rank, return_inverse=True)[1] if at + step < v else names.astype(np.int64)
        levels, length = [rank], v
        while length < self.n and int(rank.max()) < m - 1:
            later = number[np.minimum(places + length, self.n)]
            rank = np.unique(rank * (m + 1) + np.where(later < 0, 0, levels[-1][later] + 1), return_inverse=True)[1]
            levels.append(rank)
            length *= 2
        order = np.argsort(rank, kind="stable")
        a, b = order[:-1], order[1:]
        common = np.zeros(max(m - 1, 0), np.int64)
        for level in range(len(levels) - 1, -1, -1):              # whole blocks by their names, the longest first
            ahead = v << level
            at, to = number[np.minimum(places[a] + common, self.n)], number[np.minimum(places[b] + common, self.n)]
            same = (at >= 0) & (to >= 0) & (levels[level][at] == levels[level][to])
            common = np.where(same, common + ahead, common)
        # A block that goes over the end names the end, too, so two different places never share it.
        for c in range(0, len(common), PAIRS):
            own = slice(c, c + PAIRS)
            common[own] += self._few(places[a[own]] + common[own], places[b[own]] + common[own], None)
        self.rank, self.number = np.empty(m, np.int64), number
        self.rank[order] = np.arange(m)
        self.table = [common]
        while (width := 1 << len(self.table)) <= len(common):
            last = self.table[-1]
            self.table.append(np.minimum(last[:-(width // 2)], last[width // 2:]))

    def _few(self, i: np.ndarray, j: np.ndarray, most: np.ndarray | None) -> np.ndarray:
        """Words that agree from i and j on, up to a block or as many as given."""
        v = self.cover.modulus
        k = np.arange(v)
        other = self.words[np.minimum(i[:, None] + k, self.n)] != self.words[np.minimum(j[:, None] + k, self.n)]
        other |= (np.maximum(i, j)[:, None] + k) >= self.n
        found = np.where(other.any(axis=1), other.argmax(axis=1), v)
        return found if most is None else np.minimum(found, most)

    def of(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Words that agree from i and from j on, for i < j."""
        out = np.empty(len(i), np.int64)
        for a in range(0, len(i), PAIRS):
            out[a:a + PAIRS] = self._of(i[a:a + PAIRS], j[a:a + PAIRS])
        return out

    def _of(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        v = self.cover.modulus
        ahead = self.cover.steps[i % v, j % v]
        found = self._few(i, j, ahead)
        on = np.flatnonzero((found == ahead) & (j + ahead < self.n))
        if len(on):
            if self.table is None:
                self._sort_sample()
            x, y = (self.rank[self.number[p[on] + ahead[on]]] for p in (i, j))
            low, high = np.minimum(x, y), np.maximum(x, y)
            level = np.frexp((high - low).astype(np.float64))[1] - 1
            least = np.empty(len(on), np.int64)
            for own in np.unique(level):
                at = level == own
                row = self.table[own]
                least[at] = np.minimum(row[low[at]], row[high[at] - (1 << int(own))])
            found[on] += least
        return found


class Grid:
    """Places p, p + q, p + 2q, all multiples of q, sorted by the last, so that those of a text are the first ones."""

    def __init__(self):
        self.last = self.q = np.zeros(0, np.int32)
        self.size = 0

    def of(self, n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(last place, q) for a text of n words, in parts."""
        if n <= GRID_WORDS:
            if n > self.size:
                self.size = min(GRID_WORDS, max(2 * n, 1024))
                every = [np.arange(2 * q, self.size, q, dtype=np.int32) for q in range(1, (self.size + 1) // 2)]
                q = np.repeat(np.arange(1, len(every) + 1, dtype=np.int32), [len(e) for e in every])
                last = np.concatenate(every)
                order = np.argsort(last, kind="stable")
                self.last, self.q = last[order], q[order]
            to = int(np.searchsorted(self.last, n))
            yield self.last[:to], self.q[:to]
            return
        held, places = [], 0
        for q in range(1, n // MIN_EXPONENT + 1):
            for a in range(2 * q, n, GRID_PLACES * q):
                last = np.arange(a, min(n, a + GRID_PLACES * q), q, dtype=np.int64)
                held.append((last, np.full(len(last), q, np.int64)))
                places += len(last)
                if places >= GRID_PLACES:
                    yield tuple(np.concatenate(c) for c in zip(*held))
                    held, places = [], 0
        if held:
            yield tuple(np.concatenate(c) for c in zip(*held))


def runs_of(words: np.ndarray, cover: Cover, grid: Grid, min_length: int = MIN_LENGTH) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a text, given as word numbers, by start and period."""
    n = len(words)
    if n < min_length:
        return []
    ahead, back, found = Extensions(words, cover), None, []
    for last, q in grid.of(n):
        at = words[last]
        some = np.flatnonzero(at == words[last - q])
        some = some[at[some] == words[last[some] - 2 * q[some]]]
        if not len(some):
            continue
        period = q[some].astype(np.int64)
        first = last[some].astype(np.int64) - 2 * period
        right = ahead.of(first, first + period)
        on = right > period                                       # the third place is in the run
        first, period, right = first[on], period[on], right[on]
        if not len(first):
            continue
        if back is None:
            back = Extensions(words[::-1], cover)
        left = np.zeros(len(first), np.int64)
        inner = np.flatnonzero(first > 0)                         # words before both places
        left[inner] = back.of(n - first[inner] - period[inner], n - first[inner])
        length = left + right + period
        ok = length >= np.maximum(min_length, MIN_EXPONENT * period)
        if ok.any():
            found.append(np.unique(np.stack([first[ok] - left[ok], length[ok], period[ok]]), axis=1))
    if not found:
        return []
    start, length, period = np.concatenate(found, axis=1)
    order = np.lexsort((period, length, start))                   # a stretch counts with its smallest period
    start, length, period = start[order], length[order], period[order]
    own = np.ones(len(start), dtype=bool)
    own[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    rows = zip(start[own].tolist(), length[own].tolist(), period[own].tolist())
    return sorted(rows, key=lambda r: (r[0], r[2]))


def number_words(text: bytes) -> tuple[np.ndarray, list[bytes]]:
    """Each word's number, and the words by number; equal words have equal numbers."""
    numbers: dict[bytes, int] = {}
    out = array("i")
    at = 0
    while at < len(text):
        to = min(at + PART_BYTES, len(text))
        while to < len(text) and text[to] not in b" \t\n\x0b\x0c\r":
            to += 1
        out.extend([numbers.setdefault(w, len(numbers)) for w in text[at:to].split()])
        at = to
    return np.frombuffer(out, np.int32) if out else np.zeros(0, np.int32), list(numbers)


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Whether each word stays: all but those that a run contains after its first period."""
    change = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return np.cumsum(change[:-1]) == 0


def _clearest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int]:
    """The run with the greatest length in periods; of equal ones the first, then the one with the smallest period."""
    most = max(r[1] / r[2] for r in runs)
    near = [r for r in runs if r[1] / r[2] >= most * (1 - 1e-9)]
    return max(near, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]))


def find_runs(documents: DataFrame, text: str = "text", keep: list[str] | None = None, min_length: int = MIN_LENGTH,
              digest: bool = False) -> DataFrame:
    """The kept columns with n_words, n_runs, start, length, period, exponent_milli, runs and collapsed_text.

    Words are runs of anything but space and \\t to \\r, unchanged; null and empty texts have
    none. `runs` lists all runs by start and period, and the figures before it are those of the
    run with the greatest length in periods; of equal ones the first, then that of the smallest
    period; null without a run. In collapsed_text each run keeps its first period. With
    `digest`, runs_sha256 and collapsed_sha256 stand in place of the last two: digests of the
    lines `start,length,period` and of the collapsed text. Every row is judged alone; repeated
    rows and ids come back as they are, columns named as the results give way to them, and an
    empty table gives an empty one. A text is one task's work; a worker needs about 30 times
    the bytes of its longest text.
    """
    last = ("runs_sha256", "collapsed_sha256") if digest else ("runs", "collapsed_text")
    figures = ["n_words", "n_runs", "start", "length", "period", "exponent_milli"]
    keep = kept(documents, keep, text, (*figures, *last))
    rows = documents.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("binary").alias("__text"))
    schema = rows.drop("__text").schema
    for name in figures:
        schema = schema.add(name, "long")
    span = T.StructType().add("start", "long").add("length", "long").add("period", "long")
    for name in last:
        schema = schema.add(name, T.ArrayType(span) if name == "runs" else "string")
    names = [f.name for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cover, grid = Cover(), Grid()
        spans = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        kinds = [*[pa.int64()] * len(figures), pa.string() if digest else spans, pa.string()]
        for batch in batches:
            out = []
            for value in batch.column("__text"):
                words, spelled = number_words(value.as_py() or b"")
                runs = runs_of(words, cover, grid, min_length)
                stay = words[kept_words(len(words), runs)] if runs else words
                collapsed = b" ".join([spelled[i] for i in stay.tolist()])
                best = _clearest(runs) if runs else (None, None, None)
                milli = best[1] * 1000 // best[2] if runs else None
                if digest:
                    lines = "".join(f"{s},{l},{p}\n" for s, l, p in runs)
                    tail = (hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(collapsed).hexdigest())
                else:
                    tail = ([{"start": s, "length": l, "period": p} for s, l, p in runs], collapsed.decode())
                out.append((len(words), len(runs), *best, milli, *tail))
            made = [pa.array(c, k) for c, k in zip(zip(*out), kinds)] if out else [pa.array([], k) for k in kinds]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(keep))], *made], names)

    return rows.mapInArrow(run, schema)
