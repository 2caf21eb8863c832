"""Benchmark decontamination: which words of a document lie in a passage of a benchmark item.

A prefix-filtered set join. Every item window is a set of shingles that a document passage
must hold in full, so one necessary prefix token is enough: the window's shingle that is
rarest in all documents. Documents are joined with these tokens by hash; a hit fixes where
the window would have to start (positional bound) and that it must fit into the document
(length bound); the words of that passage are then compared exactly.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from viario.llm.words import Tokeniser, grams, kept
from viario.storage import materialise

cloudpickle.register_pickle_by_value(sys.modules[__name__])

WINDOW_WORDS = 10
SHINGLE_WORDS = 2
BLOCK_WINDOWS = 200_000   # different windows that are sent to the executors at a time (about 25 MB)
_SPLIT = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_FILTER_BITS = 22
_WINDOW = "array<struct<start:int,stop:int>>"


def item_windows(benchmark: DataFrame, item_id: str = "item_id", text: str = "text",
                 size: int = WINDOW_WORDS) -> DataFrame:
    """The different windows of all items: words (joined by one space) and the ids of the items.

    An item of fewer than `size` words is one window, an item without words or text none. An
    item without an id still marks words but is in no list of ids. Windows shared by items
    and items given twice are one row.
    """
    low = F.translate(F.col(text), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = benchmark.select(
        F.col(item_id).cast("string").alias("item"),
        F.filter(F.split(low, _SPLIT), lambda w: w != "").alias("words"),
    ).where(F.size("words") > 0)
    starts = words.select("item", "words", F.explode(
        F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("words") - (size - 1)))).alias("start"))
    return (
        starts.select("item", F.array_join(F.slice("words", F.col("start"), size), " ").alias("window"))
        .groupBy("window").agg(F.array_sort(F.collect_set("item")).alias("items"))
    )


class _Block:
    """The windows of one block, looked up by one shingle each; made inside a task."""

    def __init__(self, windows: list[bytes], items: list[list[str]], counts: dict[int, int] | None):
        self.windows, self.items = windows, items
        tokens = Tokeniser("letters", lower=True)
        column = pa.array(windows, pa.binary())
        found: dict[int, list[tuple[int, int, int]]] = {}
        self.every: set[int] = set()
        for row, _, words in tokens.slices(column):
            firsts = words.first.tolist()
            for size in (1, SHINGLE_WORDS):
                hashes = grams(words, size)[0].tolist()
                for i in range(len(firsts) - 1):
                    n = firsts[i + 1] - firsts[i]
                    if size != min(n, SHINGLE_WORDS):
                        continue
                    own = hashes[firsts[i]:firsts[i + 1] - size + 1]
                    if counts is None:
                        self.every.update(own)
                    else:  # necessary prefix of one token: the rarest, the first of equals
                        at = min(range(len(own)), key=lambda j: (counts.get(own[j], 0), own[j], j))
                        found.setdefault(own[at], []).append((row + i, at, n))
        self.found = found
        self.keys = np.array(sorted(found if counts is not None else self.every), dtype=np.uint64)
        self.bits = np.zeros(1 << _FILTER_BITS, dtype=bool)
        self.bits[(self.keys >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True
        self.single = counts is None or any(n == 1 for own in found.values() for _, _, n in own)

    def seen(self, words) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places and hashes of the block's shingles among the words."""
        for size in ((1, SHINGLE_WORDS) if self.single else (SHINGLE_WORDS,)):
            hashes, whole = grams(words, size)
            maybe = np.flatnonzero(self.bits[(hashes >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] & whole)
            if len(maybe) and len(self.keys):
                own = hashes[maybe]
                at = np.minimum(np.searchsorted(self.keys, own), len(self.keys) - 1)
                same = self.keys[at] == own
                yield maybe[same], own[same]


def _shingle_counts(documents: DataFrame, text: str, windows: list[bytes]) -> dict[int, int]:
    """How often each shingle of the windows occurs in all documents (bounded by the block)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, tokens = _Block(windows, [], None), Tokeniser("letters", lower=True)
        total = np.zeros(len(block.keys), np.int64)
        for batch in batches:
            for _, _, words in tokens.slices(batch.column(0)):
                for _, own in block.seen(words):
                    total += np.bincount(np.searchsorted(block.keys, own), minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(block.keys[some].view(np.int64)), pa.array(total[some])], ["shingle", "n"])

    rows = documents.select(F.col(text).cast("string")).mapInArrow(run, "shingle long, n long")
    return {r.shingle % (1 << 64): r.n for r in rows.groupBy("shingle").agg(F.sum("n").alias("n")).toLocalIterator()}


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _mark(rows: DataFrame, windows: list[bytes], items: list[list[str]], counts: dict[int, int]) -> DataFrame:
    """Add one block's findings to n_words, spans and items of every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, tokens = _Block(windows, items, counts), Tokeniser("letters", lower=True)
        for batch in batches:
            n_words = np.zeros(batch.num_rows, np.int64)
            spans: dict[int, set] = {}
            found: dict[int, set] = {}
            for row, to, words in tokens.slices(batch.column("__text")):
                n_words[row:to] = np.diff(words.first)
                for places, hashes in block.seen(words):
                    owners = np.searchsorted(words.first, places, side="right") - 1
                    for place, key, owner in zip(places.tolist(), hashes.tolist(), owners.tolist()):
                        low, high = int(words.first[owner]), int(words.first[owner + 1])
                        for window, offset, n in block.found[key]:
                            a = place - offset
                            if a < low or a + n > high or words.text(a, a + n) != block.windows[window]:
                                continue
                            spans.setdefault(row + owner, set()).add((a - low, a - low + n))
                            found.setdefault(row + owner, set()).update(block.items[window])
            all_spans, all_items = batch.column("__spans").to_pylist(), batch.column("__items").to_pylist()
            for i in spans:
                all_spans[i] = [{"start": a, "stop": b} for a, b in
                                _merge([(s["start"], s["stop"]) for s in all_spans[i]] + list(spans[i]))]
                all_items[i] = sorted({*all_items[i], *found[i]})
            made = {"__n_words": pa.array(n_words), "__spans": pa.array(all_spans, batch.schema.field("__spans").type),
                    "__items": pa.array(all_items, batch.schema.field("__items").type)}
            yield pa.RecordBatch.from_arrays(
                [made.get(n, batch.column(i)) for i, n in enumerate(batch.schema.names)], batch.schema.names)

    return rows.mapInArrow(run, rows.schema)


def find_contamination(documents: DataFrame, benchmark: DataFrame, text: str = "text",
                       item_id: str = "item_id", item_text: str = "text", size: int = WINDOW_WORDS,
                       block_windows: int = BLOCK_WINDOWS, keep: list[str] | None = None) -> DataFrame:
    """The kept columns, n_words, n_hit, items (ids as sorted strings) and spans (word ranges that are hit).

    One row per document row, repeated rows included; a null or empty text has no words, and
    an empty benchmark hits nothing. Benchmarks of more than `block_windows` different windows
    are joined block by block, with the documents written in between, so that what is sent to
    the executors stays bounded; the result is the same.
    """
    keep = kept(documents, keep, text, ("n_words", "n_hit", "items", "spans"))
    windows = materialise(item_windows(benchmark, item_id, item_text, size), "item-windows")
    total = windows.count()
    n_blocks = max(1, -(-total // block_windows))
    rows = documents.select(
        *[F.col(f"`{c}`") for c in keep], F.col(text).cast("string").alias("__text"), F.lit(0).cast("long").alias("__n_words"),
        F.array().cast(_WINDOW).alias("__spans"), F.array().cast("array<string>").alias("__items"))
    for i in range(n_blocks):
        mine = windows.where(F.pmod(F.xxhash64("window"), F.lit(n_blocks)) == i).orderBy("window").collect()
        texts, items = [r.window.encode() for r in mine], [r["items"] for r in mine]
        rows = _mark(rows, texts, items, _shingle_counts(documents, text, texts))
        if i + 1 < n_blocks:
            rows = materialise(rows, "marked-documents")
    hit = F.aggregate("__spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    return rows.select(*[F.col(f"`{c}`") for c in keep], F.col("__n_words").alias("n_words"), hit.alias("n_hit"),
                       F.col("__items").alias("items"), F.col("__spans").alias("spans"))
