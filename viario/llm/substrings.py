"""Substring deduplication: words in passages that stand in several places.

1. Sampled phrases: in every window of 35 words the phrase of 8 words with the smallest hash
   is chosen; a passage that recurs has the same chosen phrases everywhere. Phrases are
   counted over all texts, and those found once cannot lie in a recurring window.
2. Around each recurring phrase the windows that chose it form a segment. Segments are dealt
   to shards by their phrase, where passages that really recur are confirmed word by word.
3. Every shard compiles its confirmed passages into an Aho-Corasick automaton (words are the
   letters) and streams all its segments through it, which locates every occurrence.
4. The ranges found are united per text and their words taken out.

Texts are looked at once, whatever their number of copies; copies count as occurrences.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from viario.llm.words import Tokeniser, Words, grams, left
from viario.storage import materialise

cloudpickle.register_pickle_by_value(sys.modules[__name__])

WINDOW_WORDS = 35
PHRASE_WORDS = 8
SHARD_WORDS = 400_000     # words of segments behind one automaton
HELD_BYTES = 16_000_000   # of segments that a task gathers before it sends them
CROWD = 100_000           # phrases with more occurrences are taken apart into their windows
_FIRST_LETTER = 0x10000   # words become letters from here on; about a million are free
_LETTERS = 0x10FFFF - _FIRST_LETTER


def chosen_phrases(words: Words, window: int, phrase: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Phrase hashes by place; the smallest in the window that starts at each place; whether one starts there."""
    hashes, _ = grams(words, phrase)
    n, span = len(hashes), window - phrase + 1
    if n < window:
        return hashes, hashes, np.zeros(n, dtype=bool)
    low, width = hashes.copy(), 1
    while width * 2 <= span:  # minimum over runs of doubling length
        low[:n - width] = np.minimum(low[:n - width], low[width:])
        width *= 2
    rest = span - width
    if rest:
        low[:n - rest] = np.minimum(low[:n - rest], low[rest:])
    return hashes, low, left(words) >= window


def phrase_places(words: Words, window: int, phrase: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the phrases that some window of their text chose."""
    hashes, low, starts = chosen_phrases(words, window, phrase)
    n, span = len(hashes), window - phrase + 1
    if not starts.any():
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    # a phrase is chosen if it is the minimum of a window that starts up to span - 1 places before it
    high = np.where(starts, low, np.uint64(0))
    width = 1
    while width * 2 <= span:
        high[width:] = np.maximum(high[width:], high[:n - width].copy())
        width *= 2
    rest = span - width
    if rest:
        high[rest:] = np.maximum(high[rest:], high[:n - rest].copy())
    inside = left(words) >= phrase
    places = np.flatnonzero(inside & (high == hashes))
    return places, hashes[places]


def _phrases(texts: DataFrame, window: int, phrase: int) -> DataFrame:
    """(phrase, key, key2, times) for the different chosen phrases of each row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokeniser()
        for batch in batches:
            key, key2 = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            for row, _, words in tokens.slices(batch.column(0)):
                places, hashes = phrase_places(words, window, phrase)
                if not len(places):
                    continue
                owner = np.searchsorted(words.first, places, side="right") - 1
                order = np.lexsort((hashes, owner))
                owner, hashes = owner[order], hashes[order]
                new = np.ones(len(order), dtype=bool)
                new[1:] = (owner[1:] != owner[:-1]) | (hashes[1:] != hashes[:-1])
                first = np.flatnonzero(new)
                own = owner[first] + row
                yield pa.RecordBatch.from_arrays(
                    [pa.array(hashes[first].view(np.int64)), pa.array(key[own]), pa.array(key2[own]),
                     pa.array(np.diff([*first, len(order)]), pa.int64())], ["phrase", "key", "key2", "times"])

    return texts.select("text", "key", "key2").mapInArrow(run, "phrase long, key long, key2 long, times long")


_OCCURRENCES = ["keys", "keys2", "copies", "starts"]


def _segments(texts: DataFrame, window: int, phrase: int, each_window: bool) -> DataFrame:
    """The words of the windows that chose one of a text's `phrases`: runs of neighbours, or each on its own.

    `name` is the phrase, or the hash of the window, so that equal passages have equal names.
    Equal passages of the texts at hand are one row with a list of their places, so what many
    texts share is sent once per task and not once per text.
    """
    names = ["name", "words", *_OCCURRENCES]
    kinds = [pa.int64(), pa.string(), *[pa.list_(pa.int64())] * 4]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokeniser()
        found: dict[tuple[int, bytes], tuple[list, list, list, list]] = {}
        size = 0

        def flush() -> pa.RecordBatch:
            columns = [[n - (n >> 63 << 64) for n, _ in found], [t for _, t in found]]
            columns += [[places[c] for places in found.values()] for c in range(4)]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

        for batch in batches:
            own = [c.to_pylist() for c in batch.columns[1:4]]
            wanted = [np.array(v, np.int64).view(np.uint64) for v in batch.column(4).to_pylist()]
            for row, to, words in tokens.slices(batch.column(0)):
                hashes, low, starts = chosen_phrases(words, window, phrase)
                for i in range(row, to):
                    first, stop = words.first[i - row:i - row + 2].tolist()
                    at = first + np.flatnonzero(starts[first:stop] & np.isin(low[first:stop], wanted[i]))
                    if not len(at):
                        continue
                    if each_window:
                        runs = zip(at.tolist(), at.tolist())
                    else:  # neighbours that chose the same phrase
                        cut = np.flatnonzero((np.diff(at) > 1) | (low[at[1:]] != low[at[:-1]]))
                        runs = zip(at[[0, *(cut + 1)]].tolist(), at[[*cut, len(at) - 1]].tolist())
                    for a, b in runs:
                        text = words.text(a, b + window)
                        places = found.get((int(low[a]), text))
                        if places is None:
                            places = found[int(low[a]), text] = ([], [], [], [])
                            size += len(text) + 200
                        for column, value in zip(places, (own[0][i], own[1][i], own[2][i], a - first)):
                            column.append(value)
                        size += 40
                if size > HELD_BYTES:
                    yield flush()
                    found.clear()
                    size = 0
        if found:
            yield flush()

    schema = "name long, words string, keys array<long>, keys2 array<long>, copies array<long>, starts array<long>"
    segments = texts.select("text", "key", "key2", "copies", "phrases").mapInArrow(run, schema)
    return segments.withColumn("name", F.xxhash64("words")) if each_window else segments


class _Shard:
    """Segments whose passages are in one automaton."""

    def __init__(self, window: int):
        self.window, self.size = window, 0
        self.letters: dict[str, int] = {}
        self.rows: list[tuple[str, list, list, list]] = []  # segment in letters, its places: keys and starts
        self.passages: set[str] = set()
        self.group: dict[str, int] = {}                   # segments of the phrase at hand, with their number

    def add(self, words: str, keys: list[int], keys2: list[int], copies: list[int], starts: list[int]) -> None:
        letters = self.letters
        text = "".join([chr(_FIRST_LETTER + letters.setdefault(w, len(letters))) for w in words.split(" ")])
        self.rows.append((text, keys, keys2, starts))
        self.group[text] = self.group.get(text, 0) + sum(copies)
        self.size += len(text) + len(keys)

    def close_group(self) -> None:
        """Confirm the longest passages of the group in which every window stands more than once."""
        n, group, self.group = self.window, self.group, {}
        if len(group) == 1:
            (text, times), = group.items()
            if times > 1 or len(text) == n:
                if times > 1:
                    self.passages.add(text)
                return
        counts: dict[str, int] = {}
        for text, times in group.items():
            for i in range(len(text) - n + 1):
                counts[text[i:i + n]] = counts.get(text[i:i + n], 0) + times
        for text in group:
            begun = None
            for i in range(len(text) - n + 2):
                more = i <= len(text) - n and counts[text[i:i + n]] > 1
                if more and begun is None:
                    begun = i
                elif not more and begun is not None:
                    self.passages.add(text[begun:i - 1 + n])
                    begun = None

    def occurrences(self) -> pa.RecordBatch:
        """(key, key2, start, stop) of the words in confirmed passages, wherever the automaton finds one."""
        import ahocorasick

        found: list[tuple[int, int, int, int]] = []
        if self.passages:
            machine = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
            for text in self.passages:
                machine.add_word(text)
            machine.make_automaton()
            for text, keys, keys2, starts in self.rows:
                spans: list[tuple[int, int]] = []
                for last, length in machine.iter(text):
                    a = last + 1 - length
                    while spans and spans[-1][1] >= a:  # ends come in order
                        a = min(a, spans.pop()[0])
                    spans.append((a, last + 1))
                found += [(k, k2, s + a, s + b) for k, k2, s in zip(keys, keys2, starts) for a, b in spans]
        table = np.array(found, dtype=np.int64).reshape(-1, 4)
        return pa.RecordBatch.from_arrays([pa.array(table[:, i]) for i in range(4)], ["key", "key2", "start", "stop"])


def _locate(segments: DataFrame, window: int, shard_words: int) -> DataFrame:
    """Ranges (key, key2, start, stop) of words in confirmed passages."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, group = _Shard(window), None
        for batch in batches:
            for name, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if name != group:
                    shard.close_group()
                    group = name
                    if shard.size > shard_words or len(shard.letters) > _LETTERS // 2:
                        yield shard.occurrences()
                        shard = _Shard(window)
                shard.add(*row)
        shard.close_group()
        yield shard.occurrences()

    dealt = segments.select("name", "words", *_OCCURRENCES).repartition("name")
    return dealt.sortWithinPartitions("name").mapInArrow(run, "key long, key2 long, start long, stop long")


def _remove(texts: DataFrame, digest: bool) -> DataFrame:
    """key, key2, n_words, n_removed and kept_text (null if nothing is removed) from text and spans.

    `digest` gives kept_sha256, of the words that are left in every text, in place of kept_text.
    """
    last = "kept_sha256" if digest else "kept_text"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokeniser()
        for batch in batches:
            spans = batch.column(3).to_pylist()
            n_words, n_removed = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            text: list[bytes | None] = [None] * batch.num_rows
            for row, to, words in tokens.slices(batch.column(0)):
                n_words[row:to] = np.diff(words.first)
                for i in range(row, to):
                    if spans[i]:
                        first, at, parts = int(words.first[i - row]), 0, []
                        for s in sorted(spans[i], key=lambda s: s["start"]):
                            if s["start"] > at:
                                parts.append(words.text(first + at, first + s["start"]))
                                n_removed[i] -= s["start"] - at
                            at = max(at, s["stop"])
                        if at < n_words[i]:
                            parts.append(words.text(first + at, first + int(n_words[i])))
                            n_removed[i] -= n_words[i] - at
                        n_removed[i] += n_words[i]
                        text[i] = b" ".join(parts)
                    if digest:
                        a, b = words.first[i - row:i - row + 2].tolist()
                        text[i] = hashlib.sha256(words.text(a, b) if text[i] is None else text[i]).hexdigest().encode()
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), batch.column(2), pa.array(n_words), pa.array(n_removed),
                 pa.array(text, pa.binary()).cast(pa.string())], ["key", "key2", "n_words", "n_removed", last])

    # copies comes along so that this and the segments read one and the same exchange of texts
    return texts.select("text", "key", "key2", "spans", "copies").mapInArrow(
        run, f"key long, key2 long, n_words long, n_removed long, {last} string")


def find_repeated(documents: DataFrame, text: str = "text", window: int = WINDOW_WORDS, phrase: int = PHRASE_WORDS,
                  shard_words: int = SHARD_WORDS, crowd: int = CROWD, digest: bool = False) -> tuple[DataFrame, DataFrame]:
    """The texts without the words that a recurring window covers, and the documents with keys to them.

    A window is `window` consecutive words of one text; it recurs if its words start anywhere
    else, the same text and copies of it included. The first frame has a row per different text
    (null as empty): key, key2, n_words, n_removed and kept_text (the words left, joined by one
    space; null if nothing is removed) or, with `digest`, kept_sha256 of the words left. The
    second has all documents with __key and __key2.
    """
    whole = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    keyed = documents.withColumns({"__key": F.xxhash64(whole), "__key2": F.xxhash64(F.lit(1), whole)})
    rows = keyed.select(whole.alias("text"), F.col("__key").alias("key"), F.col("__key2").alias("key2"))
    phrases = materialise(_phrases(rows, window, phrase), "phrases")
    often = phrases.groupBy("phrase").agg(F.sum("times").alias("n")).where("n > 1")
    sets = phrases.join(often, "phrase").groupBy("key", "key2").agg(
        F.collect_set(F.when(F.col("n") <= crowd, F.col("phrase"))).alias("some"),
        F.collect_set(F.when(F.col("n") > crowd, F.col("phrase"))).alias("crowds"))
    texts = rows.groupBy("key", "key2").agg(F.first("text").alias("text"), F.count("*").alias("copies"))
    held = texts.join(sets, ["key", "key2"])
    plain = held.where(F.size("some") > 0).withColumn("phrases", F.col("some"))
    ranges = _locate(_segments(plain, window, phrase, each_window=False), window, shard_words)
    crowded = held.where(F.size("crowds") > 0).withColumn("phrases", F.col("crowds"))
    if not often.where(F.col("n") > crowd).isEmpty():
        # Windows of crowded phrases are added up before they are dealt, and found again by their hash.
        windows = _segments(crowded, window, phrase, each_window=True).withColumn("name2", F.xxhash64(F.lit(1), "words"))
        times = F.aggregate("copies", F.lit(0).cast("long"), lambda n, c: n + c)
        added = windows.groupBy("name", "name2", "words").agg(F.sum(times).alias("n"))
        known = _locate(added.select(
            "name", "words", F.array("name").alias("keys"), F.array("name2").alias("keys2"), F.array("n").alias("copies"),
            F.array(F.lit(0).cast("long")).alias("starts")), window, shard_words)
        known = known.select(F.col("key").alias("name"), F.col("key2").alias("name2"), (F.col("stop") - F.col("start")).alias("n"))
        places = windows.join(known, ["name", "name2"]).select("n", F.explode(F.arrays_zip("keys", "keys2", "starts")).alias("p"))
        ranges = ranges.union(places.select("p.keys", "p.keys2", "p.starts", F.col("p.starts") + F.col("n")))
    spans = ranges.groupBy("key", "key2").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    return _remove(texts.join(spans, ["key", "key2"], "left"), digest), keyed


def remove_repeated(documents: DataFrame, text: str = "text", **options) -> DataFrame:
    """The documents with n_words, n_removed and kept_text (or kept_sha256), one row per document row.

    A null or empty text has no words; texts of fewer words than a window keep all. kept_text
    is null if nothing is removed. Columns of these names are replaced. The documents are
    shuffled with all their columns but, with `digest`, the text.
    """
    found, keyed = find_repeated(documents, text, **options)
    made = ("n_words", "n_removed", "kept_text", "kept_sha256", *([text] if options.get("digest") else []))
    own = keyed.select(*[F.col(f"`{c}`") for c in documents.columns if c not in made], "__key", "__key2")
    found = found.withColumnsRenamed({"key": "__key", "key2": "__key2"})
    return own.join(found, ["__key", "__key2"]).drop("__key", "__key2")
