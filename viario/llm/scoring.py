"""Language-model scores from a weighted backoff automaton over word n-grams.

Counting and looking up are two shuffles. Documents are dealt into blocks; a block sends its
different n-grams with their training counts to shards, each shard adds up what all blocks
sent, and every block gets the totals of just its n-grams back. From them a block builds its
part of the automaton: an n-gram seen in training is a state, reading a word follows its arc
or, where there is none, a failure arc to the next shorter state. One traversal from left to
right carries the state and adds up log-probabilities; the texts of a block go on side by side.

p(w | h) = (c(hw) + K p(w | h')) / (c(h) + K), with h' the context without its first word and
p(w) = (c(w) + 0.1) / (N + 0.1 (V + 1)). A context that was not seen has no state.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F

from viario.llm.words import Tokeniser, Words, grams, kept

cloudpickle.register_pickle_by_value(sys.modules[__name__])

ORDER = 3
STRENGTH = 300.0          # K
KEY_BITS = 17             # of a key beyond those that number the bytes of all texts
STRETCH = 256             # words of a text read by one traversal
BLOCK_BYTES = 4_000_000   # of text in a block
SHARD_GRAMS = 2_500_000   # n-grams sent to a shard, about
_END = 0xA0761D6478BD642E
_ADD = 0.1


def pack(numbers: np.ndarray) -> bytes:
    """64-bit numbers by byte planes, compressed: of most numbers the high bytes are alike."""
    planes = np.ascontiguousarray(numbers.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(planes.reshape(8, -1).T).view("<u8").reshape(-1)


def _differences(keys: np.ndarray) -> np.ndarray:
    return np.diff(keys, prepend=np.uint64(0))


class Grams:
    """The n-grams of some texts, each text ending with an end token."""

    def __init__(self, texts: pa.ChunkedArray, order: int, bits: int = 64):
        self.bits = bits
        tokens = Tokeniser("printing", lower=True)
        parts, lengths = [], []
        for _, _, words in tokens.slices(texts):
            parts.append(np.insert(words.hash, words.first[1:], np.uint64(_END)))
            lengths.append(np.diff(words.first) + 1)
        self.length = np.concatenate([np.zeros(0, np.int64), *lengths])
        self.first = np.concatenate([[0], np.cumsum(self.length)]).astype(np.int64)
        sequence = Words(None, None, None, np.concatenate([np.zeros(0, np.uint64), *parts]), self.first)
        self.places, keys = [], []
        for m in range(1, order + 1):
            hashes, whole = grams(sequence, m)
            at = np.flatnonzero(whole)
            self.places.append(at.astype(np.int32))
            # the lowest bit tells single words from longer n-grams
            named = (hashes[at] + np.uint64(2 * m)) >> np.uint64(65 - bits)
            keys.append(named << np.uint64(1) | np.uint64(m == 1))
            del hashes, whole, at, named
        del parts, sequence
        together = np.concatenate(keys)
        del keys
        self.keys, number = np.unique(together, return_inverse=True)
        self.number = number.astype(np.int32)
        self.bounds = np.cumsum([0, *map(len, self.places)])

    def shards(self, n: int) -> np.ndarray:
        """Borders between the keys of each shard; a shard is a range of keys."""
        step = (1 << self.bits) // n + 1
        return np.searchsorted(self.keys, np.array([min(i * step, (1 << self.bits) - 1) for i in range(1, n)], dtype=np.uint64))


def _count(order: int, n_shards: int, bits: int):
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        own = Grams(rows.column("__text"), order, bits)
        train = np.repeat(rows.column("__train").combine_chunks().to_numpy(zero_copy_only=False), own.length)
        counts = np.zeros(len(own.keys), np.int64)
        for m, at in enumerate(own.places):
            number = own.number[own.bounds[m]:own.bounds[m + 1]]
            counts += np.bincount(number[train[at]], minlength=len(counts))
        cuts = [0, *own.shards(n_shards).tolist(), len(own.keys)]
        made = [(s, a, b) for s, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])) if a < b]
        return pa.table({
            "__block": pa.array([key[0].as_py()] * len(made), pa.int32()), "shard": pa.array([s for s, _, _ in made], pa.int32()),
            "keys": pa.array([pack(_differences(own.keys[a:b])) for _, a, b in made], pa.binary()),
            "counts": pa.array([pack(counts[a:b]) for _, a, b in made], pa.binary())})

    return run


def _add(key: tuple, rows: pa.Table) -> pa.Table:
    """One shard: the totals for each block, and once the number of training tokens and types."""
    keys = [np.cumsum(unpack(k.as_py()), dtype=np.uint64) for k in rows.column("keys")]
    sizes = np.cumsum([0, *map(len, keys)])
    own, number = np.unique(np.concatenate(keys), return_inverse=True)
    counts = np.concatenate([unpack(c.as_py()) for c in rows.column("counts")])
    total = np.zeros(len(own), np.uint64)
    np.add.at(total, number, counts)
    single = (own & np.uint64(1)).astype(bool)
    found = total[number]
    once = [0] * (rows.num_rows - 1)
    return pa.table({
        "__block": rows.column("__block"), "shard": rows.column("shard"),
        "counts": pa.array([pack(found[a:b]) for a, b in zip(sizes[:-1], sizes[1:])], pa.binary()),
        "tokens": pa.array([int(total[single].sum()), *once], pa.int64()),
        "types": pa.array([int((total[single] > 0).sum()), *once], pa.int64())})


class Automaton:
    """States, arcs and failure arcs of the n-grams of one block; state 0 is the root."""

    def __init__(self, own: Grams, counts: np.ndarray, n_tokens: int, n_types: int, strength: float):
        unit = [own.number[own.bounds[m]:own.bounds[m + 1]] for m in range(len(own.places))]
        place = [np.full(own.first[-1] + 1, -1, np.int32) for _ in unit]  # n-gram that starts at a place
        for p, at, number in zip(place, own.places, unit):
            p[at] = number
        self.order, self.first = len(unit), own.first
        self.word = place[0][:-1]
        count = counts.astype(np.float64)
        chance = (count + _ADD) / (n_tokens + _ADD * (n_types + 1))
        n_states = int((counts > 0).sum()) + 1
        state = np.zeros(len(count) + 1, np.int64)      # of an n-gram
        state[np.flatnonzero(counts > 0)] = np.arange(1, n_states)
        self.fail, self.back = np.zeros(n_states, np.int64), np.zeros(n_states)
        self.root = np.log10(chance)                     # by word
        self.after = state                               # state after reading a word at the root
        self.width = len(count) + 1
        arcs, weights, ends = [np.zeros(0, np.int64)], [np.zeros(0)], [np.zeros(0, np.int64)]
        for m in range(1, self.order + 1):
            numbers, at = np.unique(unit[m - 1], return_index=True)
            at = own.places[m - 1][at].astype(np.int64)
            seen = counts[numbers] > 0
            numbers, at = numbers[seen], at[seen]
            if m > 1:
                context, rest = place[m - 2][at], place[m - 2][at + 1]
                chance[numbers] = (count[numbers] + strength * chance[rest]) / (count[context] + strength)
                arcs.append(state[context] * self.width + place[0][at + m - 1])
                weights.append(np.log10(chance[numbers]))
                ends.append(state[numbers if m < self.order else rest])
            if m < self.order:
                self.fail[state[numbers]] = state[place[m - 2][at + 1]] if m > 1 else 0
                self.back[state[numbers]] = np.log10(strength / (count[numbers] + strength))
        arc = np.concatenate(arcs)
        order = np.argsort(arc)
        self.arc = np.append(arc[order], np.int64(np.iinfo(np.int64).max))  # the last one is never followed
        self.weight, self.next = np.concatenate(weights)[order], np.concatenate(ends)[order]

    def read(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The next states and the log10 probabilities, one word read from each state."""
        gain, after = np.zeros(len(word)), np.zeros(len(word), np.int64)
        todo = np.arange(len(word))
        while len(todo):
            root = state == 0
            at = todo[root]
            gain[at] += self.root[word[root]]
            after[at] = self.after[word[root]]
            todo, state, word = todo[~root], state[~root], word[~root]
            key = state * self.width + word
            arc = np.searchsorted(self.arc, key)
            follow = self.arc[arc] == key
            at = todo[follow]
            gain[at] += self.weight[arc[follow]]
            after[at] = self.next[arc[follow]]
            todo, state, word = todo[~follow], state[~follow], word[~follow]
            gain[todo] += self.back[state]
            state = self.fail[state]
        return after, gain

    def scores(self) -> np.ndarray:
        """The log10 probability of every text, read from left to right.

        Texts go on side by side. A long one is read in stretches, each of which starts from the
        root some words early: a state depends on the last order - 1 words only, so it has the
        right one when its own words begin."""
        n = np.diff(self.first)
        stretches = np.maximum(1, -(-n // STRETCH))
        text = np.repeat(np.arange(len(n)), stretches)
        begin = self.first[text] + STRETCH * (np.arange(len(text)) - np.repeat(np.cumsum(stretches) - stretches, stretches))
        stop = np.minimum(begin + STRETCH, self.first[text + 1])
        early = np.maximum(begin - (self.order - 1), self.first[text])
        longest = np.argsort(early - stop, kind="stable")
        text, begin, stop, early = text[longest], begin[longest], stop[longest], early[longest]
        state, total = np.zeros(len(text), np.int64), np.zeros(len(text))
        for step in range(int((stop - early).max(initial=0))):
            k = int(np.searchsorted(early - stop, -step, side="left"))   # those that have a word left
            at = early[:k] + step
            state[:k], gain = self.read(state[:k], self.word[at])
            total[:k] += np.where(at >= begin[:k], gain, 0.0)
        return np.bincount(text, weights=total, minlength=len(n))


def _score(order: int, strength: float, names: list[str], bits: int):
    made = ("n_tokens", "n_known", "train_tokens", "base_score", "score")

    def run(key: tuple, rows: pa.Table, replies: pa.Table) -> pa.Table:
        own = Grams(rows.column("__text"), order, bits)
        replies = replies.sort_by("shard")
        counts = np.concatenate([np.zeros(0, np.uint64), *(unpack(c.as_py()) for c in replies.column("counts"))]).astype(np.int64)
        n_tokens, n_types = replies.column("n_tokens")[0].as_py(), replies.column("n_types")[0].as_py()
        machine = Automaton(own, counts, n_tokens, n_types, strength)
        word = machine.word
        starts = own.first[:-1]
        known = np.add.reduceat((counts[word] > 0).astype(np.int64), starts)
        base = np.add.reduceat(machine.root[word], starts)
        score = machine.scores()
        out = {n: rows.column(n) for n in names}
        values = (own.length, known, np.full(len(score), n_tokens, np.int64), base, score)
        return pa.table({**out, **{n: pa.array(v) for n, v in zip(made, values)}})

    return run


def score_documents(documents: DataFrame, train: Column, text: str = "text", keep: list[str] | None = None,
                    order: int = ORDER, strength: float = STRENGTH) -> DataFrame:
    """The kept columns, n_tokens, n_known, train_tokens, base_score and score (log10) of every row.

    The model learns from the rows where `train` is true (null counts as false). Words are
    lower-cased in A to Z; an end token closes every text, so null and empty texts have one
    token. n_known counts the tokens seen in training, base_score is that of single words alone.
    All counts cover all training rows. Blocks and shards grow in number with the text, not in
    size; rows that are equal in id and text meet in one block. No training rows leave every
    word with the same chance.
    """
    keep = kept(documents, keep, text, ("n_tokens", "n_known", "train_tokens", "base_score", "score"))
    names = [f"__k{i}" for i in range(len(keep))]
    whole = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    rows = documents.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(keep, names)], whole.alias("__text"),
                            F.coalesce(train, F.lit(False)).alias("__train"))
    size = rows.agg(F.sum(F.octet_length("__text") + 8)).first()[0] or 0
    n_blocks = max(1, -(-size // BLOCK_BYTES))
    # Bits of a key: an n-gram shares its key with another one in at most eight of a million cases, at any size.
    bits = min(64, size.bit_length() + KEY_BITS)
    n_shards = max(1, -(-size * order // (6 * SHARD_GRAMS)))
    block = F.pmod(F.xxhash64(*names, "__text"), F.lit(n_blocks)).cast("int")
    blocks = rows.withColumn("__block", block).repartition("__block")
    # All columns go in, also those that counting has no need of, so that both uses share one exchange.
    sent = blocks.groupBy("__block").applyInArrow(
        _count(order, n_shards, bits), "__block int, shard int, keys binary, counts binary")
    replies = sent.groupBy("shard").applyInArrow(
        _add, "__block int, shard int, counts binary, tokens long, types long")
    totals = replies.agg(F.struct(F.sum("tokens").alias("tokens"), F.sum("types").alias("types")).alias("t"))
    answers = replies.select("__block", "shard", "counts").withColumn("t", totals.scalar()).select(
        "__block", "shard", "counts", F.col("t.tokens").alias("n_tokens"), F.col("t.types").alias("n_types"))
    schema = rows.select(*names).schema
    for name, kind in (("n_tokens", "long"), ("n_known", "long"), ("train_tokens", "long"), ("base_score", "double"), ("score", "double")):
        schema = schema.add(name, kind)
    scored = blocks.groupBy("__block").cogroup(answers.groupBy("__block")).applyInArrow(_score(order, strength, names, bits), schema)
    return scored.select(*[F.col(n).alias(c) for c, n in zip(keep, names)], *[f.name for f in schema.fields[len(names):]])

