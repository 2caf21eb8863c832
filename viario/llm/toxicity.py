"""Toxicity by a bidirectional gated recurrent network with attention pooling, in numpy.

A word goes in as its own vector, if the training sample knows it, and as the mean of the
vectors of its character trigrams. Two gated recurrent passes read a window of words,
attention weighs the places, and one output tells how likely the window is toxic. All windows
of a text, each overlapping half of the next, are scored; the text has the highest.

Training: only texts are labelled, so a text's output is the soft maximum over its most
suspicious windows, at first those with the most telling words.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from viario.llm.words import Tokeniser, Words, kept, mix

cloudpickle.register_pickle_by_value(sys.modules[__name__])

WINDOW, STEP = 32, 16
WORD_SIZE, CHAR_SIZE, HIDDEN, ATTENTION = 12, 8, 8, 8
CHAR_ROWS = 4096
SAMPLE = {1: 600, 0: 1800}   # labelled texts to learn from, at most, by label
SAMPLE_CHARS = 20_000        # of each of them
MIN_TEXTS = 3                # of the sample that must have a word for it to get a vector
ROUNDS, BATCH, SUSPECTS, RATE = 11, 64, 3, 0.01
HELD_BACK = 5                # every fifth text of the sample only calibrates
AT_ONCE = 4096               # windows that go through the network together
_PAD = -1


def windows(first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers (rows of WINDOW, -1 beyond the text) of all windows, and the text of each."""
    counts = np.diff(first)
    each = np.where(counts > 0, 1 + np.maximum(0, -(-(counts - WINDOW) // STEP)), 0)
    owner = np.repeat(np.arange(len(counts)), each)
    start = (np.arange(len(owner)) - np.repeat(np.cumsum(each) - each, each)) * STEP
    place = start[:, None] + np.arange(WINDOW)
    return np.where(place < counts[owner][:, None], first[owner][:, None] + place, _PAD), owner


def trigrams(words: Words, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the character table for the trigrams of some words (edges marked), flat, and how many each word has."""
    length = (words.end - words.start)[which]
    border = np.concatenate([[0], np.cumsum(length + 2)])
    at = np.arange(border[-1]) - np.repeat(border[:-1], length + 2)
    source = np.repeat(words.start[which], length + 2) + at - 1
    letter = words.data[np.clip(source, 0, max(0, len(words.data) - 1))].astype(np.uint64) + np.uint64(1)
    letter[border[:-1]] = 0
    letter[border[1:] - 1] = 0
    first = np.repeat(border[:-1], length) + (np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length))
    code = (letter[first] << np.uint64(18)) | (letter[first + 1] << np.uint64(9)) | letter[first + 2]
    return (mix(code + np.uint64(1)) % np.uint64(CHAR_ROWS)).astype(np.int64), length


class Network:
    """Parameters, and the passes through them, over a table of the different words at hand."""

    def __init__(self, vocabulary: np.ndarray, seed: int = 1):
        rng = np.random.default_rng(seed)
        size, gates = WORD_SIZE + CHAR_SIZE, 3 * HIDDEN

        def start(rows: int, columns: int) -> np.ndarray:
            return (rng.standard_normal((rows, columns)) / np.sqrt(rows)).astype(np.float32)

        self.vocabulary = vocabulary  # sorted word hashes
        self.p = {
            "word": start(len(vocabulary) + 1, WORD_SIZE) * 0.1, "char": start(CHAR_ROWS, CHAR_SIZE),
            "wa": start(2 * HIDDEN, ATTENTION), "ba": np.zeros(ATTENTION, np.float32),
            "va": start(ATTENTION, 1)[:, 0], "wo": start(2 * HIDDEN, 1)[:, 0], "bo": np.full(1, -1, np.float32)}
        for way in ("f", "b"):
            self.p |= {"w" + way: start(size, gates), "c" + way: np.zeros(gates, np.float32), "u" + way: start(HIDDEN, gates)}
        self.p["word"][-1] = 0  # unknown words
        self.scale, self.shift = 1.0, 0.0

    def table(self, words: Words) -> tuple[np.ndarray, np.ndarray, tuple]:
        """Inputs of the different words, the row of each word in them, and what training needs of it."""
        _, which, row = np.unique(words.hash, return_index=True, return_inverse=True)
        hashes = words.hash[which]
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), max(0, len(self.vocabulary) - 1))
        known = np.full(len(hashes), len(self.vocabulary))
        if len(self.vocabulary):
            known = np.where(self.vocabulary[at] == hashes, at, known)
        flat, length = trigrams(words, which)
        return *self.inputs(known, flat, length), row

    def inputs(self, known: np.ndarray, flat: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, tuple]:
        begin = np.cumsum(length) - length
        chars = np.add.reduceat(self.p["char"][flat], begin, axis=0) if len(flat) else np.zeros((0, CHAR_SIZE), np.float32)
        chars = chars / length[:, None].astype(np.float32)
        return np.concatenate([self.p["word"][known], chars], axis=1), (known, flat, length)

    def read(self, x: np.ndarray, rows: np.ndarray, way: str, keep: bool = False):
        """States after each word, in the order of the text, for rows of table numbers (-1: no word)."""
        weights, u = x @ self.p["w" + way] + self.p["c" + way], self.p["u" + way]
        n, h = rows.shape[0], HIDDEN
        state, out, tape = np.zeros((n, h), np.float32), np.empty((n, rows.shape[1], h), np.float32), []
        steps = range(rows.shape[1]) if way == "f" else range(rows.shape[1] - 1, -1, -1)
        full = bool((rows >= 0).all())
        for t in steps:
            inside = True if full else (rows[:, t] >= 0)[:, None]
            g, r = weights[rows[:, t]], state @ u
            gate = g[:, :2 * h] + r[:, :2 * h]
            np.negative(gate, out=gate)
            np.exp(gate, out=gate)
            gate += 1
            np.reciprocal(gate, out=gate)
            z, reset = gate[:, :h], gate[:, h:]
            new = np.tanh(g[:, 2 * h:] + reset * r[:, 2 * h:])
            if keep:
                tape.append((t, inside, state, z, reset, new, r[:, 2 * h:]))
            after = new + z * (state - new)
            state = after if full else np.where(inside, after, state)
            out[:, t] = state
        return out, tape

    def forward(self, x: np.ndarray, rows: np.ndarray, keep: bool = False):
        """The output of each window, before the logistic function."""
        p = self.p
        front, tape_f = self.read(x, rows, "f", keep)
        back, tape_b = self.read(x, rows, "b", keep)
        both = np.concatenate([front, back], axis=2)
        u = np.tanh(both @ p["wa"] + p["ba"])
        score = np.where(rows >= 0, u @ p["va"], -1e9)
        weight = np.exp(score - score.max(axis=1, keepdims=True))
        weight /= weight.sum(axis=1, keepdims=True)
        pooled = np.einsum("bt,bth->bh", weight, both)
        return pooled @ p["wo"] + p["bo"][0], (x, rows, both, u, weight, pooled, tape_f, tape_b)

    def backward(self, d: np.ndarray, kept_values: tuple, source: tuple) -> dict[str, np.ndarray]:
        """Gradients for the derivative `d` of the loss by each window's output."""
        p, (x, rows, both, u, weight, pooled, tape_f, tape_b) = self.p, kept_values
        grad = {"wo": pooled.T @ d, "bo": np.array([d.sum()])}
        d_pooled = d[:, None] * p["wo"]
        d_weight = np.einsum("bth,bh->bt", both, d_pooled)
        d_both = weight[:, :, None] * d_pooled[:, None, :]
        d_score = weight * (d_weight - (weight * d_weight).sum(axis=1, keepdims=True))
        grad["va"] = np.einsum("bt,bta->a", d_score, u)
        d_u = d_score[:, :, None] * p["va"] * (1 - u * u)
        grad["wa"], grad["ba"] = np.einsum("bth,bta->ha", both, d_u), d_u.sum(axis=(0, 1))
        d_both += d_u @ p["wa"].T
        d_x = np.zeros_like(x)
        h = HIDDEN
        for way, tape, d_out in (("f", tape_f, d_both[:, :, :h]), ("b", tape_b, d_both[:, :, h:])):
            uw, d_u_way = p["u" + way], np.zeros_like(p["u" + way])
            d_gates, d_state = np.zeros((len(x), 3 * h), np.float32), np.zeros((len(rows), h), np.float32)
            for t, inside, before, z, reset, new, r_new in reversed(tape):
                d_state = d_state + d_out[:, t]
                d_now = np.where(inside, d_state, 0)
                d_before = d_state - d_now + d_now * z
                d_new = d_now * (1 - z) * (1 - new * new)
                d_z = d_now * (before - new) * z * (1 - z)
                d_reset = d_new * r_new * reset * (1 - reset)
                d_r = np.concatenate([d_z, d_reset, d_new * reset], axis=1)
                np.add.at(d_gates, np.maximum(rows[:, t], 0), np.concatenate([d_z, d_reset, d_new], axis=1))
                d_u_way += before.T @ d_r
                d_state = d_before + d_r @ uw.T
            grad |= {"u" + way: d_u_way, "w" + way: x.T @ d_gates, "c" + way: d_gates.sum(axis=0)}
            d_x += d_gates @ p["w" + way].T
        known, flat, length = source
        grad["word"], grad["char"] = np.zeros_like(p["word"]), np.zeros_like(p["char"])
        np.add.at(grad["word"], known, d_x[:, :WORD_SIZE])
        np.add.at(grad["char"], flat, np.repeat(d_x[:, WORD_SIZE:] / length[:, None], length, axis=0))
        grad["word"][-1] = 0
        return grad

    def texts(self, words: Words) -> np.ndarray:
        """The highest output over the windows of each text; minus infinity without words."""
        best = np.full(len(words.first) - 1, -np.inf)
        places, owner = windows(words.first)
        if len(places):
            x, _, row = self.table(words)
            rows = np.where(places >= 0, row[places], _PAD)
            whole = rows[:, -1] >= 0  # windows without gaps need no masks
            for some in (np.flatnonzero(whole), np.flatnonzero(~whole)):
                for part in np.array_split(some, -(-len(some) // AT_ONCE)) if len(some) else ():
                    np.maximum.at(best, owner[part], self.forward(x, rows[part])[0])
        return best

    def probability(self, output: np.ndarray) -> np.ndarray:
        return np.where(np.isfinite(output), 1 / (1 + np.exp(-np.clip(self.scale * output + self.shift, -700, 700))), 0.0)


def _telling(words: Words, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words in enough texts, sorted by hash, and how strongly each stands for toxic texts (a z-value)."""
    text = np.repeat(np.arange(len(labels)), np.diff(words.first))
    names, row = np.unique(words.hash, return_inverse=True)
    pairs = np.unique(row * len(labels) + text)  # a word counts once in a text
    row, toxic = pairs // len(labels), labels[pairs % len(labels)]
    a, b = np.bincount(row, toxic, len(names)), np.bincount(row, 1 - toxic, len(names))
    some = a + b >= MIN_TEXTS
    odds = np.log((a + 1) / (labels.sum() + 2)) - np.log((b + 1) / ((1 - labels).sum() + 2))
    return names[some], (odds / np.sqrt(1 / (a + 1) + 1 / (b + 1)))[some]


def train(texts: list[str], labels: list[int], share: float | None = None, seed: int = 1, rounds: int = ROUNDS) -> Network | None:
    """A network fitted to labelled texts; None unless both labels are there.

    `share` is the share of toxic texts to expect; without it the sample's.
    """
    label = np.array(labels, np.int64)
    if not len(texts) or label.min() == label.max():
        return None
    words = _all_words(texts)
    learn = np.arange(len(texts)) % HELD_BACK != 0
    if len({*label[learn].tolist()}) < 2 or len({*label[~learn].tolist()}) < 2:
        learn[:] = True
    some = np.repeat(learn, np.diff(words.first))
    own = Words(words.data, words.start[some], words.end[some], words.hash[some],
                np.concatenate([[0], np.cumsum(np.diff(words.first)[learn])]))
    vocabulary, telling = _telling(own, label[learn])
    net = Network(vocabulary, seed)
    net.p["word"][:-1, 0] = telling / 4
    x, source, row = net.table(words)
    places, owner = windows(words.first)
    rows = np.where(places >= 0, row[places], _PAD).astype(np.int32)
    del places
    hint = np.append(np.append(telling, 0.0)[source[0]], -np.inf)[rows].max(axis=1)
    border = np.searchsorted(owner, np.arange(len(texts) + 1))
    rng = np.random.default_rng(seed)
    sums = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    todo, step = np.flatnonzero(learn & (np.diff(border) > 0)), 0
    weight = np.where(label == 1, 0.5 / max(1, label[todo].sum()), 0.5 / max(1, (1 - label[todo]).sum())) * len(todo)
    output = hint.copy()  # of every window; looked up anew every other turn
    for turn in range(rounds):
        for batch in np.array_split(rng.permutation(todo), max(1, len(todo) // BATCH)):
            chosen, group = [], []
            every = np.concatenate([np.arange(border[i], border[i + 1]) for i in batch])
            if turn >= 2 and turn % 2 == 0:
                output[every] = _forward_some(net, source, rows[every])
            for g, i in enumerate(batch):
                best = np.argsort(-output[border[i]:border[i + 1]], kind="stable")[:SUSPECTS]
                chosen += (border[i] + best).tolist()
                group += [g] * len(best)
            group = np.array(group)
            x, part, small = _part(net, source, rows[chosen])
            out, values = net.forward(x, small, keep=True)
            top = np.full(len(batch), -np.inf)
            np.maximum.at(top, group, out)
            e = np.exp(out - top[group])
            total = np.bincount(group, e, len(batch))
            p = 1 / (1 + np.exp(-(top + np.log(total))))
            d = ((p - label[batch]) * weight[batch])[group] * e / total[group] / len(batch)
            grad = net.backward(d.astype(np.float32), values, part)
            step += 1
            for k, g in grad.items():
                m, v = sums[k]
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                net.p[k] -= RATE * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
            net.p["word"][-1] = 0
    output = net.texts(words)
    fit = np.isfinite(output) & (~learn if not learn.all() else learn)
    _calibrate(net, output[fit], label[fit], share if share is not None else float(label.mean()))
    return net


def _part(net: Network, source: tuple, rows: np.ndarray) -> tuple[np.ndarray, tuple, np.ndarray]:
    """The table cut down to the words of some windows."""
    known, flat, length = source
    which, small = np.unique(rows, return_inverse=True)
    shift = int(which[0] == _PAD)
    which = which[shift:]
    begin = (np.cumsum(length) - length)[which]
    n = length[which]
    at = np.repeat(begin, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    x, part = net.inputs(known[which], flat[at], n)
    return x, part, small.reshape(rows.shape) - shift


def _forward_some(net: Network, source: tuple, rows: np.ndarray) -> np.ndarray:
    out = []
    for some in np.array_split(rows, max(1, -(-len(rows) // AT_ONCE))):
        x, _, small = _part(net, source, some)
        out.append(net.forward(x, small)[0])
    return np.concatenate(out)


def _all_words(texts: list[str]) -> Words:
    """The words of all texts, found slice by slice."""
    tokens, start, end, hashes, first, data, at = Tokeniser("letters", lower=True), [], [], [], [np.zeros(1, np.int64)], [], 0
    for _, _, words in tokens.slices(pa.array(texts, pa.large_string())):
        start.append(words.start + at)
        end.append(words.end + at)
        hashes.append(words.hash)
        first.append(words.first[1:] + first[-1][-1])
        data.append(words.data)
        at += len(words.data)
    return Words(*(np.concatenate(parts) for parts in (data, start, end, hashes, first)))


def _calibrate(net: Network, output: np.ndarray, label: np.ndarray, share: float) -> None:
    """Scale and shift that make outputs probabilities where `share` of texts are toxic, by Newton steps that are halved until they help."""
    weight = np.where(label == 1, share / max(1, label.sum()), (1 - share) / max(1, (1 - label).sum())) * len(label)
    target = np.where(label == 1, (label.sum() + 1) / (label.sum() + 2), 1 / ((1 - label).sum() + 2))
    design = np.stack([output, np.ones_like(output)], axis=1)
    beta, guess = np.array([1.0, 0.0]), np.array([1.0, 0.0])

    def loss(beta: np.ndarray) -> float:
        z = design @ beta
        return float((weight * (np.logaddexp(0, z) - target * z)).sum() + 5e-4 * ((beta - guess) ** 2).sum())

    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        slope = design.T @ (weight * (p - target)) + 1e-3 * (beta - guess)
        bend = (design * (weight * p * (1 - p))[:, None]).T @ design + 1e-3 * np.eye(2)
        move, now = np.linalg.solve(bend, slope), loss(beta)
        while loss(beta - move) > now and np.abs(move).max() > 1e-9:
            move = move / 2
        beta = beta - move
    net.scale, net.shift = max(0.05, float(beta[0])), float(beta[1])


def learn_toxicity(documents: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id",
                   toxic: str = "toxic", sample: dict[int, int] | None = None) -> Network | None:
    """A network trained on a bounded sample of labelled documents (SAMPLE texts of SAMPLE_CHARS characters).

    The sample is, for each label, the different texts with the smallest hashes; the share of toxic
    texts to expect is that of the labelled documents given. Labels of other documents have no say.
    Rows without id, text or label are left out; None if a label is missing.
    """
    sample = SAMPLE if sample is None else sample
    marks = labels.select(F.col(doc_id).alias("id"), F.col(toxic).cast("int").alias("toxic")).where(
        "id IS NOT NULL AND toxic IN (0, 1)").distinct()
    texts = documents.select(F.col(doc_id).alias("id"), F.col(text).alias("text"), F.xxhash64(text).alias("key")).where(
        "text IS NOT NULL")
    keys = marks.join(texts.select("id", "key"), "id")
    counts = {r.toxic: r.n for r in keys.groupBy("toxic").agg(F.count_distinct("id").alias("n")).collect()}
    chosen = None
    for label, most in sample.items():
        some = keys.where(F.col("toxic") == label).groupBy("key").agg(F.min("id").alias("id")).orderBy("key").limit(most)
        some = some.select("id", F.lit(label).alias("toxic"))
        chosen = some if chosen is None else chosen.union(some)
    # The sample has a bound, so its ids may go to every task.
    rows = texts.join(F.broadcast(chosen), "id").select("toxic", "key", F.substring("text", 1, SAMPLE_CHARS).alias("text")).collect()
    rows = sorted({(r.key, r.toxic, r.text) for r in rows})
    total = sum(counts.values())
    return train([r[2] for r in rows], [r[1] for r in rows], counts.get(1, 0) / total if total else None)


def score_toxicity(documents: DataFrame, net: Network | None, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The kept columns and score, the probability (0 to 1) that the text is toxic, one row per document.

    Every window of the whole text is scored. Null texts and texts without words, and all texts
    if there is no network, have 0.
    """
    keep = kept(documents, keep, text, ("score",))
    rows = documents.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("string").alias("__text"))
    schema = rows.drop("__text").schema.add("score", "double")
    names = [f.name for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokeniser("letters", lower=True)
        for batch in batches:
            score = np.zeros(batch.num_rows)
            for a, b, words in tokens.slices(batch.column(len(keep))) if net is not None else ():
                score[a:b] = net.probability(net.texts(words))
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(keep)], pa.array(score)], names)

    return rows.mapInArrow(run, schema)
