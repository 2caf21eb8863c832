import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import viario.llm.scoring as scoring
from tests.llm.frames import AWKWARD, documents, prose
from viario.llm.scoring import Automaton, Grams, pack, score_documents, unpack

END = b"</s>"


def tokens(text):
    return [*(text or "").encode().lower().split(), END]


def brute(texts, train, order, strength):
    counts = Counter()
    for t, on in zip(texts, train):
        if on:
            own = tokens(t)
            counts.update(tuple(own[i:i + m]) for m in range(1, order + 1) for i in range(len(own) - m + 1))
    n = sum(c for g, c in counts.items() if len(g) == 1)
    v = sum(1 for g in counts if len(g) == 1)

    def chance(gram):
        if len(gram) == 1:
            return (counts[gram] + 0.1) / (n + 0.1 * (v + 1))
        return (counts[gram] + strength * chance(gram[1:])) / (counts[gram[:-1]] + strength)

    out = []
    for t in texts:
        own = tokens(t)
        base = sum(math.log10(chance((w,))) for w in own)
        full = sum(math.log10(chance(tuple(own[max(0, i - order + 1):i + 1]))) for i in range(len(own)))
        out.append((len(own), sum(counts[w,] > 0 for w in own), n, base, full))
    return out


def corpus():
    rng = random.Random(1)
    texts = [*AWKWARD[:-1], "ONE one One", "a " * 50]
    texts += [" ".join(rng.choices("ab cd ef gh ij".split(), k=rng.randint(0, 30))) for _ in range(60)]
    return texts + [prose(2, 40)] * 3 + [None]


@pytest.mark.parametrize("order,block", [(3, 5_000_000), (2, 400), (3, 300), (1, 500), (4, 5_000_000)])
def test_against_brute_force(spark, monkeypatch, order, block):
    monkeypatch.setattr(scoring, "BLOCK_BYTES", block)
    monkeypatch.setattr(scoring, "SHARD_GRAMS", max(20, block // 10))
    monkeypatch.setattr(scoring, "STRETCH", 7 if order == 4 else 256)
    texts = corpus()
    train = [i % 4 != 1 for i in range(len(texts))]
    rows = documents(spark, texts).withColumn("n_tokens", F.lit("old"))
    found = score_documents(rows, F.col("doc_id") % 4 != 1, order=order, strength=2.5).orderBy("doc_id").collect()
    assert len(found) == len(texts) and "odd name" in found[0].asDict()
    for r, want in zip(found, brute(texts, train, order, 2.5)):
        assert (r.n_tokens, r.n_known, r.train_tokens) == want[:3]
        assert math.isclose(r.base_score, want[3], abs_tol=1e-6) and math.isclose(r["score"], want[4], abs_tol=1e-6)


def test_nothing_to_learn_repeats_and_empty(spark):
    rows = documents(spark, ["some words", "some words", None], ids=[1, 1, None])
    found = score_documents(rows, F.lit(None).cast("boolean"), keep=["doc_id"]).collect()
    assert sorted((r.n_tokens, r.n_known, r.train_tokens) for r in found) == [(1, 0, 0), (3, 0, 0), (3, 0, 0)]
    assert all(r["score"] == r.base_score == 0.0 for r in found)
    assert score_documents(rows.where("false"), F.lit(True)).count() == 0


def test_very_long_text(spark):
    texts = [AWKWARD[-1], "w1x1 w2x2"]
    found = score_documents(documents(spark, texts), F.lit(True), keep=["doc_id"]).orderBy("doc_id").collect()
    for r, want in zip(found, brute(texts, [1, 1], scoring.ORDER, scoring.STRENGTH)):
        assert r.n_tokens == want[0] and math.isclose(r["score"], want[4], rel_tol=1e-9)


def test_reading_in_stretches(monkeypatch):
    """The score of a text does not depend on where its stretches are cut."""
    rng = random.Random(5)
    texts = pa.chunked_array([pa.array([" ".join(rng.choices("a b c d e f g h i j".split(), k=n)) for n in (0, 1, 5, 150, 2000)])])
    own = Grams(texts, 3)
    seen = np.concatenate([at < own.first[4] for at in own.places])   # the last text was not seen in training
    counts = np.bincount(own.number[seen], minlength=len(own.keys)).astype(np.int64)
    machine = Automaton(own, counts, 900, 5, 2.0)
    whole = [machine.scores()]
    for stretch in (1, 3, 50):
        monkeypatch.setattr(scoring, "STRETCH", stretch)
        whole.append(machine.scores())
    assert all(np.allclose(whole[0], w, rtol=1e-12) for w in whole)


def test_packing_of_numbers():
    numbers = np.array([0, 1, 255, 256, 2**63, 2**64 - 1], dtype=np.uint64)
    assert unpack(pack(numbers)).tolist() == numbers.tolist() and len(unpack(pack(numbers[:0]))) == 0


def test_held_out_texts_are_less_surprising_than_by_single_words(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn(
        "held_out", F.crc32(F.col("doc_id").cast("string")) % 10 == 0)
    found = score_documents(rows, ~F.col("held_out"), keep=["held_out"]).where("held_out")
    score, base = found.agg(F.sum("score"), F.sum("base_score")).first()
    assert score > 0.95 * base
