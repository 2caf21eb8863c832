import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

import viario.llm.toxicity as toxicity
from tests.llm.frames import AWKWARD, documents, prose
from viario.llm.queries import QUERIES
from viario.llm.toxicity import Network, learn_toxicity, score_toxicity, train, trigrams, windows
from viario.llm.words import Tokeniser

BAD = "idiot moron scum".split()


def texts(seed, n):
    rng = random.Random(seed)
    out, labels = [], []
    for i in range(n):
        words = prose(seed * 100_000 + i, rng.randint(5, 150)).split()
        bad = i % 3 == 0
        if bad:
            for _ in range(rng.randint(1, 3)):
                words.insert(rng.randrange(len(words)), rng.choice(BAD))
        out.append(" ".join(words))
        labels.append(int(bad))
    return out, labels


def test_windows_cover_every_word_and_overlap():
    counts = [0, 1, 31, 32, 33, 48, 49, 200]
    first = np.concatenate([[0], np.cumsum(counts)])
    places, owner = windows(first)
    for i, n in enumerate(counts):
        own = places[owner == i]
        assert sorted({p for row in own.tolist() for p in row if p >= 0}) == list(range(first[i], first[i + 1]))
        assert len(own) == (0 if n == 0 else 1 + max(0, -(-(n - 32) // 16)))
        assert all(row[0] == first[i] + 16 * k for k, row in enumerate(own.tolist()))


def test_trigrams_of_words():
    _, _, words = next(Tokeniser("letters", lower=True).slices(pa.array(["ab abc", "", "ab x"])))
    flat, length = trigrams(words, np.arange(4))
    assert length.tolist() == [2, 3, 2, 1]
    assert flat[0] == flat[2] and flat[:2].tolist() == flat[5:7].tolist() and flat[1] != flat[3]


def test_gradients_against_differences():
    net = Network(np.arange(1, 6, dtype=np.uint64) * 7, seed=3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    known, flat, length = np.array([0, 3, 5, 2]), np.array([1, 2, 3, 2, 9, 9]), np.array([2, 1, 2, 1])
    rows = np.array([[0, 1, 2, 3], [3, 3, -1, -1], [2, -1, -1, -1]])
    weight = np.array([0.7, -1.3, 0.4])

    def value():
        return float(net.forward(net.inputs(known, flat, length)[0], rows)[0] @ weight)

    x, source = net.inputs(known, flat, length)
    grad = net.backward(weight, net.forward(x, rows, keep=True)[1], source)
    rng = np.random.default_rng(1)
    for name, values in net.p.items():
        for _ in range(6):
            at = tuple(rng.integers(0, n) for n in values.shape)
            if name == "word" and at[0] == len(values) - 1:
                continue
            old = values[at]
            values[at] = old + 1e-4
            up = value()
            values[at] = old - 1e-4
            down = value()
            values[at] = old
            assert abs((up - down) / 2e-4 - grad[name][at]) < 2e-3, name


def test_held_out_texts_and_awkward_ones(spark):
    net = train(*texts(1, 600))
    seen, labels = texts(2, 300)
    rows = documents(spark, [*seen, *AWKWARD])
    found = [r["score"] for r in score_toxicity(rows, net, keep=["doc_id"]).orderBy("doc_id").collect()]
    right = [(p >= 0.3) == bool(y) for p, y in zip(found, labels)]
    assert sum(right) / len(right) > 0.93 and all(0 <= p <= 1 for p in found)
    rest = found[300:]
    assert [rest[i] for i in (0, 1, 2, 6)] == [0.0] * 4
    long = " ".join([prose(9, 5000), "idiot", prose(10, 3000)])
    pair = documents(spark, [prose(9, 5000) + " " + prose(10, 3000), long])
    low, high = [r["score"] for r in score_toxicity(pair, net, keep=["doc_id"]).orderBy("doc_id").collect()]
    assert high > 0.3 and high > low
    # slices and batches do not matter
    alone = [score_toxicity(documents(spark, [t]), net, keep=["doc_id"]).first()["score"] for t in seen[:5]]
    assert np.allclose(alone, found[:5], atol=1e-5)


def test_labels_missing_nulls_and_empty(spark):
    rows = documents(spark, ["a b c", None, "d e f", "g"], ids=[1, 2, 3, None])
    labels = spark.createDataFrame([(1, 0), (2, 1), (3, None), (None, 1), (1, 0)], "doc_id long, toxic int")
    assert learn_toxicity(rows, labels) is None
    assert learn_toxicity(rows, labels.where("false")) is None and learn_toxicity(rows.where("false"), labels) is None
    found = score_toxicity(rows, None).collect()
    assert {r["score"] for r in found} == {0.0} and len(found) == 4 and "odd name" in found[0].asDict()
    assert score_toxicity(rows.where("false"), None).count() == 0


def test_given_labels(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "SAMPLE", {1: 300, 0: 900})
    folder = "/root/testdata/sf0.1"
    rows = spark.read.parquet(f"{folder}/documents.parquet").withColumn(
        "held_out", F.crc32(F.col("doc_id").cast("string")) % 4 == 2)
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    net = learn_toxicity(rows.where("not held_out"), labels)
    found = score_toxicity(rows.where("held_out"), net, keep=["doc_id"]).join(labels, "doc_id").toPandas()
    flagged = found["score"] >= 0.3
    assert (flagged & (found.toxic == 1)).sum() / (found.toxic == 1).sum() > 0.75
    assert (flagged & (found.toxic == 0)).sum() / (found.toxic == 0).sum() < 0.05


def test_held_out_labels_have_no_say(spark, tmp_path):
    seen, labels = texts(4, 400)
    documents(spark, seen).write.parquet(f"{tmp_path}/documents.parquet")
    rows = [(i, y) for i, y in enumerate(labels)]
    held = {r.doc_id for r in spark.range(400).toDF("doc_id").where(F.crc32(F.col("doc_id").cast("string")) % 4 == 2).collect()}
    own = [r for r in rows if r[0] not in held]
    scores = []
    for given in (rows, [(i, 1 - y if i in held else y) for i, y in rows], own, own + [(10_000 + i, 1) for i in range(500)]):
        spark.createDataFrame(given, "doc_id long, toxic int").write.mode("overwrite").parquet(f"{tmp_path}/labels.parquet")
        found = QUERIES["op7_toxicity"](spark, str(tmp_path)).orderBy("doc_id").collect()
        scores.append([r.score for r in found])
    assert len(scores[0]) == 400 and max(scores[0]) > 0.5
    assert all(np.allclose(s, scores[0], atol=1e-6) for s in scores[1:])
