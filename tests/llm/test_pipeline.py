"""The pipeline against plain Python on small tables, stage by stage."""

import os

import corpus_pipeline
from tests.llm import test_decontaminate, test_simhash, test_substrings
from tests.llm.frames import AWKWARD, documents, prose
from tests.llm.test_chat import PARTS
from viario.llm.language import learn_dictionaries, normal
from viario.llm.packing import CAPACITY

LEAK = prose(70, 30)
TEXTS = [*AWKWARD[:-1], *[prose(i, 60) for i in range(20)], prose(3, 60).upper(), prose(4, 60), None, "!!",
         *[prose(40 + i, 50) + " " + prose(999, 60) + " " + prose(60 + i, 50) for i in range(6)],
         prose(80, 40) + " " + LEAK + " " + prose(81, 40), prose(82, 3000), *PARTS]


def test_stages(spark, tmp_path):
    folder = str(tmp_path)
    docs = documents(spark, TEXTS, ids=[*range(len(TEXTS) - 1), None])
    docs.write.parquet(os.path.join(folder, "documents.parquet"))
    spark.createDataFrame([(1, LEAK), (2, None)], "item_id long, text string").write.parquet(
        os.path.join(folder, "benchmark.parquet"))
    docs = spark.read.parquet(os.path.join(folder, "documents.parquet"))
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "language ID", "SimHash near-dedup", "substring dedup", "benchmark decontamination", "best-fit packing"]
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.collect()
        stage(spark, docs, folder).write.parquet(out := os.path.join(folder, f"stage{i}"))
        docs = spark.read.parquet(out)
        after = docs.collect()
        texts = [r.text for r in before]
        if i < 4:
            assert docs.columns == documents(spark, []).columns
        if name == "language ID":
            learned = {"en": bytes(b"".join(normal(t) + b" " for t in texts if t))}
            assert list(learn_dictionaries(docs)) == list(learned)     # one language: its margin is always wide
            want = [r for r in before if r.text and any(c.isalpha() for c in r.text)]
            assert sorted(map(repr, after)) == sorted(map(repr, want)) and len(after) < len(before)
        elif name == "SimHash near-dedup":
            rows = sorted((r for r in before if r.doc_id is not None), key=lambda r: r.doc_id)
            prints = [test_simhash.brute_print(r.text) for r in rows]
            want = {rows[k].doc_id for k in test_simhash.brute_components(prints)}
            assert sorted(r.doc_id for r in after if r.doc_id is not None) == sorted(want)
        elif name == "substring dedup":
            want = []
            for r, (n, gone, text) in zip(before, test_substrings.brute(texts, 35)):
                if gone == 0 or gone < n:
                    want.append((r.doc_id, r.text if gone == 0 else text, r.n_chars if gone == 0 else len(text)))
            assert sorted(map(repr, want)) == sorted(repr((r.doc_id, r.text, r.n_chars)) for r in after)
            assert any(gone for _, gone, _ in test_substrings.brute(texts, 35))
        elif name == "benchmark decontamination":
            found = test_decontaminate.brute(texts, [(1, LEAK), (2, None)])
            assert sorted(r.text for r, f in zip(before, found) if f[1] == 0) == sorted(r.text for r in after)
            assert len(after) < len(before)
        else:
            want = {}
            for r in before:
                want[r.doc_id] = want.get(r.doc_id, 0) + len(test_substrings.words(r.text))
            got = {}
            for r in after:
                got[r.doc_id] = got.get(r.doc_id, 0) + r.length
            assert got == want
            fill = {}
            for r in after:
                fill[r.bin_id] = fill.get(r.bin_id, 0) + r.length
            assert max(fill.values()) <= CAPACITY


def test_empty_documents(spark, tmp_path):
    folder = str(tmp_path)
    documents(spark, []).write.parquet(os.path.join(folder, "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(os.path.join(folder, "benchmark.parquet"))
    assert corpus_pipeline.run(spark, folder).count() == 0
