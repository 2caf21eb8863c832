import hashlib
import random
import re

from pyspark.sql import functions as F

from tests.llm.frames import AWKWARD, documents
from viario.llm import exact as module
from viario.llm.exact import TextTable, exact_duplicates, one_space


def brute(rows):
    """rows (doc_id, text) to (doc_id, keep_id, group_size, kept, sha) as a sorted list; kept rows of one id are told by count."""
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), []).append(i)
    out = []
    for t, ids in groups.items():
        known = [i for i in ids if i is not None]
        first = min(known) if known else None
        sha = hashlib.sha256(t.encode()).hexdigest()
        kept = False
        for i in ids:
            out.append((i, first, len(ids), i == first and not kept, sha))
            kept |= i == first
    return sorted(out, key=repr)


def found(df, **sizes):
    rows = exact_duplicates(df, keep=["doc_id"], **sizes).collect()
    return sorted([(r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in rows], key=repr)


def test_one_space():
    for t in [b"", b" ", b" \t", b"a", b" a", b"a\n", b"\x0ba \r\n b\x0c", " a ".encode(), b"a\x00 \x1c b"]:
        assert one_space(t) == re.sub(rb"[\x20\x09-\x0D]+", b" ", t)


def test_table_tells_equal_hashes_apart_by_text():
    table = TextTable()
    rng = random.Random(1)
    texts = [str(rng.randrange(3000)).encode() for _ in range(9000)]
    numbers = {}
    for t in texts:
        h = len(t) % 3 - 1                       # nearly all hashes collide
        slot = table.slot(h, t)
        entry = table.slots[slot]
        if entry < 0:
            entry = table.add(slot, h, t)
        assert numbers.setdefault(t, entry) == entry
    assert table.texts == list(dict.fromkeys(texts))


def test_awkward_texts_ids_and_columns(spark):
    texts = AWKWARD + [t and t.replace(" ", "\n ") for t in AWKWARD] + ["a  b\x0bc d", "x", "x", "x "]
    ids = [*range(100, 100 + len(texts) - 3), None, None, 7]
    rows = list(zip(ids, texts))
    df = documents(spark, texts, ids)
    assert found(df) == brute(rows)
    wide = exact_duplicates(df.withColumn("kept", F.lit("mine")).withColumn("__id", F.lit(1)))
    assert wide.columns == ["doc_id", "lang", "source", "n_chars", "n_words", "words", "score", "odd name", "__id",
                            "keep_id", "group_size", "kept", "text_sha256"]
    assert wide.where("kept").count() == len({r[4] for r in brute(rows)})
    assert exact_duplicates(df.where("false")).count() == 0
    named = exact_duplicates(df.withColumn("doc_id", F.col("doc_id").cast("string")), keep=["doc_id"]).where("kept").count()
    assert named == len({r[4] for r in brute(rows)})


def test_spilled_buckets_hot_hashes_and_tiny_tables(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(i, rng.choice(["hot text", "hot  text", f"t {rng.randrange(150)}", f"long {rng.randrange(9)} " + "z" * 900])) for i in range(1500)]
    rows += [(3, "repeated id"), (3, "repeated id"), (None, "hot text")]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(12)
    want = brute(rows)
    assert found(df) == want
    monkeypatch.setattr(module, "MAX_TASKS", 4)
    monkeypatch.setattr(module, "SPARE", 0.03)       # several tables' worth of texts in a bucket: it spills, again and again
    assert found(df, table_bytes=20_000, table_rows=7, hot_rows=5) == want
    monkeypatch.setattr(module, "SPARE", 8)
    assert found(df, table_bytes=1, table_rows=1, hot_rows=40) == want
