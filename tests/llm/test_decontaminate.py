import re

import pytest
from pyspark.sql import functions as F

from tests.llm.frames import AWKWARD, LONG, documents, prose
from viario.llm.decontaminate import find_contamination

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").encode().lower())


def brute(texts, items, size=10):
    windows = {}
    for name, text in items:
        w = words(text)
        for s in range(max(1, len(w) - size + 1)) if w else ():
            windows.setdefault(tuple(w[s:s + size]), set()).add(name)
    out = []
    for text in texts:
        w, hit, named = words(text), set(), set()
        for n in {len(k) for k in windows}:
            for s in range(len(w) - n + 1):
                found = windows.get(tuple(w[s:s + n]))
                if found:
                    hit |= set(range(s, s + n))
                    named |= {str(x) for x in found if x is not None}
        out.append((len(w), len(hit), sorted(named)))
    return out


LEAK = prose(3, 25)
ITEMS = [(1, LEAK), (20, prose(4, 9)), (3, "solo"), (30, LEAK), (5, None), (6, "?!"), (7, "pair words"), (None, prose(8, 12)),
         (8, "a a a a a a a a a a a a"), (9, " ".join(LONG.split()[500:520])), (1, LEAK)]
TEXTS = [*AWKWARD, prose(1, 30) + " " + LEAK[:150] + " end", LEAK.upper().replace(" ", "--"), "x " + prose(4, 9) + " y",
         "so solo, SOLO!", "a " * 40, prose(8, 12), "pair words pair words", LEAK + " " + LEAK, prose(4, 8), None]


@pytest.mark.parametrize("block", [3, 200_000])
def test_against_brute_force(spark, block):
    items = spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("doc_id", F.lit(1))
    rows = documents(spark, TEXTS).drop("n_words")
    found = find_contamination(rows, items, block_windows=block, keep=["doc_id", "words"]).orderBy("doc_id").collect()
    assert [(r.n_words, r.n_hit, list(r["items"])) for r in found] == brute(TEXTS, ITEMS)
    assert all(sum(s.stop - s.start for s in r.spans) == r.n_hit for r in found)


def test_empty_tables_and_repeated_rows(spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    rows = documents(spark, [LEAK] * 3 + [None], ids=[1, 1, None, None])
    found = find_contamination(rows, items, keep=["doc_id"]).collect()
    assert sorted((r.doc_id or 0, r.n_hit) for r in found) == [(0, 0), (0, 25), (1, 25), (1, 25)]
    assert find_contamination(rows.where("false"), items).count() == 0
    assert {r.n_hit for r in find_contamination(rows, items.where("false"), keep=["doc_id"]).collect()} == {0}
