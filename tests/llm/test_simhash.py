import random

import pytest
import xxhash
from pyspark.sql import functions as F

from tests.llm.frames import AWKWARD, documents, prose
from viario.llm.components import connected_components
from viario.llm.simhash import keep_one, link_fingerprints, near_duplicates


def brute_print(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(w[i:i + 4]), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, bits=4):
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= bits:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(prints))]


def near(text, seed):
    w = text.split()
    random.Random(seed).shuffle(w)
    return " ".join([*text.split()[:-1], w[0]])


TEXTS = [*AWKWARD, *[prose(i, 40) for i in range(12)], *[near(prose(1, 400), s) for s in range(12)], prose(1, 400).upper(),
         *[prose(2, 300)] * 5, None, "one"]


def test_near_duplicates_against_brute_force(spark):
    found = near_duplicates(documents(spark, TEXTS)).orderBy("doc_id").collect()
    prints = [brute_print(t) for t in TEXTS]
    assert [r.fingerprint % 2**64 for r in found] == prints
    assert [r.component_id for r in found] == brute_components(prints)
    one = keep_one(documents(spark, TEXTS))
    assert sorted(r.doc_id for r in one.collect()) == sorted(set(brute_components(prints)))
    assert one.columns == documents(spark, TEXTS).columns


@pytest.mark.parametrize("cell_rows", [4, 20_000])
def test_links_connect_what_is_near(spark, cell_rows):
    rng = random.Random(5)
    prints = set()
    for _ in range(150):
        a = rng.getrandbits(64)
        for _ in range(rng.choice([1, 1, 2, 6])):
            prints.add(a)
            for b in rng.sample(range(64), rng.randint(1, 5)):
                a ^= 1 << b
    prints = sorted(prints)
    rows = spark.createDataFrame([(p - (p >> 63 << 64),) for p in prints], "fingerprint long")
    links = link_fingerprints(rows, cell_rows=cell_rows)
    assert links.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) > 4).count() == 0
    roots = {r.node % 2**64: r.root % 2**64 for r in connected_components(links).collect()}
    want = brute_components(prints)
    groups, wanted = {}, {}
    for i, p in enumerate(prints):
        groups.setdefault(roots.get(p, p), set()).add(p)
        wanted.setdefault(want[i], set()).add(p)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, wanted.values()))


def test_components_of_a_long_chain(spark):
    chain = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    odd = spark.createDataFrame([(5, 5), (None, 7), (1000, 1001), (1001, 1000)], "a long, b long")
    roots = connected_components(chain.union(odd)).collect()
    assert {(r.node, r.root) for r in roots} == {(i, 0) for i in range(301)} | {(1000, 1000), (1001, 1000)}
    assert connected_components(odd.where("false")).count() == 0


def test_nulls_repeats_and_empty(spark):
    text = prose(7, 60)
    rows = documents(spark, [text, text, text, None, "else"], ids=[4, 4, 9, None, None])
    found = near_duplicates(rows).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in found) == [(0, 0), (0, 0), (4, 4), (4, 4), (9, 4)]
    assert sorted(r.doc_id or 0 for r in keep_one(rows).collect()) == [0, 0, 4]
    assert near_duplicates(rows.where("false")).count() == 0 and keep_one(rows.where("false")).count() == 0


@pytest.mark.parametrize("equal_rows", [2, 10_000])
def test_one_row_of_each_group_whatever_the_ids(spark, equal_rows):
    a, b, c, d, e = (prose(i, 60) for i in range(500, 505))
    assert b < c  # the second 5 has the smaller text and is near 3
    texts = [c, b, b, c, a, d, d.upper(), d, e, e, e, a]
    ids = [5, 5, 3, 9, None, None, None, None, 7, 7, 7, None]
    rows = documents(spark, texts, ids=ids, sources=["s"] * len(texts))
    found = keep_one(rows, equal_rows=equal_rows).collect()
    prints = [brute_print(t) for t in texts]
    groups = brute_components(prints)
    assert sorted(groups[texts.index(r.text)] for r in found) == sorted(set(groups))
    assert sorted((r.doc_id or 0, r.text.lower()) for r in found) == sorted([(5, c), (3, b), (0, a), (0, d), (7, e)])
    again = keep_one(rows.orderBy(F.col("text").desc()).repartition(5), equal_rows=equal_rows).collect()
    assert sorted(map(repr, found)) == sorted(map(repr, again))
    # columns that are null in turn are not equal
    odd = rows.limit(1).select(F.lit(1).alias("doc_id"), F.lit(a).alias("text"), F.lit(None).cast("string").alias("x"), F.lit("v").alias("y"))
    assert keep_one(odd.union(odd.select("doc_id", "text", "y", "x"))).count() == 1
