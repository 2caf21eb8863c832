import random

from pyspark.sql import functions as F

from viario.llm.packing import copy_cluster, fit, pack, word_count


def brute(lengths, sources, clusters, capacity):
    bins = []
    out = []
    for n, s, c in zip(lengths, sources, clusters):
        ok = [i for i, b in enumerate(bins) if b["room"] >= n and (s is None or s not in b["s"]) and (c is None or c not in b["c"])]
        at = min(ok, key=lambda i: (bins[i]["room"], i)) if ok else len(bins)
        if not ok:
            bins.append({"room": capacity, "s": set(), "c": set()})
        out.append((at, capacity - bins[at]["room"]))
        bins[at]["room"] -= n
        bins[at]["s"].add(s)
        bins[at]["c"].add(c)
    return out


def test_fit_against_brute_force():
    rng = random.Random(1)
    for _ in range(60):
        n = rng.randint(0, 120)
        lengths = [rng.choice([0, 1, 5, 50, 100, rng.randint(0, 100)]) for _ in range(n)]
        sources = [rng.choice([None, "a", "a", "a", *"bcdefgh"]) for _ in range(n)]
        clusters = [rng.choice([None, None, *range(8)]) for _ in range(n)]
        assert list(zip(*fit(lengths, sources, clusters, 100))) == brute(lengths, sources, clusters, 100)


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, length long, source string, cluster string, piece string, bin_id int")


def test_every_token_is_in_one_piece_and_no_bin_has_a_conflict(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice([None, 0, 1, 40, 64, 65, 700, rng.randint(1, 60)]), rng.choice(["hot", "hot", "a", "b", None]),
             rng.choice(["c1", "c2", None, None]), "p", 3) for i in range(600)]
    rows += [(None, 10, "hot", "c1", None, None)] * 300
    df = frame(spark, rows)
    found = pack(df, keep=["doc_id"], capacity=64, block_rows=100).collect()
    by_id = {r[0]: r for r in rows}
    total = {}
    bins = {}
    for r in found:
        total[r.doc_id] = total.get(r.doc_id, 0) + r.length
        bins.setdefault(r.bin_id, []).append(r)
    assert all(total[i] == (r[1] or 0) for i, r in by_id.items() if i is not None) and total[None] == 3000
    for own in bins.values():
        at = 0
        for r in sorted(own, key=lambda r: (r.offset, r.length)):
            assert r.offset == at
            at += r.length
        assert at <= 64
        for column in (2, 3):
            named = [by_id[r.doc_id][column] for r in own if by_id[r.doc_id][column] is not None]
            assert len(named) == len(set(named))
    again = pack(df.repartition(7), keep=["doc_id"], capacity=64, block_rows=100).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, found))
    assert pack(df.where("false"), keep=["doc_id"]).count() == 0


def test_one_block_is_best_fit(spark):
    rng = random.Random(3)
    rows = [(i, rng.randint(0, 64), rng.choice("abcdefgh"), rng.choice(["c", None, None]), "", 0) for i in range(90)]
    found = {r.doc_id: (r.bin_id, r.offset) for r in pack(frame(spark, rows), keep=["doc_id"], capacity=64).collect()}
    rows.sort(key=lambda r: (-r[1], r[0]))
    want = brute([r[1] for r in rows], [r[2] for r in rows], [r[3] for r in rows], 64)
    assert [found[r[0]] for r in rows] == want


def test_lengths_and_clusters(spark):
    rows = spark.createDataFrame([(None,), ("",), (" \n",), (" a\tB\x0bc ",), ("A b  C",), ("a b",)], "text string")
    got = rows.select(word_count(F.col("text")).alias("n"), copy_cluster(F.col("text")).alias("c")).collect()
    assert [r.n for r in got] == [0, 0, 0, 3, 3, 1]
    assert got[0].c is got[1].c is got[2].c is None and got[3].c == got[4].c != got[5].c
