import random
import re

from pyspark.sql import functions as F

from tests.llm.frames import AWKWARD, documents
from viario.llm.divergence import divergence, term_counts, terms


def cut(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    return re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low)


def brute(rows, least, top):
    """rows (lang, source, text), straight from the definition: every group has a share for every kept term."""
    rows = [(a or "", b or "", c or "") for a, b, c in rows]
    out = set()
    for lang in {r[0] for r in rows}:
        own = [(s, cut(t)) for a, s, t in rows if a == lang]
        df, count = {}, {}
        for s, words in own:
            for w in set(words):
                df[w] = df.get(w, 0) + 1
            for w in words:
                count[s, w] = count.get((s, w), 0) + 1
        kept = [w for w, n in df.items() if n >= least]
        sources = sorted({s for s, _ in own})

        def share(of):
            total = sum(of.values())
            return {w: 1 + 10**9 * (of[w] + 5) // (total + 5 * len(kept)) for w in kept}

        p = {s: share({w: count.get((s, w), 0) for w in kept}) for s in sources}
        q = share({w: sum(count.get((s, w), 0) for s in sources) for w in kept})
        for s in sources:
            pairs = [(t, sum(abs(p[s][w] - p[t][w]) for w in kept)) for t in sources if t != s]
            more = [(w, p[s][w] - q[w]) for w in kept if count.get((s, w), 0) > 0 and p[s][w] > q[w]]
            for part, items, limit in (("pair", pairs, None), ("term", more, top)):
                items.sort(key=lambda i: (-i[1], i[0].encode()))
                out |= {(lang, s, part, i, v, r) for r, (i, v) in enumerate(items[:limit], 1)}
    return out


def test_terms():
    for text in ["", "Ab-Z9z ÀÉé 漢字 a\x00b", "İSTANBUL", "x_y@Z[\\]`{|}~\x7f\x80é"]:
        assert [t.decode() for t in terms(text.encode())] == cut(text)


def test_against_the_definition(spark):
    rng = random.Random(4)
    words = ["Uno", "dos", "TRES", "ñu", "漢", "x1y", "Ä", "ä", *[f"w{chr(97 + i)}" for i in range(12)]]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 12))) for _ in range(60)] + AWKWARD
    rows = [(rng.choice(["en", "en", "en", None, "", "q"]), rng.choice(["hot", "hot", "a", "B", "é", None]), rng.choice(texts)) for _ in range(500)]
    rows += [("one", "alone", "sole words here")] * 4 + [("none", s, None) for s in "abc"] + [("en", "wordless", "")]
    df = spark.createDataFrame(rows, "lang string, source string, text string").withColumns(
        {"term": F.lit(1), "value": F.lit("x"), "rank": F.lit(2), "h": F.lit(3)}).repartition(9)
    for least, top in ((3, 50), (1, 4), (10**6, 50)):
        got = divergence(df, min_documents=least, top_terms=top).collect()
        assert len(got) == len(set(map(tuple, got))) and set(map(tuple, got)) == brute(rows, least, top)
    small = divergence(df, min_documents=3, table_bytes=300, sum_entries=1, tasks_together=2).collect()
    assert set(map(tuple, small)) == brute(rows, 3, 50)
    assert divergence(df.where("false")).count() == 0


def test_counts_do_not_overflow(spark):
    df = documents(spark, ["a b", "a"]).withColumn("source", F.lit("s"))
    shares = divergence(df, min_documents=1, smoothing=5, scale=1_000_000_000, top_terms=9).collect()
    assert shares == []                              # one source is its language
    assert {(r.term, r.n, r.documents) for r in term_counts(df).collect()} == {("a", 2, 2), ("b", 1, 1)}
