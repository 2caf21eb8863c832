import random
import re

from pyspark.sql import functions as F

from tests.llm.frames import AWKWARD, documents, prose
from viario.llm.licenses import BANDS, TEMPLATES, _smallest, scan, shingles, template_table, words

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def runs(text):
    w = WORD.findall((text or "").lower())
    return [tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))] if w else []


def brute(texts, templates):
    """License -> best containment over all windows of a quarter more than the template's length."""
    out = {}
    for i, text in enumerate(texts):
        own = runs(text)
        for name, several in templates.items():
            for template in several:
                t = set(runs(template))
                n = len(runs(template))
                for s in range(max(1, len(own) - n + 1)):
                    share = len(t & set(own[s:s + n])) / len(t)
                    if share >= 0.8:
                        out[i, name] = max(share, out.get((i, name), 0))
    return out


def corpus():
    rng = random.Random(2)
    every = [t for several in TEMPLATES.values() for t in several]
    texts = [*AWKWARD, *every, *[t.upper().replace(" ", "\n * ") for t in every]]
    for i, t in enumerate(every):
        w = t.split()
        w[rng.randrange(len(w))] = "changed"
        texts.append(prose(i, rng.randint(0, 90)) + " " + " ".join(w) + " " + prose(i + 50, 30))
        texts.append(prose(i, 40) + " " + " ".join(t.split()[:len(t.split()) // 2]))
    return texts


def test_against_brute_force(spark):
    texts = corpus()
    found = scan(documents(spark, texts), template_table(spark)).collect()
    got = {(r.doc_id, r.license): r.containment for r in found}
    want = brute(texts, TEMPLATES)
    assert len(got) == len(found) and set(want) <= set(got)
    assert all(got[k] >= want[k] - 1e-12 for k in want) and all(v >= 0.8 for v in got.values())
    # windows are a little longer than the template, so they may hold a bit more of a spread-out match
    assert len(set(got) - set(want)) <= 2


def test_bands_retrieve_similar_windows(spark):
    rng = random.Random(3)
    rows = []
    for _ in range(300):
        a = [rng.getrandbits(63) for _ in range(20)]
        rows.append((a, a[:16] + [rng.getrandbits(63) for _ in range(4)]))
    df = spark.createDataFrame(rows, "a array<long>, b array<long>")
    same = F.size(F.filter(F.arrays_zip("x", "y"),
                           lambda z: z["x"] == z["y"]))
    low = df.select(_smallest(F.col("a"), BANDS).alias("x"), _smallest(F.col("b"), BANDS).alias("y"))
    got = [r[0] for r in low.select(same).collect()]
    assert min(got) >= 1 and 0.55 < sum(got) / len(got) / BANDS < 0.78  # Jaccard is 2/3


def test_nulls_repeats_and_empty(spark):
    text = prose(1, 20) + " Released under the MIT License. " + prose(2, 20)
    rows = documents(spark, [text, text, text, None], ids=[3, 3, None, None])
    found = scan(rows, template_table(spark)).collect()
    assert sorted((r.doc_id or 0, r.license) for r in found) == [(0, "MIT"), (3, "MIT")]
    assert scan(rows.where("false"), template_table(spark)).count() == 0
    assert scan(rows, template_table(spark).where("false")).count() == 0
    assert scan(rows, template_table(spark, {"none": ["", "..."]})).count() == 0
    got = rows.select(shingles(words(F.lit("one two")), 5)).first()[0]
    assert len(got) == 1


def test_texts_that_share_an_id_are_judged_each(spark):
    whole = max(TEMPLATES["Apache-2.0"], key=len)
    part = " ".join(whole.split()[:len(whole.split()) * 3 // 5])
    texts = [*[part + " " + prose(300 + i, 40) for i in range(20)], whole, *[part + " " + prose(400 + i, 40) for i in range(20)]]
    templates = template_table(spark, {"Apache-2.0": [whole]})
    for i in (1, None):
        found = scan(documents(spark, texts, ids=[i] * len(texts)), templates).collect()
        assert [(r.doc_id, r.license, r.containment, r.start) for r in found] == [(i, "Apache-2.0", 1.0, 0)]
