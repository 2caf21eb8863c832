import random

import pytest

from tests.llm.frames import AWKWARD, documents, prose
from viario.llm.substrings import remove_repeated


def words(text):
    return (text or "").encode().split()


def brute(texts, n):
    counts = {}
    for t in texts:
        w = words(t)
        for i in range(len(w) - n + 1):
            counts[tuple(w[i:i + n])] = counts.get(tuple(w[i:i + n]), 0) + 1
    out = []
    for t in texts:
        w = words(t)
        gone = {i + j for i in range(len(w) - n + 1) if counts[tuple(w[i:i + n])] > 1 for j in range(n)}
        out.append((len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode()))
    return out


def corpus(seed):
    rng = random.Random(seed)
    shared = [prose(100 + i, rng.choice([34, 35, 36, 50, 90])) for i in range(6)]
    texts = [*AWKWARD, prose(1, 200), prose(1, 200), prose(1, 200).replace(" ", "\n\t"), "a " * 300, "a " * 34, "a " * 36,
             prose(2, 40) + " " + prose(2, 40), prose(3, 35), prose(3, 35)]
    for i in range(60):
        parts = [prose(1000 + i, rng.randint(0, 60))]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(shared).split()
            a = rng.randint(0, max(0, len(p) - 36))
            parts += [" ".join(p[a:a + rng.choice([34, 35, 40, 200])]), prose(rng.randint(0, 10**9), rng.randint(0, 5))]
        texts.append(" ".join(parts))
    near = prose(5, 150).split()
    for i in range(15):
        own = list(near)
        own[rng.randrange(150)] = f"new{i}"
        texts.append(" ".join(own))
    return texts


@pytest.mark.parametrize("options", [{}, {"crowd": 3}, {"shard_words": 10}])
def test_against_brute_force(spark, options):
    texts = corpus(len(options))
    found = remove_repeated(documents(spark, texts).drop("n_words"), **options).orderBy("doc_id").collect()
    got = [(r.n_words, r.n_removed, r.kept_text if r.n_removed else " ".join(w.decode() for w in words(r.text))) for r in found]
    assert got == brute(texts, 35)


def test_other_sizes(spark):
    texts = corpus(9)
    found = remove_repeated(documents(spark, texts), window=12, phrase=5).orderBy("doc_id").collect()
    assert [(r.n_words, r.n_removed) for r in found] == [b[:2] for b in brute(texts, 12)]


def test_empty_and_repeated_rows(spark):
    rows = documents(spark, [prose(1, 40)] * 3 + [None, ""], ids=[1, 1, None, None, 2])
    found = remove_repeated(rows).collect()
    assert sorted((r.doc_id or 0, r.n_removed) for r in found) == [(0, 0), (0, 40), (1, 40), (1, 40), (2, 0)]
    assert "odd name" in found[0].asDict()
    assert remove_repeated(rows.where("false")).count() == 0
