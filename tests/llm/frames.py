"""Small frames that hold the awkward cases of every text operator."""

import random

LONG = " ".join(f"w{i % 997}x{i % 31}" for i in range(30_000))


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n))


def documents(spark, texts, ids=None, sources=None):
    """documents with extra columns whose names might clash with an operator's own."""
    ids = range(len(texts)) if ids is None else ids
    sources = [f"s{i % 3}" for i in range(len(texts))] if sources is None else sources
    rows = [(i, t, "en", s, None if t is None else len(t), 1, "w", 2, "x")
            for i, t, s in zip(ids, texts, sources)]
    return spark.createDataFrame(
        rows, "doc_id long, text string, lang string, source string, n_chars long, n_words int, words string, "
              "score int, `odd name` string")


AWKWARD = [None, "", " \t\n ", "one", "two words", "ÀÉ ñandú straße 漢字 🙂", "!!! ...", "a b c d", LONG]
