import hashlib
import random
import zlib

import numpy as np
import pytest

from tests.llm.frames import AWKWARD, documents
from viario.llm import runs as module
from viario.llm.queries import with_planted_runs
from viario.llm.runs import Cover, Extensions, Grid, cover, find_runs, kept_words, number_words, runs_of


def brute(words, least=24):
    """Every stretch of equal words q apart, for each q; a stretch counts with its smallest period."""
    n, out = len(words), {}
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            if i - start + q >= max(least, 3 * q):
                out.setdefault((start, i - start + q), q)
    return sorted(((s, l, q) for (s, l), q in out.items()), key=lambda r: (r[0], r[2]))


def texts(seed, count, most):
    """Word numbers with and without planted repeats, from small and larger alphabets."""
    rng = random.Random(seed)
    for _ in range(count):
        n, letters = rng.randint(0, most), rng.choice([1, 2, 3, 60])
        words = [rng.randrange(letters) for _ in range(n)]
        for _ in range(rng.randint(0, 3)):
            if n > 30:
                start = rng.randrange(n - 20)
                q = rng.randint(1, max(1, (n - start) // 3))
                for i in range(start + q, min(n, start + q * rng.randint(2, 6) + rng.randint(0, q))):
                    words[i] = words[i - q]
        yield words


@pytest.mark.parametrize("modulus", [1, 2, 16, 30, 64, 100])
def test_cover_holds_every_difference(modulus):
    d = cover(modulus)
    assert {(a - b) % modulus for a in d for b in d} == set(range(modulus))


def test_extensions_against_comparing_words():
    rng = random.Random(6)
    for modulus in (4, 16, 64):
        own = Cover(modulus)
        for words in texts(modulus, 60, 300):
            n = len(words)
            if n < 2:
                continue
            asked = [sorted(rng.sample(range(n), 2)) for _ in range(60)]
            want = []
            for i, j in asked:
                k = 0
                while j + k < n and words[i + k] == words[j + k]:
                    k += 1
                want.append(k)
            i, j = np.array(asked).T
            assert Extensions(np.array(words, np.int32), own).of(i, j).tolist() == want


def test_runs_against_comparing_words():
    own, grid = Cover(), Grid()
    for words in texts(1, 400, 350):
        for least in (3, 24):
            assert runs_of(np.array(words, np.int32), own, grid, least) == brute(words, least)


def test_long_texts_in_parts(monkeypatch):
    monkeypatch.setattr(module, "GRID_WORDS", 64)
    monkeypatch.setattr(module, "GRID_PLACES", 50)
    monkeypatch.setattr(module, "PAIRS", 7)
    monkeypatch.setattr(module, "PART_BYTES", 5)
    for words in texts(2, 60, 300):
        text = "  ".join(map(str, words)).encode() + b"\t"
        numbers, spelled = number_words(text)
        assert [spelled[i].decode() for i in numbers] == list(map(str, words))
        assert runs_of(numbers, Cover(), Grid()) == brute(words)


def test_sorting_a_long_sample_by_parts_of_a_block():
    rng = np.random.default_rng(3)
    words = rng.integers(0, 50, 150_000).astype(np.int32)
    words[1000:149_000] = words[1000 + np.arange(148_000) % 40_000]
    [(start, length, period)] = runs_of(words, Cover(), Grid())
    assert start <= 1000 and start + length >= 149_000 and period == 40_000


def test_kept_words():
    assert kept_words(8, [(1, 6, 2), (0, 3, 1)]).tolist() == [True, False, False, False, False, False, False, True]


def test_awkward_texts_and_columns(spark):
    many = AWKWARD + ["x " * 40, " ".join("a b c".split() * 9) + " d", "ä\x0bb\n" * 30, "x " * 40]
    df = documents(spark, many, [*range(len(many) - 2), None, None]).withColumnRenamed("score", "start")
    out = find_runs(df)
    assert out.columns[:7] == ["doc_id", "lang", "source", "n_chars", "words", "odd name", "n_words"]
    rows = {r.text: r for r in find_runs(df, keep=["doc_id", "text"]).collect()}
    for text in many:
        words = (text or "").split() if text is None or text.isascii() else text.encode().split()
        got = rows[text]
        want = brute(words)
        assert [tuple(r) for r in got.runs] == want and got.n_runs == len(want) and got.n_words == len(words)
        if not want:
            assert (got.start, got.length, got.period, got.exponent_milli) == (None,) * 4
    assert rows["x " * 40].collapsed_text == "x" and rows["x " * 40].exponent_milli == 40_000
    assert rows[many[-3]].collapsed_text == "a b c d"
    assert rows[None].collapsed_text == "" and find_runs(df).count() == len(many)
    assert find_runs(df.where("false")).count() == 0
    for r in find_runs(df, keep=["doc_id", "text"], digest=True).collect():
        own = rows[r.text]
        lines = "".join(f"{s},{l},{q}\n" for s, l, q in own.runs)
        assert r.runs_sha256 == hashlib.sha256(lines.encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(own.collapsed_text.encode()).hexdigest()


def test_the_clearest_run():
    assert module._clearest([(5, 30, 10), (9, 60, 20), (5, 27, 9)]) == (5, 27, 9)
    assert module._clearest([(7, 40, 10), (5, 30, 10)]) == (7, 40, 10)


def test_planted_runs(spark):
    rng = random.Random(8)
    rows = [(i, rng.choice([None, "", " ", " ".join(f"w{rng.randrange(99)}" for _ in range(rng.randint(1, 80)))])) for i in range(300)]
    got = {r.doc_id: r.text for r in with_planted_runs(spark.createDataFrame([*rows, (None, "x y")], "doc_id long, text string")).collect()}
    for i, text in rows:
        h, words = zlib.crc32(str(i).encode()), (text or "").split()
        n, g = len(words), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[j if j < a else a + (j - a) % p] for j in range(n)]
        assert (got[i] or "").split() == words
    assert got[None] == "x y"
