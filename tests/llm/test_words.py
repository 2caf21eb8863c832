import re

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.frames import AWKWARD, prose
from viario.llm.words import Tokeniser, grams

TEXTS = [*AWKWARD, prose(1, 50), prose(1, 50), "x" * 3_000_000, "Same SAME same"]
PATTERNS = {"printing": rb"[^\x20\x09-\x0D]+", "letters": rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"}


@pytest.mark.parametrize("kind", PATTERNS)
def test_words_are_those_of_the_pattern(kind):
    tokens = Tokeniser(kind, lower=True)
    hashes, seen = {}, 0
    for a, b, words in tokens.slices(pa.array(TEXTS)):
        for i in range(a, b):
            lo, hi = words.first[i - a], words.first[i - a + 1]
            got = [words.text(j, j + 1) for j in range(lo, hi)]
            assert got == re.findall(PATTERNS[kind], (TEXTS[i] or "").encode().lower())
            for word, h in zip(got, words.hash[lo:hi].tolist()):
                assert hashes.setdefault(word, h) == h
            seen += 1
    assert seen == len(TEXTS) and len(set(hashes.values())) == len(hashes)


def test_grams_stay_inside_a_text():
    _, _, words = next(Tokeniser().slices(pa.array(["a b c", "a b", "", "b c a b"])))
    hashes, whole = grams(words, 2)
    assert whole.tolist() == [True, True, False, True, False, True, True, True, False]
    assert hashes[0] == hashes[3] == hashes[7] and hashes[1] == hashes[5] and hashes[0] != hashes[1]
    assert not grams(words, 50)[1].any()


def test_empty_column():
    assert list(Tokeniser().slices(pa.array([], pa.string()))) == []
    _, _, words = next(Tokeniser().slices(pa.array([None, ""], pa.string())))
    assert words.first.tolist() == [0, 0, 0] and np.array_equal(words.hash, [])
