import random

import numpy as np
import pytest

from viario.llm.chat import format_conversations, loss_mask, masked_text, read_turns, render
from viario.llm.queries import TOKENIZER

PARTS = ["\\", "###", "#", "</turn>", "\n", ": ", "user", "ñ漢🙂", " ", "### assistant: ", "<|endoftext|>", "a", "</turn", ">"]


@pytest.fixture(scope="module")
def tokenizer():
    with open(TOKENIZER, encoding="utf-8") as file:
        return file.read()


def test_round_trip_of_any_text():
    rng = random.Random(4)
    for _ in range(3000):
        turns = [("".join(rng.choices(PARTS, k=rng.randint(0, 3))), "".join(rng.choices(PARTS, k=rng.randint(0, 9))))
                 for _ in range(rng.randint(0, 4))]
        formatted, spans = render(turns)
        assert read_turns(formatted) == turns
        assert len(spans) == len(turns)


def test_mask_against_brute_force():
    rng = random.Random(6)
    for _ in range(300):
        cuts = sorted(rng.sample(range(60), 8))
        spans = list(zip(cuts[::2], cuts[1::2]))
        edges = sorted({0, 60, *rng.choices(range(60), k=15)})
        starts, stops = np.array(edges[:-1]), np.array(edges[1:])
        want = [any(a < y and x < b for x, y in spans) for a, b in zip(starts, stops)]
        assert loss_mask(starts, stops, spans).tolist() == want


def test_conversations(spark, tokenizer):
    rng = random.Random(7)
    rows = [(c, t, rng.choice(["user", "assistant", None, "tool:x"]), rng.choice([None, "", "".join(rng.choices(PARTS, k=20))]), 1)
            for c in (1, 2, None, 4) for t in rng.sample(range(9), 5)]
    rows += [(4, 3, "assistant", "same", 1), (4, 3, "assistant", "same", 1), (5, None, "assistant", "x " * 30_000, 1)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, n_turns int")
    found = {r.conv_id: r for r in format_conversations(df, tokenizer).collect()}
    assert set(found) == {1, 2, None, 4, 5}
    for key, r in found.items():
        own = sorted(((t is not None, t or 0, who or "", text or "") for c, t, who, text, _ in rows if c == key))
        turns = [(who, text) for _, _, who, text in own]
        assert r.n_turns == len(turns) and read_turns(r.formatted) == turns
        spans = [(s.start, s.stop) for s in r.spans]
        loss = masked_text(r.formatted, spans, r.token_starts, r.token_stops, r.loss_mask)
        assert loss == "".join(text for who, text in turns if who == "assistant")
        assert len(r.token_ids) == len(r.loss_mask) == len(r.token_starts)
    assert format_conversations(df.where("false"), tokenizer).count() == 0
