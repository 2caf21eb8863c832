import random
import re

from pyspark.sql import functions as F

from tests.llm.frames import AWKWARD, documents, prose
from viario.llm.quality import CLEAR, FACTS, PRIOR, ROUNDS, TRUST, VAGUE, add_facts, estimate, judge, posterior, rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    places = {}
    for i in range(len(w) - 4):
        places.setdefault(tuple(w[i:i + 5]), []).append(i)
    again = {i + j for own in places.values() if len(own) > 1 for i in own for j in range(5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(again), len(lines),
            sum("A" <= c <= "Z" for c in text), text.count("!"), len(set(w)))


def corpus():
    rng = random.Random(1)
    texts = [*AWKWARD, "a " * 4, "a " * 5, "a " * 6, "a b c d e f a b c d e", "x\ny\nx\n \nx\n\n", "a b c d", "#*$%&|<> 🙂🙂 ÀB!"]
    for i in range(60):
        own = [rng.choice(["ab", "cd", "e!", "F#", "\n", "ñ漢"]) for _ in range(rng.randint(0, 80))]
        texts.append(" ".join(own))
    texts += [prose(i, 60) + "\n" + prose(i, 8) for i in range(30)]
    return texts


def test_facts_and_verdict(spark):
    texts = corpus()
    rows = documents(spark, texts).drop("n_words")
    got = add_facts(rows, keep=["doc_id"]).orderBy("doc_id").collect()
    assert [tuple(r[n] for n in FACTS) for r in got] == [brute(t) for t in texts]
    found = judge(documents(spark, texts)).orderBy("doc_id").collect()
    assert "odd name" in found[0].asDict() and "score" in found[0].asDict()
    for r, t in zip(found, texts):
        n, again = brute(t)[0], brute(t)[4]
        assert r.base_failed == (n < 10 or 100 * again > 20 * n)
        assert r.kept == (not r.base_failed and r.quality >= 0.5)


def votes_of(text):
    """The rules in plain Python, from the facts."""
    n, chars, marks, same, again, lines, capitals, cries, distinct = brute(text)

    def vote(good, bad):
        return -1 if bad else 1 if good else 0

    return (vote(n >= 50, n < 25), vote(4.5 * n <= chars <= 6.5 * n, chars < 4 * n or chars > 7.5 * n),
            vote(100 * marks <= n, 10 * marks > n), vote(same == 0 and 100 * again <= n, 4 * same > lines or 10 * again > n),
            vote(capitals * 200 >= chars and 25 * capitals <= chars, 10 * capitals > chars or capitals == 0),
            vote(cries == 0, 50 * cries > n), vote(distinct >= n ** 0.94, distinct < n ** 0.90))


def plain_em(votes, guesses, prior, trust, rounds):
    """Expectation-maximisation document by document, in products of chances; abstentions say nothing."""
    share, p = prior, [[[g[s][v] for v in (-1, 0, 1)] for s in ("bad", "good")] for g in guesses]

    def belief(vote):
        chance = [1 - share, share]
        for j, v in enumerate(vote):
            if v:
                chance = [c * p[j][s][v + 1] for s, c in enumerate(chance)]
        return chance[1] / sum(chance)

    for _ in range(rounds):
        good = [belief(v) for v in votes]
        new = []
        for j, g in enumerate(guesses):
            rows = []
            for s, side in enumerate(("bad", "good")):
                weight = [b if s else 1 - b for b in good]
                mass = sum(weight)
                rows.append([(sum(w for w, v in zip(weight, votes) if v[j] == k) + 1 + trust * mass * g[side][k])
                             / (mass * (1 + trust) + 3) for k in (-1, 0, 1)])
            new.append(rows)
        share, p = (sum(good) + trust * len(votes) * prior) / (len(votes) * (1 + trust)), new
    return [belief(v) for v in votes]


def test_posterior_against_plain_expectation_maximisation(spark):
    texts = corpus()
    votes = [votes_of(t) for t in texts]
    counted = add_facts(documents(spark, texts), keep=["doc_id"])
    got = counted.select("doc_id", *[v.alias(n) for n, (v, _) in rules().items()]).orderBy("doc_id").collect()
    assert [tuple(r)[1:] for r in got] == votes
    want = plain_em(votes, [g for _, g in rules().values()], PRIOR, TRUST, ROUNDS)
    found = judge(documents(spark, texts)).orderBy("doc_id").collect()
    assert all(abs(r.quality - w) < 1e-9 for r, w in zip(found, want))


def test_estimate_finds_the_accuracies():
    """Good and bad rules get their own accuracies, whatever they start from."""
    rng = random.Random(3)
    real = [((0.75, 0.2, 0.05), (0.3, 0.2, 0.5))] * 4 + [((0.5, 0.2, 0.3), (0.4, 0.2, 0.4))] * 2
    patterns = {}
    for _ in range(20_000):
        good = rng.random() < 0.7
        votes = tuple(rng.choices((1, 0, -1), g if good else b)[0] for g, b in real)
        patterns[votes] = patterns.get(votes, 0) + 1
    for first in (CLEAR, VAGUE):
        prior, tables = estimate(sorted(patterns.items()), [first] * 6)
        assert 0.65 < prior < 0.75
        assert all(abs(t[side][v] - p) < 0.06 for t, (g, b) in zip(tables, real)
                   for side, own in (("good", g), ("bad", b)) for v, p in zip((1, 0, -1), own))
        assert posterior((1,) * 6, prior, tables) > 0.99 and posterior((-1,) * 6, prior, tables) < 0.01
        # a bad vote of a weak rule is outvoted, two of strong rules against weak ones are not
        assert posterior((1, 1, 1, 0, -1, 0), prior, tables) > 0.9 and posterior((-1, -1, 0, 0, 1, 1), prior, tables) < 0.1


def test_the_verdict_is_not_that_all_rules_must_pass(spark):
    """On the given tables single bad votes are outvoted and several decide, and the labels agree better with it."""
    folder = "/root/testdata/sf0.01"
    rows = judge(spark.read.parquet(f"{folder}/documents.parquet"), keep=["doc_id"]).drop("quality").where("not base_failed")
    bad = sum(F.when(vote == -1, 1).otherwise(0) for vote, _ in rules().values())
    rows = rows.withColumn("n_bad", bad).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id", "left").collect()
    assert sum(r.kept and r.n_bad == 1 for r in rows) >= 5 and sum(not r.kept and r.n_bad > 1 for r in rows) >= 5
    assert len({r.kept for r in rows if r.n_bad == 1}) == 2 or any(r.kept for r in rows if r.n_bad > 1)
    marked = [r for r in rows if r.quality is not None]
    ours, all_pass = (sum(verdict(r) == (r.quality == 1) for r in marked) for verdict in (lambda r: r.kept, lambda r: r.n_bad == 0))
    assert ours > all_pass and ours > 0.98 * len(marked)


def test_given_labels(spark):
    folder = "/root/testdata/sf0.01"
    found = judge(spark.read.parquet(f"{folder}/documents.parquet"), keep=["doc_id"]).drop("quality").where("not base_failed")
    own = found.join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id")
    good, bad = (own.where(f"quality = {q}").agg(F.avg(F.col("kept").cast("int"))).first()[0] for q in (1, 0))
    assert good > 0.97 and bad < 0.2


def test_empty_and_repeated_rows(spark):
    rows = documents(spark, [prose(1, 50)] * 3, ids=[1, 1, None])
    assert len({(r.quality, r.kept) for r in judge(rows).collect()}) == 1 and judge(rows).count() == 3
    assert judge(rows.where("false")).count() == 0
