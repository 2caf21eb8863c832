"""Quality rules as weak supervision, in DataFrame functions only.

Every rule votes good (1) or bad (-1) or abstains (0). Expectation-maximisation over the
histogram of vote patterns, at most 3^7 rows, estimates how often each
rule votes so on good and on bad documents. The posterior probability of a document
being good then decides, in place of demanding that all rules pass.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from viario.storage import materialise

WINDOW_WORDS = 5
ROUNDS = 60
MIN_POSTERIOR = 0.5
PRIOR = 0.8       # first guess at the share of good documents
TRUST = 0.05      # the first guesses weigh as much as this share of the documents
FACTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_cries",
         "n_distinct")
_SPACE = r"[\x20\x09-\x0D]+"

# Positions of windows that stand twice or more, in order, and the words they cover. `p` are sorted
# (hash, place) pairs, so equal windows are neighbours.
_COVERED = """aggregate(
  array_sort(transform(filter(transform(p, (s, i) -> struct(s.at AS at,
      coalesce(get(p, i - 1).h = s.h, false) OR coalesce(get(p, i + 1).h = s.h, false) AS twice)), s -> s.twice), s -> s.at)),
  struct(-{n} AS last, 0 AS n), (sum, at) -> struct(at AS last, sum.n + least({n}, at - sum.last) AS n), sum -> sum.n)"""


def _let(value: str, name: str, body: str) -> str:
    """`body` with `name` computed once; a plain column would be put into lambdas and computed per element."""
    return f"transform(array({value}), {name} -> {body})[0]"


def repeat_words(words: str, window: int = WINDOW_WORDS) -> str:
    """SQL for the number of words in windows found twice or more; `words` names an array of words.

    Windows are told apart by 64-bit hashes.
    """
    hashes = (f"if(size({words}) < {window}, array(), "
              f"transform(sequence(1, greatest(1, size({words}) - {window - 1})), i -> xxhash64(slice({words}, i, {window}))))")
    pairs = "array_sort(transform(h, (x, i) -> struct(x AS h, i AS at)))"
    covered = _let(pairs, "p", _COVERED.format(n=window))
    return _let(hashes, "h", f"if(size(array_distinct(h)) = size(h), 0, {covered})")


def facts(text: str) -> Column:
    """A struct of the counts that rules look at, for a text column; null has no words."""
    words = _let(f"filter(split(t, r'{_SPACE}'), w -> w <> '')", "ws", f"""struct(
      size(ws) AS n_words, {repeat_words("ws")} AS n_repeat_words, size(array_distinct(ws)) AS n_distinct)""")
    lines = _let(r"filter(split(t, '\n'), l -> l rlike r'[^\x20\x09-\x0D]')", "ls",
                 "struct(size(ls) AS n_lines, size(ls) - size(array_distinct(ls)) AS n_dup_lines)")
    marks = _let("regexp_replace(t, '[^A-Z!#*$%&|<>]+', '')", "m", """struct(
      length(regexp_replace(m, '[A-Z!]+', '')) AS n_symbols, length(regexp_replace(m, '[^A-Z]+', '')) AS n_capitals,
      length(regexp_replace(m, '[^!]+', '')) AS n_cries)""")
    chars = f"length(regexp_replace(t, r'{_SPACE}', ''))"
    return F.expr(_let(f"coalesce(cast(`{text}` AS string), '')", "t",
                       f"struct({words} AS w, {lines} AS l, {marks} AS m, {chars} AS word_chars)"))


def add_facts(documents: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The kept columns and the counts of FACTS (long) for whole texts."""
    keep = [c for c in (documents.columns if keep is None else keep) if c not in FACTS and (keep is not None or c != text)]
    found = documents.select(*[F.col(f"`{c}`") for c in keep], facts(text).alias("__facts"))
    place = {"n_words": "w", "n_repeat_words": "w", "n_distinct": "w", "n_lines": "l", "n_dup_lines": "l", "n_symbols": "m",
             "n_capitals": "m", "n_cries": "m"}
    names = {name: f"__facts.{place[name]}.{name}" if name in place else f"__facts.{name}" for name in FACTS}
    return found.select(*[F.col(f"`{c}`") for c in keep], *[F.col(at).cast("long").alias(n) for n, at in names.items()])


def _vote(good: Column, bad: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0)


Pattern = tuple[tuple[int, ...], int]
Accuracy = dict[str, dict[int, float]]
# First guesses: how often a rule votes good, abstains and votes bad, on good and on bad documents.
CLEAR: Accuracy = {"good": {1: 0.85, 0: 0.12, -1: 0.03}, "bad": {1: 0.40, 0: 0.20, -1: 0.40}}
VAGUE: Accuracy = {"good": {1: 0.75, 0: 0.17, -1: 0.08}, "bad": {1: 0.50, 0: 0.25, -1: 0.25}}


def rules() -> dict[str, tuple[Column, Accuracy]]:
    """The votes, over the columns of FACTS, and the first guess at each rule's accuracy.

    Every rule knows what is good and what is bad and abstains in between. Rules that would look
    at the same fault, such as equal lines and equal windows, are one rule, since faults that
    two rules always see together would pass for a class of documents."""
    n, chars, distinct = F.col("n_words"), F.col("word_chars"), F.col("n_distinct")
    marks, cries, capitals = F.col("n_symbols"), F.col("n_cries"), F.col("n_capitals")
    lines, same, again = F.col("n_lines"), F.col("n_dup_lines"), F.col("n_repeat_words")
    return {
        "length": (_vote(n >= 50, n < 25), VAGUE),
        "word_length": (_vote((2 * chars >= 9 * n) & (2 * chars <= 13 * n), (chars < 4 * n) | (2 * chars > 15 * n)), CLEAR),
        "symbols": (_vote(100 * marks <= n, 10 * marks > n), CLEAR),
        "repetition": (_vote((same == 0) & (100 * again <= n), (4 * same > lines) | (10 * again > n)), VAGUE),
        "capitals": (_vote((200 * capitals >= chars) & (25 * capitals <= chars), (10 * capitals > chars) | (capitals == 0)), VAGUE),
        "cries": (_vote(cries == 0, 50 * cries > n), VAGUE),
        "variety": (_vote(distinct >= F.pow(n, F.lit(0.94)), distinct < F.pow(n, F.lit(0.90))), CLEAR),
    }


def estimate(patterns: list[Pattern], start: list[Accuracy], rounds: int = ROUNDS, trust: float = TRUST) -> tuple[float, list[Accuracy]]:
    """The share of good documents, and per rule how good and bad ones are voted on, by expectation-maximisation.

    The first guesses stay in as if `trust` times as many documents had been seen with them:
    too few to decide, enough that "good" and "bad" keep their sides. No patterns leave the
    guesses as they are.
    """
    prior, tables = PRIOR, start
    total = sum(n for _, n in patterns)
    for _ in range(rounds if total else 0):
        good = [(votes, n, n * posterior(votes, prior, tables)) for votes, n in patterns]
        prior = (sum(g for _, _, g in good) + trust * total * PRIOR) / (total * (1 + trust))
        new = []
        for j, first in enumerate(start):
            table: Accuracy = {}
            for side in ("good", "bad"):
                seen = {1: 0.0, 0: 0.0, -1: 0.0}
                for votes, n, g in good:
                    seen[votes[j]] += g if side == "good" else n - g
                mass = sum(seen.values())
                table[side] = {v: (seen[v] + 1 + trust * mass * first[side][v]) / (mass * (1 + trust) + 3) for v in seen}
            new.append(table)
        tables = new
    return prior, tables


def weights(tables: list[Accuracy]) -> list[dict[int, float]]:
    """What each vote of a rule adds to the log-odds of good; abstentions say nothing."""
    return [{v: math.log(t["good"][v] / t["bad"][v]) if v else 0.0 for v in (1, 0, -1)} for t in tables]


def posterior(votes: tuple[int, ...], prior: float, tables: list[Accuracy]) -> float:
    odds = math.log(prior / (1 - prior)) + sum(w[v] for w, v in zip(weights(tables), votes))
    return 1 / (1 + math.exp(-odds))


def judge(documents: DataFrame, text: str = "text", keep: list[str] | None = None,
          min_posterior: float = MIN_POSTERIOR) -> DataFrame:
    """The kept columns, the counts, base_failed, quality (posterior probability of good) and kept.

    base_failed: fewer than 10 words, or over a fifth of the words in repeated windows of five;
    such documents are not kept. Null and empty texts have no words and fail. Equal rows get
    equal results, and an empty table gives no rows. The counts are written once, to the shared
    folder, and read for the estimate and for the result.
    """
    made = (*FACTS, "base_failed", "quality", "kept")
    keep = [c for c in (documents.columns if keep is None else keep) if c not in made and (keep is not None or c != text)]
    votes = rules()
    counted = materialise(add_facts(documents, text, keep), "quality-facts")
    names = [f"__v{i}" for i in range(len(votes))]
    voted = counted.select("*", *[vote.alias(n) for n, (vote, _) in zip(names, votes.values())])
    patterns = sorted((tuple(r)[:-1], r["n"]) for r in voted.groupBy(*names).agg(F.count("*").alias("n")).collect())
    prior, tables = estimate(patterns, [first for _, first in votes.values()])
    odds = F.lit(math.log(prior / (1 - prior)))
    for name, own in zip(names, weights(tables)):
        odds = odds + F.when(F.col(name) == 1, own[1]).when(F.col(name) == -1, own[-1]).otherwise(0.0)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return voted.withColumn("base_failed", failed).withColumn("quality", 1 / (1 + F.exp(-odds))).withColumn(
        "kept", ~F.col("base_failed") & (F.col("quality") >= min_posterior)).drop(*names)
