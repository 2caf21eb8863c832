"""Positions, blocks, quantiles and samples, with one key that holds most rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window, functions as F

from viario.operators import ordered, sampling, stats
from viario.operators.quantiles import quantile, quantiles


@pytest.fixture(scope="module")
def skewed(spark):
    """Two thirds of the rows in one group, some keys and values missing, many ties."""
    rng = np.random.default_rng(7)
    n = 3000
    key = np.where(rng.random(n) < 0.66, "hot", rng.choice(list("abcdefgh"), n)).astype(object)
    key[rng.random(n) < 0.03] = None
    value = np.round(rng.normal(50, 20, n), 1).astype(object)
    value[rng.random(n) < 0.1] = None
    frame = pd.DataFrame({"id": np.arange(n), "k": key, "t": rng.integers(0, 40, n), "v": value})
    return frame, spark.createDataFrame(
        [tuple(None if pd.isna(x) else x for x in r) for r in frame.itertuples(index=False)],
        "id long, k string, t long, v double").cache()


def test_number_rows(skewed):
    frame, df = skewed
    got = {r["id"]: r["row_index"] for r in ordered.number_rows(df, ["t", "id"]).collect()}
    want = frame.sort_values(["t", "id"]).reset_index(drop=True)["id"]
    assert got == {int(i): pos for pos, i in enumerate(want)}


def test_weight_before(skewed):
    frame, df = skewed
    rows = ordered.weight_before(df, ["t", "id"], "t").collect()
    sorted_ = frame.sort_values(["t", "id"])
    want = dict(zip(sorted_["id"], sorted_["t"].cumsum() - sorted_["t"]))
    assert {r["id"]: r["before"] for r in rows} == {int(k): int(v) for k, v in want.items()}


def _compute(series):
    last = F.last("v", True).over(series.ordered.rowsBetween(Window.unboundedPreceding, -1))
    frame = series.ordered.rowsBetween(-5, 0)
    keyed = F.col("k").isNotNull()
    return {
        "mean": F.when(keyed, F.round(F.avg("v").over(frame), 6)), "n": F.when(keyed, F.count("v").over(frame)),
        "last": F.when(keyed, last),
        "large": F.when(keyed, F.count(F.lit(1)).over(series.rows) >= 6),
    }


def test_blocks_give_the_same_as_one_window(skewed):
    _, df = skewed
    options = {"before": 5, "after": 5, "carry": "v"}
    columns = ["id", "mean", "n", "last", "large"]
    whole = ordered.over_series(df, ["k"], ["t", "id"], _compute, **options).select(columns)
    for size in (7, 50, 10_000):
        blocks = ordered.over_series(
            df, ["k"], ["t", "id"], _compute, group_rows=0, block_rows=size, **options).select(columns)
        assert sorted(whole.collect()) == sorted(blocks.collect())


def test_carried_value_crosses_many_blocks(spark):
    """A value followed by a long gap is still the last one many blocks later."""
    rows = [(i, "k", i, 10.0 if i == 3 else None) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, k string, t long, v double")
    out = ordered.over_series(df, ["k"], ["t", "id"], _compute, before=5, after=5, carry="v",
                              group_rows=0, block_rows=8)
    last = {r["id"]: r["last"] for r in out.collect()}
    assert all(last[i] is None for i in range(4)) and all(last[i] == 10.0 for i in range(4, 200))


def test_group_quantiles_both_ways(skewed):
    frame, df = skewed
    probs = {"q1": 0.25, "q2": 0.5, "q9": 0.9}
    want = frame.dropna().groupby("k")["v"].apply(lambda s: s.astype(float).quantile([0.25, 0.5, 0.9]).tolist())
    for limit in (None, 0):
        got = {r["k"]: r for r in quantiles(df, "v", probs, ["k"], distinct_values=limit).collect()}
        assert set(got) == set(want.index)
        for k, row in got.items():
            assert np.allclose([row[p] for p in probs], want[k])
            assert row["n_values"] == len(frame[(frame["k"] == k)].dropna())


def test_whole_quantiles_both_ways(skewed):
    frame, df = skewed
    want = frame["v"].dropna().astype(float).quantile(0.67)
    for limit in (None, 0):
        assert quantiles(df, "v", {"q": 0.67}, distinct_values=limit).first()["q"] == pytest.approx(want)


def test_quantiles_in_brackets(spark, monkeypatch):
    """Many distinct values: brackets, then the same with brackets too wide for a buffer."""
    from viario.operators import quantiles as module

    rng = np.random.default_rng(5)
    values = np.concatenate([rng.normal(0, 1, 30_000), np.full(4_000, 0.25), rng.exponential(9, 6_000)])
    df = spark.createDataFrame(pd.DataFrame({"v": values})).repartition(7)
    probs = {"a": 0.05, "b": 0.5, "c": 0.5003, "d": 0.97, "e": 1.0, "f": 0.0}
    want = [np.quantile(values, p) for p in probs.values()]
    monkeypatch.setattr(module, "FEW_VALUES", 100)
    for limit in (500_000, 1):
        row = quantiles(df, "v", probs, distinct_values=limit).first()
        assert np.allclose([row[p] for p in probs], want, rtol=0, atol=1e-12)
        assert row["n_values"] == len(values)


def test_quantile_of_nothing(spark):
    empty = spark.createDataFrame([], "v double")
    assert spark.range(1).select(quantile(empty, "v", 0.5)).first()[0] is None
    assert quantiles(empty, "v", {"q": 0.5}, ["v"]).count() == 0


def test_nan_is_missing(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (3.0,), (None,)], "v double")
    assert quantiles(df, "v", {"q": 0.5}).first()["q"] == 2.0
    row = stats.describe(df, ["v"]).first()
    assert (row["count"], row["mean"], row["min"], row["max"]) == (2, 2.0, 1.0, 3.0)


@pytest.mark.parametrize("bucket_rows", [500_000, 50])
def test_samples_have_exact_sizes(skewed, bucket_rows):
    frame, df = skewed
    def quota(size):
        return F.greatest(F.lit(10), F.floor(size / 4))
    take = sampling.sample_by_group(df, ["k"], quota, row_id=["id"], bucket_rows=bucket_rows)
    again = sampling.sample_by_group(df.repartition(5), ["k"], quota, row_id=["id"], bucket_rows=bucket_rows)
    ids = sorted(r["id"] for r in take.collect())
    assert ids == sorted(r["id"] for r in again.collect()) and len(set(ids)) == len(ids)
    sizes = frame.dropna(subset=["k"]).groupby("k").size()
    got = frame[frame["id"].isin(ids)].groupby("k").size()
    assert got.to_dict() == {k: min(n, max(10, n // 4)) for k, n in sizes.items()}


def test_bucketed_sample_takes_the_same_rows(skewed):
    _, df = skewed
    whole = sampling.sample_by_group(df, ["k"], lambda n: F.lit(30), row_id=["id"])
    parts = sampling.sample_by_group(df, ["k"], lambda n: F.lit(30), row_id=["id"], bucket_rows=10)
    ids = sorted(r["id"] for r in whole.collect())
    assert ids == sorted(r["id"] for r in parts.collect())
    for size in (100, 777):
        other = sampling.sample_rows(df, size, row_id=["id"], bucket_rows=64)
        assert {r["id"] for r in other.collect()} == {r["id"] for r in sampling.sample_rows(df, size, row_id=["id"]).collect()}


def test_stratified_sample_keeps_small_tables(skewed):
    _, df = skewed
    renamed = df.withColumnRenamed("k", "corredor")
    assert sampling.sample_stratified(renamed, 0).count() == 3000
    assert sampling.sample_stratified(renamed, 5000).count() == 3000
    assert sampling.sample_rows(df, 100).count() == 100


def test_mode_and_ranks(spark):
    df = spark.createDataFrame([("a", 2), ("a", 1), ("a", 1), ("a", 2), ("b", None), (None, 1)], "k string, v int")
    assert [tuple(r) for r in stats.mode_by_group(df, "v", ["k"], "m").collect()] == [("a", 1)]


def test_histogram_edges(spark):
    df = spark.createDataFrame([(float(i),) for i in range(11)] + [(None,)], "v double")
    assert [r["n"] for r in stats.histogram(df, "v", 5).orderBy("bin").collect()] == [2, 2, 2, 2, 3]
    flat = spark.createDataFrame([(4.0,), (4.0,)], "v double")
    assert [r["n"] for r in stats.histogram(flat, "v", 4).orderBy("bin").collect()] == [0, 0, 2, 0]


def test_scaling_of_constant_and_empty(spark):
    df = spark.createDataFrame([(4.0, None), (4.0, None)], "a double, b double")
    assert [r[0] for r in df.select(stats.scaled(df, "a")).collect()] == [0.0, 0.0]
    facts = stats.column_facts(df, ["a", "b", "none"])
    assert set(facts) == {"a", "b"}
    assert df.select(stats.filled_scaled_column(df, "b", facts["b"])).first()[0] == 0.0
