"""Summary numbers: scaling, imputation, description, correlation, histogram, mode."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from viario.functions.numbers import no_nan
from viario.operators.quantiles import quantiles
from viario.operators.small import join_groups


def one_row(df: DataFrame, **aggregates: Column) -> Column:
    """Aggregates over the whole table as one struct-valued scalar."""
    return df.agg(F.struct(*[c.alias(n) for n, c in aggregates.items()]).alias("s")).scalar()


def min_max(value: Column, low: Column, high: Column) -> Column:
    """Scale to 0..1; a constant column becomes 0."""
    return F.when(high == low, F.lit(0.0)).otherwise(
        F.try_divide(value - low, high - low)
    )


@dataclass(frozen=True)
class Facts:
    """What one pass over a table tells about a column."""

    low: float | None
    high: float | None
    gaps: int
    distinct: int


def column_facts(df: DataFrame, names: list[str]) -> dict[str, Facts]:
    """Ends, missing values and about how many distinct ones, of all columns in one pass."""
    numeric = {n: no_nan(F.col(n)) for n in names if n in df.columns}
    if not numeric:
        return {}
    kinds = {"low": F.min, "high": F.max, "gaps": lambda v: F.count_if(v.isNull()),
             "distinct": F.approx_count_distinct}
    row = df.agg(*[
        F.struct(*[f(v).alias(kind) for kind, f in kinds.items()]).alias(n)
        for n, v in numeric.items()
    ]).first()
    return {n: Facts(**row[n].asDict()) for n in numeric}


def scaled_column(name: str, facts: Facts | None) -> Column:
    """Min-max scaling; an empty column gives null, one that does not exist gives 0."""
    if facts is None:
        return F.lit(0.0)
    return min_max(no_nan(F.col(name)), F.lit(facts.low), F.lit(facts.high))


def filled_scaled_column(df: DataFrame, name: str, facts: Facts | None) -> Column:
    """Min-max scaling after filling gaps with the median; a missing or empty column gives 0.

    The median lies between the ends, so filling does not move them."""
    if facts is None or facts.low is None:
        return F.lit(0.0)
    value = no_nan(F.col(name))
    if facts.gaps:
        middle = quantiles(df, name, {"q": 0.5}, known_distinct=facts.distinct).first()["q"]
        value = F.coalesce(value, F.lit(middle))
    return min_max(value, F.lit(facts.low), F.lit(facts.high))


def scaled(df: DataFrame, name: str) -> Column:
    return scaled_column(name, column_facts(df, [name]).get(name))


def standardised(df: DataFrame, names: list[str]) -> dict[str, Column]:
    """(x - mean) / population deviation, where a zero deviation counts as 1."""
    moments = one_row(df, **{
        f"{kind}_{n}": f(F.col(n).cast("double"))
        for n in names for kind, f in (("mean", F.avg), ("dev", F.stddev_pop))
    })
    return {
        n: (F.col(n).cast("double") - moments[f"mean_{n}"])
        / F.when(moments[f"dev_{n}"] > 0, moments[f"dev_{n}"]).otherwise(F.lit(1.0))
        for n in names
    }


QUARTILES = {"p25": 0.25, "p50": 0.5, "p75": 0.75}


def describe(df: DataFrame, names: list[str]) -> DataFrame:
    """Count, mean, deviation, minimum, quartiles and maximum, one row per column."""
    basic = {"count": F.count, "mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
    flat = df.agg(*[
        f(no_nan(F.col(name))).alias(f"{name}|{kind}")
        for name in names for kind, f in basic.items()
    ])
    rows = []
    distinct = df.agg(*[F.approx_count_distinct(name).alias(name) for name in names]).first()
    for name in names:
        middle = quantiles(df, name, QUARTILES, known_distinct=distinct[name]).select(F.struct(*QUARTILES).alias("s")).scalar()
        fields = {kind: F.col(f"`{name}|{kind}`") for kind in basic}
        fields |= {q: middle[q] for q in QUARTILES}
        order = ["count", "mean", "std", "min", *QUARTILES, "max"]
        rows.append(F.struct(F.lit(name).alias("variable"), *[fields[k].alias(k) for k in order]))
    return flat.select(F.inline(F.array(*rows)))


def box_stats(df: DataFrame, value: str, keys: list[str], factor: float = 1.5) -> DataFrame:
    """Quartiles, fences and the outermost values inside the fences, per group."""
    q = quantiles(df, value, QUARTILES, keys)
    spread = (F.col("p75") - F.col("p25")) * factor
    fences = q.withColumns({"low_fence": F.col("p25") - spread, "high_fence": F.col("p75") + spread})
    inside = F.col(value).between(F.col("low_fence"), F.col("high_fence"))
    whiskers = join_groups(df, fences, keys, "inner").groupBy(*keys).agg(
        F.min(F.when(inside, F.col(value))).alias("low_whisker"),
        F.max(F.when(inside, F.col(value))).alias("high_whisker"),
        F.count_if(~inside).alias("n_outliers"),
    )
    return fences.join(whiskers, keys)


def correlations(df: DataFrame, names: list[str]) -> DataFrame:
    """Pearson matrix in one pass: one row per variable, one column per other variable.

    Each pair uses the rows where both are present.
    """
    pairs = {}
    for a in names:
        for b in names:
            x, y = no_nan(F.col(a)), no_nan(F.col(b))
            both = x.isNotNull() & y.isNotNull()
            pairs[f"{a}|{b}"] = F.corr(F.when(both, x), F.when(both, y))
    flat = df.agg(*[c.alias(n) for n, c in pairs.items()])
    rows = F.array(*[
        F.struct(F.lit(a).alias("variable"), *[F.col(f"`{a}|{b}`").alias(b) for b in names])
        for a in names
    ])
    return flat.select(F.inline(rows))


def histogram(df: DataFrame, value: str, bins: int = 60) -> DataFrame:
    """Rows per bin of equal width; the last bin includes the maximum, empty bins are shown."""
    v = no_nan(F.col(value))
    ends = one_row(df, low=F.min(v), high=F.max(v))
    constant = ends["high"] == ends["low"]
    low = F.when(constant, ends["low"] - 0.5).otherwise(ends["low"])
    extent = F.when(constant, F.lit(1.0)).otherwise(ends["high"] - ends["low"])
    index = F.least(F.floor(bins * (v - low) / extent), F.lit(bins - 1))
    counts = (
        df.where(v.isNotNull()).groupBy(index.cast("int").alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(counts, "bin", "left").select(
        "bin", (low + extent * F.col("bin") / bins).alias("from_value"),
        (low + extent * (F.col("bin") + 1) / bins).alias("to_value"),
        F.coalesce("n", F.lit(0).cast("bigint")).alias("n"),
    )


def mode_by_group(df: DataFrame, value: str, keys: list[str], name: str) -> DataFrame:
    """Most frequent value per group, the smallest on ties. Values are counted first, so a
    group is never gathered as a whole."""
    counts = df.dropna(subset=[*keys, value]).groupBy(*keys, value).agg(
        F.count(F.lit(1)).alias("__n")
    )
    best = F.min(F.struct((-F.col("__n")).alias("rarity"), F.col(value).alias("value")))
    return counts.groupBy(*keys).agg(best["value"].alias(name))


def share_of_total(df: DataFrame, count: str, name: str, percent: bool = True) -> DataFrame:
    """Add the share that each row of an aggregate has in the sum over the aggregate."""
    total = df.agg(F.sum(count)).scalar()
    return df.withColumn(name, F.try_divide(F.col(count), total) * (100.0 if percent else 1.0))


def value_counts(df: DataFrame, name: str, count: str = "n") -> DataFrame:
    """Rows per value, most frequent first, missing values left out."""
    return (
        df.dropna(subset=[name]).groupBy(name).agg(F.count(F.lit(1)).alias(count))
        .orderBy(F.desc(count), F.asc(name))
    )

