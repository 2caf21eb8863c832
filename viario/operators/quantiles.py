"""Exact quantiles with linear interpolation, per group or over the whole table."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from viario.functions.numbers import no_nan
from viario.operators.ordered import weight_before

DISTINCT_VALUES = 500_000   # values per group up to here fit one aggregation buffer
FEW_VALUES = 20_000         # up to here a whole column is counted without looking for brackets
BROADCAST_GROUPS = 200_000  # groups up to here are sent to all tasks with their positions
ACCURACY = 10_000           # an approximate quantile is off by at most one in so many ranks
MARGIN = 4 / ACCURACY       # half the width of a bracket, in ranks


def value_counts_by_group(df: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """(keys, __v, __n): how often each value occurs; rows without a key or value are left out."""
    pairs = df.select(*keys, no_nan(F.col(value)).alias("__v")).dropna()
    return pairs.groupBy(*keys, "__v").agg(F.count(F.lit(1)).alias("__n"))


def _most_values(df: DataFrame, value: str, keys: list[str]) -> int:
    distinct = df.groupBy(*keys).agg(F.approx_count_distinct(value).alias("n"))
    return distinct.agg(F.max("n")).first()[0] or 0


def quantiles(
    df: DataFrame,
    value: str,
    probs: dict[str, float],
    keys: list[str] | None = None,
    *,
    distinct_values: int | None = None,
    known_distinct: int | None = None,
) -> DataFrame:
    """One row per group with the named quantiles of a column.

    Values are counted first, so an aggregation buffer holds distinct values, not rows.
    Where a group has too many distinct values for one buffer, the counted values are
    sorted by ranges and the quantile positions are looked up there. For a whole table
    with many values, approximate quantiles first give brackets that the exact ones lie
    in, and values outside all brackets are counted together. `known_distinct` saves the
    look at the number of distinct values when a caller has it already.
    """
    keys = keys or []
    limit = DISTINCT_VALUES if distinct_values is None else distinct_values
    most = _most_values(df, value, keys) if known_distinct is None else known_distinct
    if not keys and FEW_VALUES < most and limit > 0:
        return _in_brackets(df, value, probs, limit)
    counted = value_counts_by_group(df, value, keys)
    if most > limit:
        return _by_position(counted, probs, keys)
    return _by_window(counted, probs, keys) if keys else _from_buffer(counted, probs)


def _from_buffer(counted: DataFrame, probs: dict[str, float]) -> DataFrame:
    at = F.percentile("__v", F.array(*[F.lit(float(p)) for p in probs.values()]), F.col("__n"))
    packed = counted.agg(at.alias("__q"), F.sum("__n").alias("__rows"))
    return packed.select(
        *[F.col("__q")[i].alias(name) for i, name in enumerate(probs)],
        F.coalesce("__rows", F.lit(0).cast("bigint")).alias("n_values"),
    )


def _by_window(counted: DataFrame, probs: dict[str, float], keys: list[str]) -> DataFrame:
    """Positions within a group by a window; a group has at most DISTINCT_VALUES rows here."""
    order = Window.partitionBy(*keys).orderBy("__v")
    placed = counted.withColumns({
        "__first": F.sum("__n").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("__n"),
        "__rows": F.sum("__n").over(
            order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)),
    })
    return _pick(placed, probs, keys)


def _in_brackets(df: DataFrame, value: str, probs: dict[str, float], limit: int) -> DataFrame:
    v = no_nan(F.col(value))
    ends = [min(1.0, max(0.0, p + d)) for p in sorted(probs.values()) for d in (-MARGIN, MARGIN)]
    n, at = df.agg(F.count(v), F.percentile_approx(v, ends, ACCURACY)).first()
    if n * 2 * MARGIN * len(probs) > limit:
        return _by_position(value_counts_by_group(df, value, []), probs, [])
    # Moving the values between two brackets to the next one keeps the order of all values
    # and the values inside the brackets, so the quantiles stay the same.
    brackets = list(zip(at[::2], at[1::2]))
    if not _hold(df, v, n, sorted(probs.values()), brackets):
        return _by_position(value_counts_by_group(df, value, []), probs, [])
    snapped = F.when(v.isNull(), v)
    for low, high in brackets:
        snapped = snapped.when(v < low, F.lit(low)).when(v <= high, v)
    moved = df.select(snapped.otherwise(F.lit(brackets[-1][1])).alias(value))
    return _from_buffer(value_counts_by_group(moved, value, []), probs)


def _hold(df: DataFrame, v: Column, n: int, probs: list[float], brackets: list[tuple]) -> bool:
    """Whether the values at each quantile's position lie in its bracket, by counting."""
    counts = df.agg(*[c for low, high in brackets for c in (F.count_if(v < low), F.count_if(v <= high))]).first()
    return all(
        counts[2 * i] <= math.floor(p * (n - 1)) and math.ceil(p * (n - 1)) < counts[2 * i + 1]
        for i, p in enumerate(probs)
    )


def _by_position(counted: DataFrame, probs: dict[str, float], keys: list[str]) -> DataFrame:
    placed = weight_before(counted, [*keys, "__v"], "__n", "__before")
    if keys:
        groups = placed.groupBy(*keys).agg(
            F.min("__before").alias("__base"), F.sum("__n").alias("__rows")
        )
        few = groups.count() <= BROADCAST_GROUPS
        joined = placed.join(F.broadcast(groups) if few else groups, keys)
    else:
        total = counted.agg(F.sum("__n")).scalar()
        joined = placed.withColumns({"__base": F.lit(0), "__rows": total})
    return _pick(joined.withColumn("__first", F.col("__before") - F.col("__base")), probs, keys)


def _pick(placed: DataFrame, probs: dict[str, float], keys: list[str]) -> DataFrame:
    """Quantiles out of counted values that know their first position and the group's rows."""
    first = F.col("__first")
    last = first + F.col("__n") - 1

    def value_at(position: Column) -> Column:
        return F.max(F.when((position >= first) & (position <= last), F.col("__v")))

    ends, result = [], []
    for i, (name, p) in enumerate(probs.items()):
        position = F.lit(float(p)) * (F.col("__rows") - 1)
        ends += [
            value_at(F.floor(position)).alias(f"__lo{i}"),
            value_at(F.ceil(position)).alias(f"__hi{i}"),
        ]
        part = position - F.floor(position)
        low, high = F.col(f"__lo{i}"), F.col(f"__hi{i}")
        result.append(F.when(low == high, low).otherwise(low * (1 - part) + high * part).alias(name))
    found = placed.groupBy(*keys, "__rows").agg(*ends)
    return found.select(*keys, *result, F.col("__rows").alias("n_values"))


def quantile(df: DataFrame, value: str, p: float, **options) -> Column:
    """One quantile of the whole table as a scalar, null for an empty table."""
    return quantiles(df, value, {"q": p}, **options).select("q").scalar()


def several_quantiles(df: DataFrame, probs: dict[str, float]) -> dict[str, Column]:
    """One quantile for each of several columns, after one look at all of them."""
    distinct = df.agg(*[F.approx_count_distinct(c).alias(c) for c in probs]).first()
    return {c: quantile(df, c, p, known_distinct=distinct[c]) for c, p in probs.items()}


def quantiles_at_once(
    df: DataFrame, wanted: dict[str, tuple[Column, float]], distinct_values: int | None = None,
) -> dict[str, Column]:
    """One exact quantile for each of several expressions, from two reads of the table.

    The first read gives a bracket for each quantile, the second counts the values in the
    brackets and those on either side. A quantile that its bracket does not hold, or whose
    bracket may have too many values for one buffer, is found on its own.
    """
    limit = DISTINCT_VALUES if distinct_values is None else distinct_values
    values = {name: no_nan(v).cast("double") for name, (v, _) in wanted.items()}

    def ends(p: float) -> list[float]:
        return [max(0.0, p - MARGIN), min(1.0, p + MARGIN)]

    seen = df.agg(*[c for name, v in values.items() for c in (
        F.count(v).alias(f"{name}__n"), F.approx_count_distinct(v).alias(f"{name}__d"),
        F.percentile_approx(v, ends(wanted[name][1]), ACCURACY).alias(f"{name}__at"))]).first()
    fits = {name: seen[f"{name}__at"] for name in wanted
            if seen[f"{name}__n"] and min(seen[f"{name}__d"], seen[f"{name}__n"] * 2 * MARGIN) <= limit}
    found = {}
    if fits:
        def place(name: str, v: Column) -> Column:
            low, high = fits[name]
            side = F.when(v < low, -1).when(v > high, 1).otherwise(0)
            return F.when(v.isNotNull(), F.struct(
                F.lit(name).alias("name"), side.alias("side"), F.least(F.greatest(v, F.lit(low)), F.lit(high)).alias("v")))

        placed = df.select(F.explode(F.array(*[place(name, values[name]) for name in fits])).alias("p"))
        counted = placed.where("p is not null").groupBy("p.name", "p.side", "p.v").agg(F.count(F.lit(1)).alias("n"))
        rows = counted.groupBy("name").agg(
            F.percentile("v", F.array(*[F.lit(float(p)) for _, p in wanted.values()]), F.col("n")).alias("at"),
            F.coalesce(F.sum(F.when(F.col("side") < 0, F.col("n"))), F.lit(0)).alias("below"),
            F.coalesce(F.sum(F.when(F.col("side") <= 0, F.col("n"))), F.lit(0)).alias("upto")).collect()
        order = list(wanted)
        for r in rows:
            n, p = seen[f"{r['name']}__n"], wanted[r["name"]][1]
            if r.below <= math.floor(p * (n - 1)) and math.ceil(p * (n - 1)) < r.upto:
                found[r["name"]] = F.lit(r["at"][order.index(r["name"])])
    missing = [name for name in wanted if name not in found]
    return {**found, **{
        name: quantile(df.select(wanted[name][0].alias("__value")), "__value", wanted[name][1],
                       known_distinct=seen[f"{name}__d"]) for name in missing}}


def median(df: DataFrame, value: str, **options) -> Column:
    return quantile(df, value, 0.5, **options)
