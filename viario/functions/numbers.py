"""Lenient numbers and flags."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from viario.config import FALSE_WORDS, TRUE_WORDS

NUMBER = r"\A\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*\z"


def no_nan(c: Column) -> Column:
    """NaN is a missing value."""
    d = c.cast("double")
    return F.when(~F.isnan(d), d)


def number(c: Column) -> Column:
    """Text or number as a double; what is no number becomes null."""
    text = c.cast("string")
    return no_nan(F.when(text.rlike(NUMBER), F.trim(text).try_cast("double")))


def decimal_comma(c: Column) -> Column:
    return number(F.replace(c.cast("string"), F.lit(","), F.lit(".")))


def spanish_number(c: Column) -> Column:
    """'1.200' is 1200, '492,314' is 492.314, '12.5' is 12.5."""
    text = F.translate(F.trim(c.cast("string")), "\"'", "")
    joined = F.replace(text, F.lit("."), F.lit(""))
    return number(
        F.when(text.contains(","), F.replace(joined, F.lit(","), F.lit(".")))
        .when(text.rlike(r"\A[^.]*\.\d{3}\z"), joined)
        .otherwise(text)
    )


def row_sum(columns: list[Column]) -> Column:
    """Sum over the columns of a row; null only when all are null."""
    if not columns:
        return F.lit(None).cast("double")
    total = reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(0.0)) for c in columns])
    return F.when(F.coalesce(*columns).isNotNull(), total)


def to_bool(c: Column) -> Column:
    """True for the known words of truth, false for everything else."""
    return F.coalesce(F.lower(F.trim(c.cast("string"))).isin(TRUE_WORDS), F.lit(False))


def flag(df: DataFrame, name: str) -> Column:
    """A boolean column as it is, a text column by its words of truth; missing is false."""
    if isinstance(df.schema[name].dataType, T.BooleanType):
        return F.coalesce(F.col(name), F.lit(False))
    return to_bool(F.col(name))


def restore_booleans(df: DataFrame, names: list[str]) -> DataFrame:
    """Text flags back to booleans; a column with no known word stays as it is."""
    texts = [n for n in names if n in df.columns
             and not isinstance(df.schema[n].dataType, T.BooleanType)]
    if not texts:
        return df
    parsed = {}
    for n in texts:
        word = F.lower(F.trim(F.col(n).cast("string")))
        parsed[n] = F.when(word.isin(TRUE_WORDS), True).when(word.isin(FALSE_WORDS), False)
    known = df.agg(*[F.count(parsed[n]).alias(n) for n in texts]).first()
    return df.withColumns({
        n: F.coalesce(parsed[n], F.lit(False)) for n in texts if known[n] > 0
    })
