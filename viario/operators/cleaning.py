"""Cell-level cleaning of text columns with a log of every change."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F

from viario.functions.numbers import number
from viario.functions.text import clean_text, text_changed
from viario.schema import string_columns

LOG_SCHEMA = (
    "archivo string, fila bigint, columna string, valor_original string, valor_limpio string"
)
_MARK = "__clean_"


def _quoted(name: str) -> Column:
    return F.col(f"`{name}`")


def clean_columns(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """Clean the listed columns that exist; null cells stay null. Stateless, so it works on
    a stream as it does on a table."""
    present = {n for n in names if n in df.columns}
    return df.select(*[
        F.when(_quoted(n).isNotNull(), clean_text(_quoted(n))).alias(n) if n in present
        else _quoted(n) for n in df.columns
    ])


def change_log(
    df: DataFrame, names: Iterable[str], file: str, position: str, offset: int = 0
) -> DataFrame:
    """One row per changed cell; `position` counts rows from 0, the log counts file lines."""
    cells = [
        F.struct(F.lit(n).alias("columna"), _quoted(n).cast("string").alias("valor_original"),
                 clean_text(_quoted(n)).alias("valor_limpio"))
        for n in names if n in df.columns
    ]
    if not cells:
        return df.sparkSession.createDataFrame([], LOG_SCHEMA)
    changed = F.filter(
        F.array(*cells), lambda c: text_changed(c["valor_original"], c["valor_limpio"])
    )
    line = (F.col(position) + F.lit(offset + 2)).cast("bigint")
    return df.select(F.lit(file).alias("archivo"), line.alias("fila"), F.inline(changed))


def change_counts(log: DataFrame) -> DataFrame:
    """Changed cells per file and column."""
    return log.groupBy("archivo", "columna").agg(F.count(F.lit(1)).alias("celdas_modificadas"))


def cleaning_totals(log: DataFrame) -> DataFrame:
    """Changed cells and touched columns per file, and for all files together (null file).

    Counting per column first leaves one row per column of a file to be listed."""
    counts = change_counts(log)
    return counts.rollup("archivo").agg(
        F.sum("celdas_modificadas").alias("celdas_modificadas"),
        F.array_sort(F.collect_set("columna")).alias("columnas_limpias"),
    )


def text_columns(df: DataFrame, skip: Iterable[str] = (), numeric_share: float = 0.9) -> list[str]:
    """String columns that hold text: fewer of their present values are numbers than the share.

    One pass over all rows and columns."""
    names = [n for n in string_columns(df) if n not in set(skip)]
    if not names:
        return []
    shares = df.agg(*[
        F.avg(F.when(_quoted(n).isNotNull(), number(_quoted(n)).isNotNull().cast("int"))).alias(f"c{i}")
        for i, n in enumerate(names)
    ]).first()
    return [n for i, n in enumerate(names) if shares[i] is not None and shares[i] < numeric_share]
