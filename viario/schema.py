"""Optional columns, stable schemas and row identity."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, functions as F, types as T


def has(df: DataFrame, *names: str) -> bool:
    return all(name in df.columns for name in names)


def first_present(df: DataFrame, *names: str) -> str | None:
    return next((name for name in names if name in df.columns), None)


def typed(df: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """Exactly these columns and types; the missing ones are null."""
    return df.select(*[
        (F.col(f"`{name}`") if name in df.columns else F.lit(None)).cast(kind).alias(name)
        for name, kind in columns.items()
    ])


def keep_present(df: DataFrame, wanted: Iterable[str]) -> DataFrame:
    """Only the wanted columns the table has, so that the scan reads no others."""
    return df.select(*[F.col(f"`{name}`") for name in wanted if name in df.columns])


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def row_hash(df: DataFrame, row_id: Iterable[str] | None = None, seed: int = 0) -> Column:
    """A number per row that depends on its content only, so that a lost task gives it again."""
    names = list(row_id) if row_id else df.columns
    return F.xxhash64(F.lit(seed), *[F.col(f"`{name}`") for name in names])
