"""Interquartile fence on the index."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from viario.config import IQR_FACTOR, IQR_MIN_ROWS
from viario.functions.numbers import flag, no_nan
from viario.operators.quantiles import quantiles
from viario.operators.small import join_groups

GROUP = ("corredor", "franja_horaria", "es_fin_semana")


def detect_iqr(
    df: DataFrame, value: str = "icv", group: tuple[str, ...] = GROUP,
    factor: float = IQR_FACTOR, min_rows: int = IQR_MIN_ROWS, **options,
) -> DataFrame:
    """Add iqr_anomaly: the value lies above the upper fence of its group."""
    keys = [c for c in group if c in df.columns]
    if value not in df.columns or not keys:
        return df.withColumn("iqr_anomaly", F.lit(False))
    as_key = {
        f"__k{i}": flag(df, c) if c == "es_fin_semana" else F.col(c)
        for i, c in enumerate(keys)
    }
    keyed = df.withColumns(as_key)
    bounds = quantiles(
        keyed, value, {"__q1": 0.25, "__q3": 0.75}, list(as_key), **options
    ).where(F.col("n_values") >= min_rows).select(
        *as_key, (F.col("__q3") + factor * (F.col("__q3") - F.col("__q1"))).alias("__fence")
    )
    above = F.coalesce(no_nan(F.col(value)) > F.col("__fence"), F.lit(False))
    return (
        join_groups(keyed, bounds, list(as_key)).withColumn("iqr_anomaly", above)
        .select(*df.columns, "iqr_anomaly")
    )
