"""Cross tables with fixed columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from viario.config import DAY_SHORT, SEVERITY_LEVELS, SLOT_ORDER


def count_pivot(df: DataFrame, row: str, column: str, values: list) -> DataFrame:
    """Rows per (row, column) pair; 0 where a pair is missing."""
    counts = df.dropna(subset=[row]).groupBy(row).pivot(column, values).agg(F.count(F.lit(1)))
    return counts.na.fill(0)


def mean_pivot(df: DataFrame, row: str, column: str, values: list, value: str) -> DataFrame:
    """Mean per (row, column) pair; 0 where a pair is missing."""
    means = df.dropna(subset=[row]).groupBy(row).pivot(column, values).agg(F.avg(value))
    return means.na.fill(0.0)


def row_total(columns: list[str]) -> Column:
    return reduce(lambda a, b: a + b, [F.col(f"`{c}`") for c in columns])


def severity_by_hour(anomalies: DataFrame) -> DataFrame:
    """Anomalies per hour and severity level."""
    return count_pivot(anomalies, "hora", "severity_level", SEVERITY_LEVELS[1:]).orderBy("hora")


def severe_by_hour_and_day(anomalies: DataFrame) -> DataFrame:
    """Severe anomalies for each of the 24 hours and each weekday."""
    days = list(DAY_SHORT.values())
    label = reduce(
        lambda c, kv: c.when(F.col("dia_num") == kv[0], kv[1]),
        list(DAY_SHORT.items())[1:], F.when(F.col("dia_num") == 1, DAY_SHORT[1]),
    )
    severe = anomalies.where(F.col("severity_level").isin(SEVERITY_LEVELS[2:]))
    counts = count_pivot(severe.withColumn("__day", label), "hora", "__day", days)
    hours = anomalies.sparkSession.range(24).select(F.col("id").cast("int").alias("hora"))
    return hours.join(counts, "hora", "left").na.fill(0).orderBy("hora")


def commune_by_slot(df: DataFrame) -> DataFrame:
    """Mean index per commune and time slot, the highest communes first."""
    table = mean_pivot(df, "nombre_comuna", "franja_horaria", SLOT_ORDER, "icv")
    return table.orderBy(row_total(SLOT_ORDER).desc(), "nombre_comuna")


def load_by_corridor_and_hour(df: DataFrame, n: int = 20) -> DataFrame:
    """Mean flow per speed for each hour, of the n corridors with the highest total."""
    hours = list(range(24))
    rows = df.where(F.col("velocidad_km_h") > 0).withColumn(
        "__load", F.col("intensidad") / F.col("velocidad_km_h")
    )
    table = mean_pivot(rows, "corredor", "hora", hours, "__load")
    named = table.select("corredor", *[F.col(f"`{h}`").alias(f"h{h:02d}") for h in hours])
    total = row_total([f"h{h:02d}" for h in hours])
    return named.orderBy(total.desc(), "corredor").limit(n)


def flow_by_hour_and_day(df: DataFrame) -> DataFrame:
    """Mean flow per hour and weekday."""
    table = mean_pivot(df, "hora", "dia_num", list(DAY_SHORT), "intensidad")
    return table.select(
        "hora", *[F.col(f"`{n}`").alias(label) for n, label in DAY_SHORT.items()]
    ).orderBy("hora")
