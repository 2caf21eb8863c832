"""One score and severity out of the detector flags, and the summary tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from viario import config as fixed
from viario.functions.numbers import flag
from viario.operators.features import severity
from viario.operators.pivots import severity_by_hour
from viario.operators.ranking import top_rows


def add_score(df: DataFrame) -> DataFrame:
    """Add anomaly_score (0..100, more in peak hours and on weekdays) and severity_level."""
    base = reduce(lambda a, b: a + b, [
        F.col(name).cast("int") * weight for name, weight in fixed.DETECTOR_WEIGHTS.items()
    ]).cast("double")
    factor = F.lit(1.0)
    if "es_hora_pico" in df.columns:
        factor *= F.when(flag(df, "es_hora_pico"), fixed.PEAK_FACTOR).otherwise(1.0)
    if "es_fin_semana" in df.columns:
        factor *= F.when(flag(df, "es_fin_semana"), 1.0).otherwise(fixed.WEEKDAY_FACTOR)
    score = F.bround(F.greatest(F.lit(0.0), F.least(F.lit(100.0), base * factor)), 2)
    return df.withColumn("anomaly_score", score).withColumn(
        "severity_level", severity(F.col("anomaly_score"))
    )


def anomalies_of(df: DataFrame) -> DataFrame:
    return df.where(F.col("severity_level") != fixed.SEVERITY_LEVELS[0])


def top_critical_corridors(df: DataFrame, n: int = 10) -> DataFrame:
    """Corridors with the most rows of the highest level."""
    critical = df.where(F.col("severity_level") == fixed.SEVERITY_LEVELS[3])
    counts = critical.dropna(subset=["corredor"]).groupBy("corredor").agg(
        F.count("anomaly_score").alias("n_criticos"), F.avg("anomaly_score").alias("score_medio")
    )
    return top_rows(counts, n, "n_criticos", "corredor")


def top_anomalous_communes(df: DataFrame, n: int = 5) -> DataFrame:
    """Communes with the highest mean score of their anomalies."""
    means = anomalies_of(df).dropna(subset=["nombre_comuna"]).groupBy("nombre_comuna").agg(
        F.avg("anomaly_score").alias("score_medio"), F.count("anomaly_score").alias("n_anomalias")
    )
    return top_rows(means, n, "score_medio", "nombre_comuna")


def summary_counts(df: DataFrame) -> DataFrame:
    """One row: anomalies, rows, share, rows per level and per detector."""
    is_anomaly = F.col("severity_level") != fixed.SEVERITY_LEVELS[0]
    total, found = F.count(F.lit(1)), F.count_if(is_anomaly)
    levels = {f"nivel_{i}": F.count_if(F.col("severity_level") == name)
              for i, name in enumerate(fixed.SEVERITY_LEVELS)}
    flags = {f"n_{name}": F.count_if(F.col(column))
             for name, column in fixed.DETECTOR_COLUMNS.items()}
    share = F.bround(F.lit(100.0) * found / F.greatest(total, F.lit(1)), 2)
    return df.agg(
        found.alias("total_anomalias"), total.alias("total_registros"),
        share.alias("pct_anomalos"), *[c.alias(n) for n, c in (levels | flags).items()],
    )


def summaries(df: DataFrame) -> dict[str, DataFrame]:
    """The tables that a detector run delivers."""
    found = anomalies_of(df)
    empty = "hora" not in df.columns
    return {
        "df_anomalies": found,
        "top_corridors": top_critical_corridors(df) if "corredor" in df.columns else
        df.sparkSession.createDataFrame([], "corredor string, n_criticos bigint, score_medio double"),
        "top_communes": top_anomalous_communes(df) if "nombre_comuna" in df.columns else
        df.sparkSession.createDataFrame(
            [], "nombre_comuna string, score_medio double, n_anomalias bigint"),
        "hourly_pattern": df.sparkSession.createDataFrame([], "hora int") if empty
        else severity_by_hour(found),
        "summary_stats": summary_counts(df),
    }
