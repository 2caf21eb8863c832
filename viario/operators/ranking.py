"""Top-k reports, hotspots and ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from viario.functions.numbers import no_nan, number
from viario.functions.text import corridor_label
from viario.operators.features import (
    estimated_capacity, flow_range, peak_hours, service_level, weekdays,
)
from viario.operators.ordered import number_rows
from viario.operators.quantiles import several_quantiles


def top_rows(df: DataFrame, n: int, by: str, *ties: str | Column) -> DataFrame:
    """The n largest by a column, in order; ties by the given columns, nulls last."""
    return df.orderBy(F.desc_nulls_last(by), *ties).limit(n)


def ranked_top(df: DataFrame, n: int, by: str, *ties: str) -> DataFrame:
    """Top n with a rank from 1. The window sees the n rows of the report only."""
    order = Window.orderBy(F.desc_nulls_last(by), *ties)
    return top_rows(df, n, by, *ties).withColumn("rank", F.row_number().over(order))


def ranked_all(df: DataFrame, by: str, *ties: str) -> DataFrame:
    """Rank over all rows of an aggregate, numbered by ranges rather than in one task."""
    numbered = number_rows(df, [F.desc_nulls_last(by), *[F.asc(t) for t in ties]], "rank")
    return numbered.withColumn("rank", (F.col("rank") + 1).cast("int"))


def rank_corridors(df: DataFrame, config: dict) -> DataFrame:
    """Corridors with the highest mean index, on weekdays unless configured otherwise."""
    cfg = config["rankings"]
    rows = weekdays(df) if cfg["solo_dias_habiles"] else df
    means = rows.dropna(subset=["corredor"]).groupBy("corredor").agg(
        F.avg("icv").alias("icv_medio"), F.max("icv").alias("icv_maximo"),
        F.count("icv").alias("n_registros"),
    )
    return ranked_top(means, cfg["top_corredores"], "icv_medio", "corredor").select(
        "rank", "corredor", "icv_medio", "icv_maximo", "n_registros"
    )


def rank_corridors_by_load(df: DataFrame, config: dict) -> DataFrame:
    """Corridors with the highest volume/capacity ratio."""
    cfg = config.get("ivc", {})
    top_n = cfg.get("top_corredores", 15)
    capacity, free_speed = cfg.get("capacidad_base", 2500), cfg.get("velocidad_libre", 60)
    measured = df.withColumns({c: number(F.col(c)) for c in ("intensidad", "velocidad_km_h")})
    loss = 1 - F.col("velocidad_km_h") / free_speed
    rows = flow_range(measured).withColumn(
        "icv_simple", F.greatest(F.lit(0.0), F.least(F.lit(1.0), loss))
    )
    # Sums per raw name first: the label is then made once per name, not once per row.
    summed = {"velocidad_media": "velocidad_km_h", "intensidad_media": "intensidad",
              "icv_simple_medio": "icv_simple"}
    by_name = rows.groupBy("corredor").agg(
        F.count(F.lit(1)).alias("n_registros"), *[F.sum(c).alias(a) for a, c in summed.items()]
    )
    by_label = by_name.groupBy(corridor_label(F.col("corredor")).alias("corredor")).agg(
        F.sum("n_registros").alias("n_registros"),
        *[(F.sum(a) / F.sum("n_registros")).alias(a) for a in summed],
    )
    means = by_label.withColumn("ivc_medio", F.col("intensidad_media") / capacity)
    return ranked_top(means, top_n, "ivc_medio", "corredor").select(
        "rank", "corredor", "ivc_medio", "velocidad_media", "intensidad_media",
        "icv_simple_medio", "n_registros",
    )


def rank_communes(df: DataFrame, config: dict) -> DataFrame:
    """Communes with the highest mean index in peak hours."""
    means = peak_hours(df).dropna(subset=["nombre_comuna"]).groupBy("nombre_comuna").agg(
        F.avg("icv").alias("icv_medio")
    )
    return ranked_top(
        means, config["rankings"]["top_comunas"], "icv_medio", "nombre_comuna"
    ).select("rank", "nombre_comuna", "icv_medio")


def hotspots(df: DataFrame, config: dict) -> DataFrame:
    """Rows that are slow and busy by the quantiles of this very table."""
    return df.where(is_hotspot(several_quantiles(df, hotspot_shares(config))))


def hotspot_shares(config: dict) -> dict[str, float]:
    cfg = config["rankings"]
    return {
        "velocidad_km_h": cfg["hotspot_velocidad_pct"] / 100,
        "intensidad": cfg["hotspot_intensidad_pct"] / 100,
    }


def is_hotspot(limits: dict[str, Column]) -> Column:
    return (no_nan(F.col("velocidad_km_h")) <= limits["velocidad_km_h"]) & (
        no_nan(F.col("intensidad")) >= limits["intensidad"])


def extreme_group(df: DataFrame, key: str, value: str, *, largest: bool = True) -> DataFrame:
    """The group with the largest or smallest mean, the first key on ties."""
    means = df.dropna(subset=[key]).groupBy(key).agg(F.avg(no_nan(F.col(value))).alias(value))
    order = F.desc_nulls_last(value) if largest else F.asc_nulls_last(value)
    return means.orderBy(order, key).limit(1)


def first_by_class(df: DataFrame, n: int = 50, *ties: str) -> DataFrame:
    """The first rows in order of the class label."""
    return df.orderBy(F.asc("criticidad"), *ties).limit(n)


def service_levels(df: DataFrame) -> DataFrame:
    """Volume/capacity ratio per corridor with capacity guessed from its name."""
    means = df.where(F.col("intensidad") > 0).dropna(subset=["corredor"]).groupBy("corredor").agg(
        F.avg("intensidad").alias("intensidad"), F.avg("velocidad_km_h").alias("velocidad_km_h")
    )
    capacity = estimated_capacity(F.col("corredor"))
    ratio = F.bround(F.col("intensidad") / capacity, 4)
    return means.select(
        "corredor", "intensidad", "velocidad_km_h", capacity.alias("capacidad_estimada"),
        ratio.alias("ivc"), service_level(ratio).alias("nivel_servicio"),
    )

