"""Feature columns, filters and classes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from viario import config as fixed
from viario.functions.numbers import flag, no_nan, number
from viario.operators.quantiles import several_quantiles
from viario.schema import has


def lookup(key: Column, table: dict, default) -> Column:
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.coalesce(F.create_map(*pairs)[key], F.lit(default)) if pairs else F.lit(default)


def time_slot(hour: Column, slots: dict[str, list[int]]) -> Column:
    """Name of the slot an hour belongs to."""
    return lookup(hour.cast("int"), {h: s for s, hours in slots.items() for h in hours},
                  fixed.UNKNOWN_SLOT)


def add_time_features(df: DataFrame, config: dict) -> DataFrame:
    """Integer hour, day and month, weekend flag, time slot and peak flag."""
    eta, new = config["eta"], {}
    for name in ("dia_num", "mes_num"):
        if has(df, name):
            new[name] = F.coalesce(number(F.col(name)).cast("int"), F.lit(0))
    if has(df, "dia_num"):
        new["es_fin_semana"] = new["dia_num"] >= 6
    if has(df, "hora"):
        hour = number(F.col("hora")).cast("int")
        peaks = sorted({*eta["hora_pico_manana"], *eta["hora_pico_tarde"]})
        new |= {
            "hora": hour,
            "franja_horaria": time_slot(hour, eta["franjas"]),
            "es_hora_pico": F.coalesce(hour.isin(peaks), F.lit(False)),
        }
    return df.withColumns(new) if new else df


def physical_range(df: DataFrame) -> DataFrame:
    """Rows with the key columns present and values a sensor can give."""
    needed = [c for c in ("velocidad_km_h", "intensidad", "hora", "corredor") if has(df, c)]
    kept = df.dropna(subset=needed) if needed else df
    limits = {
        "velocidad_km_h": F.col("velocidad_km_h").between(1, 100),
        "intensidad": F.col("intensidad") >= 0,
        "hora": F.col("hora").between(0, 23),
    }
    return reduce(lambda d, c: d.where(limits[c]), [c for c in limits if has(df, c)], kept)


def flow_range(df: DataFrame) -> DataFrame:
    """Rows that can enter the volume/capacity index."""
    return df.dropna(subset=["corredor", "intensidad", "velocidad_km_h"]).where(
        (F.col("intensidad") >= 0) & (F.col("velocidad_km_h") > 0) & (F.col("velocidad_km_h") < 120)
    )


def weekdays(df: DataFrame) -> DataFrame:
    return df.where(~flag(df, "es_fin_semana")) if has(df, "es_fin_semana") else df


def peak_hours(df: DataFrame) -> DataFrame:
    return df.where(flag(df, "es_hora_pico")) if has(df, "es_hora_pico") else df


def apply_filters(
    df: DataFrame,
    communes: list[str] | None = None,
    corridors: list[str] | None = None,
    slot: str | None = None,
    day: str | None = None,
) -> DataFrame:
    """All given conditions together; an empty choice or a missing column filters nothing."""
    number_of_day = {name: n for n, name in fixed.DAY_NAMES.items()}.get(day)
    conditions = {
        "nombre_comuna": F.col("nombre_comuna").isin(communes) if communes else None,
        "corredor": F.col("corredor").isin(corridors) if corridors else None,
        "franja_horaria": F.col("franja_horaria") == slot if slot not in (None, "Todas") else None,
        "dia_num": F.col("dia_num") == number_of_day if number_of_day else None,
    }
    active = [c for name, c in conditions.items() if c is not None and has(df, name)]
    return df.where(reduce(lambda a, b: a & b, active)) if active else df


def filter_options(df: DataFrame) -> DataFrame:
    """Distinct (commune, corridor) pairs in order: the options of two cascading filters.

    One row per pair, so that a commune with very many corridors is never one value."""
    schema = {"nombre_comuna": "string", "corredor": "string"}
    if not has(df, *schema):
        return df.sparkSession.createDataFrame([], "nombre_comuna string, corredor string")
    pairs = df.select(*[F.trim(F.col(c).cast("string")).alias(c) for c in schema]).dropna()
    return pairs.where("nombre_comuna <> '' AND corredor <> ''").distinct().orderBy(*schema)


def corridor_options(options: DataFrame, commune: str | None = None) -> DataFrame:
    """Corridors to choose from, of one commune or of all."""
    chosen = options if commune is None else options.where(F.col("nombre_comuna") == commune)
    return chosen.select("corredor").distinct().orderBy("corredor")


def flow_class(df: DataFrame, slow_pct: float = 0.30, flow_pct: float = 0.70) -> DataFrame:
    """Four classes by the speed and flow quantiles of this very table."""
    names = fixed.FLOW_CLASSES
    limits = several_quantiles(df, {"velocidad_km_h": slow_pct, "intensidad": flow_pct})
    slow = no_nan(F.col("velocidad_km_h")) <= limits["velocidad_km_h"]
    busy = no_nan(F.col("intensidad")) >= limits["intensidad"]
    return df.withColumn(
        "criticidad",
        F.when(slow & busy, names["both"]).when(busy, names["flow"])
        .when(slow, names["slow"]).otherwise(names["none"]),
    )


def estimated_capacity(name: Column) -> Column:
    """Vehicles per hour by keywords in the corridor name."""
    upper = F.upper(F.coalesce(name.cast("string"), F.lit("")))
    result = None
    for words, capacity in fixed.CAPACITY_BY_KEYWORD:
        hit = reduce(lambda a, b: a | b, [upper.contains(w) for w in words])
        result = F.when(hit, capacity) if result is None else result.when(hit, capacity)
    return result.otherwise(fixed.DEFAULT_CAPACITY)


def service_level(ratio: Column) -> Column:
    """Level of service of a volume/capacity ratio; a missing ratio is in the last level."""
    below = None
    for bound, name in fixed.SERVICE_LEVELS:
        below = F.when(ratio < bound, name) if below is None else below.when(ratio < bound, name)
    return below.otherwise(fixed.SATURATED)


def severity(score: Column) -> Column:
    """Level of a 0..100 score; a bound belongs to the level above it."""
    low, middle, high = fixed.SEVERITY_BOUNDS
    names = fixed.SEVERITY_LEVELS
    return (
        F.when(score < low, names[0]).when(score < middle, names[1])
        .when(score < high, names[2]).when(score >= high, names[3])
    )
