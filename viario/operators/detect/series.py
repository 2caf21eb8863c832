"""Detectors that look along the time order of a corridor."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from viario.config import SPEED_DROP_PCT, Z_MIN_ROWS, Z_THRESHOLD, Z_WINDOW
from viario.functions.numbers import no_nan
from viario.operators.ordered import Series, over_series

MEASURES = ("velocidad_km_h", "intensidad", "ocupacion")
_ROW = "__row"


def time_order(df: DataFrame) -> list[str]:
    return [c for c in ("fecha_trafico", "hora") if c in df.columns]


def _z_exceeds(series: Series, name: str, window: int, threshold: float) -> Column:
    frame = series.ordered.rowsBetween(1 - window, 0)
    deviation = F.stddev_samp(name).over(frame)
    z = F.try_divide(F.col(name) - F.avg(name).over(frame), F.nullif(deviation, F.lit(0.0)))
    enough = F.count(name).over(frame) >= max(3, window // 4)
    return F.coalesce(enough & (F.abs(z) > threshold), F.lit(False)).cast("int")


def z_score(series: Series, df: DataFrame, key: str, **options) -> dict[str, Column]:
    """Flag rows where at least two measures leave the band of the last rows."""
    window = options.get("window", Z_WINDOW)
    names = [m for m in options.get("measures", MEASURES) if m in df.columns]
    if len(names) < 2:
        return {"z_score_anomaly": F.lit(False)}
    hits = reduce(lambda a, b: a + b, [
        _z_exceeds(series, n, window, options.get("threshold", Z_THRESHOLD)) for n in names
    ])
    large = F.count(F.lit(1)).over(series.rows) >= options.get("min_rows", Z_MIN_ROWS)
    return {"z_score_anomaly": F.col(key).isNotNull() & large & (hits >= 2)}


def speed_drop(series: Series, df: DataFrame, key: str, **options) -> dict[str, Column]:
    """Change against the row before in percent, and a flag for a large fall.

    A gap takes the last speed seen before it."""
    speed = options.get("speed", "velocidad_km_h")
    if speed not in df.columns:
        return {"speed_drop_anomaly": F.lit(False), "speed_drop_pct": F.lit(None).cast("double")}
    before = F.last(speed, True).over(series.ordered.rowsBetween(Window.unboundedPreceding, -1))
    now = F.coalesce(F.col(speed), before)
    change = (
        F.when(before != 0, now / F.when(before != 0, before) - 1)
        .when((before == 0) & (now > 0), F.lit(float("inf")))
        .when((before == 0) & (now < 0), F.lit(float("-inf")))
    )
    pct = F.when(F.col(key).isNotNull(), change * 100)
    fell = pct <= -options.get("drop_pct", SPEED_DROP_PCT)
    return {"speed_drop_anomaly": F.coalesce(fell, F.lit(False)), "speed_drop_pct": pct}


def _along(df, key, order, row_id, detectors, carry, min_rows, sizes, options) -> DataFrame:
    named = df.withColumn(_ROW, F.xxhash64(*df.columns)) if not row_id else df
    measures = {m: no_nan(F.col(m)) for m in {*MEASURES, *options.get("measures", ())}
                if m in df.columns}
    order = (time_order(df) if order is None else order) + (row_id or [_ROW])

    def compute(series: Series) -> dict[str, Column]:
        return {k: v for d in detectors for k, v in d(series, df, key, **options).items()}

    look = max(options.get("window", Z_WINDOW), min_rows) - 1
    result = over_series(
        named.withColumns(measures) if measures else named, [key], order, compute,
        before=look, after=look, carry=carry if carry in df.columns else None, **sizes,
    )
    return result.drop(_ROW)


def detect_z_score(
    df: DataFrame, key: str = "corredor", order: list[str] | None = None,
    row_id: list[str] | None = None, sizes: dict | None = None, **options,
) -> DataFrame:
    """Add z_score_anomaly."""
    min_rows = options.get("min_rows", Z_MIN_ROWS)
    return _along(df, key, order, row_id, [z_score], None, min_rows, sizes or {}, options)


def detect_speed_drop(
    df: DataFrame, key: str = "corredor", order: list[str] | None = None,
    row_id: list[str] | None = None, sizes: dict | None = None, **options,
) -> DataFrame:
    """Add speed_drop_anomaly and speed_drop_pct."""
    speed = options.get("speed", "velocidad_km_h")
    return _along(df, key, order, row_id, [speed_drop], speed, 1, sizes or {}, options)


def detect_along_series(
    df: DataFrame, key: str = "corredor", order: list[str] | None = None,
    row_id: list[str] | None = None, sizes: dict | None = None, **options,
) -> DataFrame:
    """Both detectors with one shuffle and one sort."""
    min_rows = options.get("min_rows", Z_MIN_ROWS)
    speed = options.get("speed", "velocidad_km_h")
    return _along(
        df, key, order, row_id, [z_score, speed_drop], speed, min_rows, sizes or {}, options
    )
