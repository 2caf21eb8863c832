"""From raw text tables to typed ones, one function per dataset."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from viario.config import POPULATION_TOTAL_ROWS
from viario.functions import dates, numbers, text
from viario.operators.features import physical_range
from viario.schema import has, string_columns

POSITION = "posicion"


def snake_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*[text.snake_case(c) for c in df.columns])


def _apply(df: DataFrame, change, names) -> DataFrame:
    new = {n: change(F.col(n)) for n in names if n in df.columns}
    return df.withColumns(new) if new else df


def clean_speed(raw: DataFrame) -> DataFrame:
    """Hourly speed and flow per corridor and lane."""
    df = snake_columns(raw)
    df = _apply(df, dates.day_first_timestamp, ["fecha_trafico", "fecha"])
    df = _apply(df, numbers.decimal_comma, ["longitud", "latitud"])
    df = _apply(df, numbers.number,
                ["velocidad_km_h", "intensidad", "ocupacion", "dia_num", "mes_num", "ano"])
    df = _apply(df, dates.hour_token, ["hora"])
    df = physical_range(df.dropDuplicates())
    return _apply(df, lambda c: text.repair_words(text.strip(c)),
                  ["corredor", "nombre_comuna", "carril"])


def clean_counts(raw: DataFrame) -> DataFrame:
    """Quarter-hourly vehicle counts."""
    df = snake_columns(raw)
    df = _apply(df, text.blank_to_null, string_columns(df))
    df = _apply(df, dates.ddmmyy_timestamp, ["fecha"])
    df = df.withColumnsRenamed({"coordenadax": "lon", "coordenaday": "lat"})
    vehicles = ["autos", "buses", "camiones", "motos", "bicicletas"]
    measures = ["lon", "lat", *vehicles, *[f"{v}_hora" for v in vehicles],
                "volumen_total_hora", "vehiculo_equivalente"]
    df = _apply(df, numbers.number, measures)
    return _apply(df, text.strip, ["nombre_comuna"])


def clean_sensors(raw: DataFrame) -> DataFrame:
    """Sensor readings with their place."""
    df = snake_columns(raw)
    if has(df, "location"):
        df = df.withColumn("__place", dates.place_coordinates(F.col("location")))
        df = df.withColumns({"lon": F.col("__place.lon"), "lat": F.col("__place.lat")}).drop("__place")
    df = _apply(df, dates.utc_timestamp, ["fechahora"])
    df = _apply(df, numbers.number, ["velocidad", "intensidad", "ocupacion", "headway", "registros"])
    return _apply(df, text.strip, ["corredor"])


def find_year_column(names: list[str]) -> str | None:
    """The year column even when its name was damaged."""
    return next(
        (n for n in names if 1 <= len(n) <= 6 and "a" in n and "o" in n and n != "orden"), None
    )


def passenger_columns(names: list[str]) -> list[str]:
    return [n for n in names if "pax_mov" in n]


def period_of(df: DataFrame) -> Column:
    return dates.period_start(F.col("ano"), F.col("num_mes") if has(df, "num_mes") else None)


def clean_passengers(raw: DataFrame) -> DataFrame:
    """Metro passengers per period with their total."""
    df = snake_columns(raw)
    year = find_year_column(df.columns)
    if year and year != "ano":
        df = df.withColumnRenamed(year, "ano")
    df = _apply(df, numbers.number, ["ano", "semestre", "num_mes"])
    counted = passenger_columns(df.columns)
    df = _apply(df, numbers.spanish_number, counted)
    df = df.withColumn("total_pax", numbers.row_sum([F.col(c) for c in counted]))
    df = df.where(F.coalesce("total_pax", F.lit(0.0)) >= 0)
    return df.withColumn("fecha_periodo", period_of(df)) if has(df, "ano") else df


def clean_population(raw: DataFrame) -> DataFrame:
    """Population per area, totals over areas left out.

    The position in the file, if the raw table has one, decides between equal names."""
    df = raw.toDF(*[c if c == POSITION else text.snake_case(c) for c in raw.columns])
    if has(df, "grupo_edad"):
        df = _apply(df, text.strip, ["grupo_edad"]).where(F.lower("grupo_edad") == "total")
    if has(df, "codigo"):
        area = text.strip(F.col("codigo"))
        df = df.withColumn("nombre_area", area).where(
            F.coalesce(~F.col("nombre_area").isin(POPULATION_TOTAL_ROWS), F.lit(True))
        )
    df = _apply(df, numbers.number, ["total_2019", "hombres_2019", "mujeres_2019"])
    return df.dropna(subset=["total_2019"]) if has(df, "total_2019") else df


def clean_bike_lanes(raw: DataFrame) -> DataFrame:
    return _apply(snake_columns(raw), text.strip, ["nombre", "estado"])
