"""Dates, hours and places out of text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from viario.config import DAY_NAMES
from viario.functions.numbers import number

ISO_FIRST = [
    "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd",
    "yyyy/MM/dd HH:mm:ss", "yyyy/MM/dd",
    "d/M/yyyy H:mm:ss", "d/M/yyyy H:mm", "d/M/yyyy",
    "d-M-yyyy H:mm:ss", "d-M-yyyy H:mm", "d-M-yyyy",
]
CENTURY_PIVOT = 69


def day_first_timestamp(c: Column, formats: list[str] | None = None) -> Column:
    """ISO text, else day before month; null when nothing fits."""
    text = F.regexp_replace(F.trim(c.cast("string")), r"\.\d+\z", "")
    tries = [F.try_to_timestamp(text, F.lit(f)) for f in formats or ISO_FIRST]
    return F.coalesce(*tries).cast("timestamp_ntz")


def ddmmyy_timestamp(c: Column) -> Column:
    """Six digits, leading zeros optional; years from 69 on are in the last century."""
    text = F.trim(c.cast("string"))
    six = F.when(text.rlike(r"\A\d{1,6}\z"), F.lpad(text, 6, "0"))
    day, month, short = (F.substring(six, start, 2).cast("int") for start in (1, 3, 5))
    year = short + F.when(short < CENTURY_PIVOT, 2000).otherwise(1900)
    zero = F.lit(0)
    return F.try_make_timestamp_ntz(year, month, day, zero, zero, zero.cast("decimal(16,6)"))


def utc_timestamp(c: Column) -> Column:
    """An instant as UTC wall time; text without a zone is UTC already."""
    text = F.trim(c.cast("string"))
    zoned = text.rlike(r"(?i)(z|utc|gmt|[+-]\d{2}:?\d{2})\z")
    local = text.try_cast("timestamp").cast("timestamp_ntz")
    return F.when(
        zoned, F.convert_timezone(F.current_timezone(), F.lit("UTC"), local)
    ).otherwise(text.try_cast("timestamp_ntz"))


def hour_token(c: Column) -> Column:
    """The hour of '14:00:00', '14' or '14.0'."""
    return number(F.split_part(c.cast("string"), F.lit(":"), F.lit(1))).try_cast("int")


def place_coordinates(c: Column) -> Column:
    """struct(lon, lat) out of "{'lon': '..', 'lat': '..'}"; a bad part spoils both."""
    parts = {
        axis: F.nullif(F.regexp_extract(c.cast("string"), rf"'{axis}'\s*:\s*'([^']+)'", 1), F.lit(""))
        for axis in ("lon", "lat")
    }
    values = {axis: number(text) for axis, text in parts.items()}
    bad = (
        (parts["lon"].isNotNull() & values["lon"].isNull())
        | (parts["lat"].isNotNull() & values["lat"].isNull())
    )
    return F.struct(*[F.when(~F.coalesce(bad, F.lit(False)), v).alias(axis) for axis, v in values.items()])


def period_start(year: Column, month: Column | None = None) -> Column:
    """First day of a month, January when the month is missing."""
    number_of_month = F.lit(1) if month is None else F.coalesce(month.cast("int"), F.lit(1))
    zero = F.lit(0)
    return F.try_make_timestamp_ntz(
        year.cast("int"), number_of_month, F.lit(1), zero, zero, zero.cast("decimal(16,6)")
    )


def with_hour(date: Column, hour: Column) -> Column:
    """The day of a timestamp plus an hour, missing hour is midnight."""
    hours = F.coalesce(hour.cast("int"), F.lit(0))
    return F.date_trunc("day", date).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), hours)


def day_label(day: Column, names: dict[int, str] | None = None, unknown: str = "?") -> Column:
    names = DAY_NAMES if names is None else names
    pairs = [F.lit(x) for kv in names.items() for x in kv]
    return F.coalesce(F.create_map(*pairs)[day.cast("int")], F.lit(unknown))
