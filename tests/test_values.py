"""Numbers, flags and dates."""

import datetime as dt

from pyspark.sql import functions as F

from viario.functions import dates, numbers


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def column(spark, values, function):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[1] for r in df.select("i", function(F.col("v"))).orderBy("i").collect()]


def test_numbers(spark):
    assert column(spark, ["12", " 7.5 ", "1e3", "nan", "12d", "", None, "-.5"], numbers.number) == [
        12.0, 7.5, 1000.0, None, None, None, None, -0.5]
    assert column(spark, ["3,5", "4.5", "x"], numbers.decimal_comma) == [3.5, 4.5, None]
    assert column(spark, ["1.200", "492,314", "1.234.567", "12.5", '"1.234,5"', "x", None], numbers.spanish_number) == [
        1200.0, 492.314, None, 12.5, 1234.5, None, None]


def test_row_sum(spark):
    df = spark.createDataFrame([(1.0, None), (None, None), (1.0, 2.0)], "a double, b double")
    assert [r[0] for r in df.select(numbers.row_sum([F.col("a"), F.col("b")])).collect()] == [1.0, None, 3.0]
    assert one(spark, numbers.row_sum([])) is None


def test_booleans(spark):
    assert column(spark, ["True", " SI ", "0", None, "x"], numbers.to_bool) == [True, True, False, False, False]
    df = spark.createDataFrame([("si", "x", True), ("?", "z", False)], "a string, b string, c boolean")
    out = numbers.restore_booleans(df, ["a", "b", "c", "none"])
    assert [tuple(r) for r in out.collect()] == [(True, "x", True), (False, "z", False)]


def test_dates(spark):
    assert column(spark, ["2020-07-13 05:00:00", "13/07/2020", "1/2/2020 7:30", "bad", None], dates.day_first_timestamp) == [
        dt.datetime(2020, 7, 13, 5), dt.datetime(2020, 7, 13), dt.datetime(2020, 2, 1, 7, 30), None, None]
    assert column(spark, ["10718", "010769", "320101", "1234567", "311268"], dates.ddmmyy_timestamp) == [
        dt.datetime(2018, 7, 1), dt.datetime(1969, 7, 1), None, None, dt.datetime(2068, 12, 31)]
    assert column(spark, ["14:00:00", "14.0", "7", "x"], dates.hour_token) == [14, 14, 7, None]
    assert column(spark, ["2020-07-01T03:00:00Z", "2020-07-01 03:00:00-05:00", "2020-07-01 03:00:00", "x"],
                  dates.utc_timestamp) == [
        dt.datetime(2020, 7, 1, 3), dt.datetime(2020, 7, 1, 8), dt.datetime(2020, 7, 1, 3), None]


def test_places(spark):
    values = ["{'lon': '-75.5', 'lat': '6.2'}", "{'lon': 'x', 'lat': '6.2'}", "{'lat': '6.2'}", None]
    assert [tuple(r) if r else r for r in column(spark, values, dates.place_coordinates)] == [
        (-75.5, 6.2), (None, None), (None, 6.2), (None, None)]


def test_periods(spark):
    assert one(spark, dates.period_start(F.lit(2020.0), F.lit(6.0))) == dt.datetime(2020, 6, 1)
    assert one(spark, dates.period_start(F.lit(2020), F.lit(13))) is None
    assert one(spark, dates.period_start(F.lit(2020), F.lit(None))) == dt.datetime(2020, 1, 1)
    start = F.lit("2020-07-01 05:00:00").cast("timestamp_ntz")
    assert one(spark, dates.with_hour(start, F.lit(3))) == dt.datetime(2020, 7, 1, 3)
    assert one(spark, dates.with_hour(start, F.lit(None))) == dt.datetime(2020, 7, 1)
    assert one(spark, dates.day_label(F.lit(3))) == "Miercoles"
    assert one(spark, dates.day_label(F.lit(9))) == "?"
