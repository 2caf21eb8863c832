"""How the given tables stand in for the mobility tables, in Spark and in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from viario.config import default_config
from viario.operators.detect.fence import detect_iqr
from viario.operators.detect.score import add_score
from viario.operators.detect.series import detect_along_series
from viario.operators.features import add_time_features
from viario.operators.index import add_icv
from viario.sources.files import spread
from viario.storage import materialise, path_exists

CONFIG = default_config()
DIGITS = 4
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
_written: dict[tuple, DataFrame] = {}


def query(name: str, sql: str | None = None):
    """Register a query and, if given, the SQL that has the same result."""
    def keep(function):
        QUERIES[name] = function
        if sql is not None:
            SQL[name] = sql
        return function

    return keep


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Doubles to a few digits, so that the order of a sum does not matter."""
    new = {f.name: F.round(f"`{f.name}`", digits) for f in df.schema.fields
           if isinstance(f.dataType, T.DoubleType)}
    return df.withColumns(new) if new else df


def once(spark: SparkSession, folder: str, label: str, build: Callable[[], DataFrame]) -> DataFrame:
    """A table that several queries start from, written to the shared folder at first use."""
    key = (spark.sparkContext.applicationId, folder, label)
    if key not in _written or not all(path_exists(spark, f) for f in _written[key].inputFiles()[:1]):
        _written[key] = materialise(build(), label)
    return _written[key]


def measurements(spark: SparkSession, folder: str) -> DataFrame:
    """Order lines as measurements: supplier is the corridor, its nation the commune."""
    lines = spread(table(spark, folder, "lineitem"))
    suppliers = table(spark, folder, "supplier")
    nations = table(spark, folder, "nation")
    people = F.when(F.col("n_nationkey") % 5 != 0, 100000.0 + 1000.0 * F.col("n_nationkey"))
    joined = lines.join(suppliers, F.col("l_suppkey") == F.col("s_suppkey")).join(
        nations, F.col("s_nationkey") == F.col("n_nationkey")
    )
    rows = joined.select(
        "l_orderkey", "l_linenumber", "l_partkey", F.col("s_name").alias("corredor"),
        F.col("n_name").alias("nombre_comuna"),
        F.col("n_nationkey").cast("string").alias("codigo_comuna"),
        F.col("l_shipdate").alias("fecha_trafico"), (F.col("l_partkey") % 24).alias("hora"),
        (F.weekday("l_shipdate") + 1).alias("dia_num"), F.month("l_shipdate").alias("mes_num"),
        F.col("l_quantity").alias("velocidad_km_h"),
        F.col("l_extendedprice").alias("intensidad"),
        F.nullif(F.col("l_discount"), F.lit(0.0)).alias("ocupacion"),
        people.alias("poblacion_2019"),
    )
    return add_time_features(rows, CONFIG)


def master(spark: SparkSession, folder: str) -> DataFrame:
    """The measurements with the index, as the reports read them."""
    return once(spark, folder, "master", lambda: add_icv(measurements(spark, folder), CONFIG))


SLOTS_SQL = """CASE WHEN hora BETWEEN 0 AND 4 THEN 'madrugada' WHEN hora BETWEEN 5 AND 10 THEN 'manana'
  WHEN hora BETWEEN 11 AND 13 THEN 'mediodia' WHEN hora BETWEEN 14 AND 18 THEN 'tarde'
  WHEN hora BETWEEN 19 AND 23 THEN 'noche' ELSE 'desconocida' END"""

MEASUREMENTS_SQL = f"""
raw_rows AS (
  SELECT l_orderkey, l_linenumber, l_partkey, s_name AS corredor, n_name AS nombre_comuna,
    CAST(n_nationkey AS VARCHAR) AS codigo_comuna, l_shipdate AS fecha_trafico,
    CAST(l_partkey % 24 AS INTEGER) AS hora, CAST(isodow(l_shipdate) AS INTEGER) AS dia_num,
    CAST(month(l_shipdate) AS INTEGER) AS mes_num, l_quantity AS velocidad_km_h,
    l_extendedprice AS intensidad, nullif(l_discount, 0.0) AS ocupacion,
    CASE WHEN n_nationkey % 5 <> 0 THEN CAST(100000 + 1000 * n_nationkey AS DOUBLE) END AS poblacion_2019
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey),
measured AS (
  SELECT *, dia_num >= 6 AS es_fin_semana, {SLOTS_SQL} AS franja_horaria,
    hora IN (7, 8, 17, 18) AS es_hora_pico FROM raw_rows)"""

MASTER_SQL = MEASUREMENTS_SQL + """,
ends AS (
  SELECT min(velocidad_km_h) v0, max(velocidad_km_h) v1, min(intensidad) i0, max(intensidad) i1,
    min(ocupacion) o0, max(ocupacion) o1, median(ocupacion) om,
    min(poblacion_2019) p0, max(poblacion_2019) p1, median(poblacion_2019) pm FROM measured),
master AS (
  SELECT measured.*, round_even(greatest(0.0::DOUBLE, least(100.0::DOUBLE, 100.0::DOUBLE * (
      0.40::DOUBLE * (1 - (velocidad_km_h - v0) / (v1 - v0)) + 0.35::DOUBLE * ((intensidad - i0) / (i1 - i0))
      + 0.25::DOUBLE * ((coalesce(ocupacion, om) - o0) / (o1 - o0)))
    * (1 + 0.15::DOUBLE * ((coalesce(poblacion_2019, pm) - p0) / (p1 - p0))))), 2) AS icv
  FROM measured, ends)"""


def from_master(body: str) -> str:
    return f"WITH {MASTER_SQL} {body}"


HOTSPOTS_SQL = MASTER_SQL + """,
limits AS (SELECT quantile_cont(velocidad_km_h, 0.3) AS v30, quantile_cont(intensidad, 0.7) AS i70 FROM master),
hotspots AS (SELECT master.* FROM master, limits WHERE velocidad_km_h <= v30 AND intensidad >= i70)"""


def from_hotspots(body: str) -> str:
    return f"WITH {HOTSPOTS_SQL} {body}"


def series(spark: SparkSession, folder: str) -> DataFrame:
    """Events as a time series per user, with gaps in the speed."""
    events = spread(table(spark, folder, "events"))
    props = F.get_json_object("props", "$.k").cast("double")
    rows = events.select(
        "event_id", F.col("user_id").cast("string").alias("corredor"),
        F.col("event_type").alias("nombre_comuna"), F.col("ts").alias("fecha_trafico"),
        F.hour("ts").alias("hora"), (F.weekday("ts") + 1).alias("dia_num"),
        F.when(F.col("event_id") % 17 != 0, F.col("value")).alias("velocidad_km_h"),
        props.alias("intensidad"), (F.col("event_id") * 37 % 101).cast("double").alias("ocupacion"),
        F.col("value").alias("icv"),
    )
    return add_time_features(rows, CONFIG)


SERIES_SQL = f"""
events_as_rows AS (
  SELECT event_id, CAST(user_id AS VARCHAR) AS corredor, event_type AS nombre_comuna,
    ts AS fecha_trafico, CAST(hour(ts) AS INTEGER) AS hora, CAST(isodow(ts) AS INTEGER) AS dia_num,
    CASE WHEN event_id % 17 <> 0 THEN value END AS velocidad_km_h,
    CAST(json_extract_string(props, '$.k') AS DOUBLE) AS intensidad,
    CAST(event_id * 37 % 101 AS DOUBLE) AS ocupacion, value AS icv FROM events),
series AS (
  SELECT *, dia_num >= 6 AS es_fin_semana, {SLOTS_SQL} AS franja_horaria,
    hora IN (7, 8, 17, 18) AS es_hora_pico FROM events_as_rows)"""

# A lower threshold than the default, so that this calm data has something to find.
Z_OPTIONS = {"threshold": 1.5}


def _z_sql(name: str) -> str:
    frame = "(PARTITION BY corredor ORDER BY fecha_trafico, hora, event_id ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)"
    return (f"CASE WHEN count({name}) OVER {frame} >= 6 AND abs(({name} - avg({name}) OVER {frame}) / "
            f"nullif(stddev_samp({name}) OVER {frame}, 0)) > 1.5 THEN 1 ELSE 0 END")


ALONG_SQL = SERIES_SQL + f""",
zs AS (
  SELECT *, {_z_sql('velocidad_km_h')} + {_z_sql('intensidad')} + {_z_sql('ocupacion')} AS hits,
    count(*) OVER (PARTITION BY corredor) AS n_group,
    last_value(velocidad_km_h IGNORE NULLS) OVER (PARTITION BY corredor
      ORDER BY fecha_trafico, hora, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS v_before
  FROM series),
along AS (
  SELECT *, n_group >= 24 AND hits >= 2 AS z_score_anomaly,
    (coalesce(velocidad_km_h, v_before) / v_before - 1) * 100 AS speed_drop_pct,
    coalesce((coalesce(velocidad_km_h, v_before) / v_before - 1) * 100 <= -30, false) AS speed_drop_anomaly
  FROM zs)"""

FENCE_SQL = ALONG_SQL + """,
fences AS (
  SELECT corredor, franja_horaria, es_fin_semana, count(icv) AS n_values,
    quantile_cont(icv, 0.25) AS q1, quantile_cont(icv, 0.75) AS q3
  FROM series GROUP BY ALL),
fenced AS (
  SELECT a.*, coalesce(n_values >= 4 AND icv > q3 + 1.5 * (q3 - q1), false) AS iqr_anomaly
  FROM along a JOIN fences f USING (corredor, franja_horaria, es_fin_semana))"""

SCORE_SQL = """
scored AS (
  SELECT *, round_even(greatest(0.0::DOUBLE, least(100.0::DOUBLE, CAST(
      25 * z_score_anomaly::INT + 20 * iqr_anomaly::INT + 30 * speed_drop_anomaly::INT
      + 25 * isolation_forest_anomaly::INT AS DOUBLE)
    * ((CASE WHEN es_hora_pico THEN 1.2::DOUBLE ELSE 1.0::DOUBLE END)
      * (CASE WHEN es_fin_semana THEN 1.0::DOUBLE ELSE 1.1::DOUBLE END)))), 2) AS anomaly_score
  FROM marked),
flagged AS (
  SELECT *, CASE WHEN anomaly_score < 25 THEN 'NORMAL' WHEN anomaly_score < 50 THEN 'MODERADO'
    WHEN anomaly_score < 75 THEN 'ALTO' ELSE 'CRÍTICO' END AS severity_level FROM scored),
anomalies AS (SELECT * FROM flagged WHERE severity_level <> 'NORMAL')"""

# Simple stand-ins for the flags that take long in SQL: by the value and the hour.
FLAGGED_SQL = FENCE_SQL + """,
marked AS (
  SELECT *, icv > 120 AS isolation_forest_anomaly, hora = 3 AND icv < 1 AS dbscan_anomaly,
    0.0::DOUBLE AS isolation_score FROM fenced),""" + SCORE_SQL


def flagged(spark: SparkSession, folder: str) -> DataFrame:
    """The series with all flags, score and severity."""
    def build() -> DataFrame:
        rows = detect_along_series(series(spark, folder), row_id=["event_id"], **Z_OPTIONS)
        marked = detect_iqr(rows).withColumns({
            "isolation_forest_anomaly": F.col("icv") > 120,
            "isolation_score": F.lit(0.0),
            "dbscan_anomaly": (F.col("hora") == 3) & (F.col("icv") < 1),
        })
        return add_score(marked)

    return once(spark, folder, "flagged", build)


def anomalies(spark: SparkSession, folder: str) -> DataFrame:
    return flagged(spark, folder).where("severity_level <> 'NORMAL'")


def from_flagged(body: str) -> str:
    return f"WITH {FLAGGED_SQL} {body}"
