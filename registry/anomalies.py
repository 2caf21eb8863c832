"""Detectors, score, summaries and samples on the events."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from registry.tables import (
    ALONG_SQL, CONFIG, DIGITS, FENCE_SQL, MASTER_SQL, SCORE_SQL, SERIES_SQL, Z_OPTIONS, anomalies, flagged, from_flagged,
    master, query, rounded, series, table,
)
from registry.forest_sql import FOREST_SQL
from viario.config import ANOMALY_COLUMNS, Z_THRESHOLD
from viario.operators import pivots, sampling
from viario.operators.detect import fence, forest, noise, score
from viario.operators.detect.series import detect_along_series, detect_speed_drop, detect_z_score
from viario.plans import reports
from viario.plans.detection import AnomalyDetector, detector_breakdown

ID = ["event_id"]
SMALL_BLOCKS = {"group_rows": 0, "block_rows": 97}

Z_SQL = f"WITH {ALONG_SQL} SELECT event_id, z_score_anomaly FROM along"
DROP_SQL = f"WITH {ALONG_SQL} SELECT event_id, speed_drop_anomaly, round(speed_drop_pct, 4) AS speed_drop_pct FROM along"
DROP = ["event_id", "speed_drop_anomaly", "speed_drop_pct"]


@query("rolling_zscore", Z_SQL)
def rolling_zscore(spark, sf):
    return detect_z_score(series(spark, sf), row_id=ID, **Z_OPTIONS).select("event_id", "z_score_anomaly")


@query("rolling_zscore_in_blocks", Z_SQL)
def rolling_zscore_in_blocks(spark, sf):
    """The way for corridors too long for one task."""
    rows = detect_z_score(series(spark, sf), row_id=ID, sizes=SMALL_BLOCKS, **Z_OPTIONS)
    return rows.select("event_id", "z_score_anomaly")


@query("speed_drop", DROP_SQL)
def speed_drop(spark, sf):
    return rounded(detect_speed_drop(series(spark, sf), row_id=ID).select(*DROP))


@query("speed_drop_in_blocks", DROP_SQL)
def speed_drop_in_blocks(spark, sf):
    rows = detect_speed_drop(series(spark, sf), row_id=ID, sizes=SMALL_BLOCKS)
    return rounded(rows.select(*DROP))


@query("iqr_fence", f"WITH {FENCE_SQL} SELECT event_id, iqr_anomaly FROM fenced")
def iqr_fence(spark, sf):
    return fence.detect_iqr(series(spark, sf)).select("event_id", "iqr_anomaly")


@query("anomaly_score", from_flagged("""
SELECT event_id, z_score_anomaly, iqr_anomaly, speed_drop_anomaly, anomaly_score, severity_level FROM flagged"""))
def anomaly_score(spark, sf):
    return flagged(spark, sf).select(
        "event_id", "z_score_anomaly", "iqr_anomaly", "speed_drop_anomaly", "anomaly_score", "severity_level")


@query("top_critical_corridors", from_flagged("""
SELECT corredor, count(*) AS n_criticos, round(avg(anomaly_score), 4) AS score_medio FROM flagged
WHERE severity_level = 'CRÍTICO' GROUP BY corredor ORDER BY n_criticos DESC, corredor LIMIT 10"""))
def top_critical_corridors(spark, sf):
    return rounded(score.top_critical_corridors(flagged(spark, sf)))


@query("top_anomalous_communes", from_flagged("""
SELECT nombre_comuna, round(avg(anomaly_score), 4) AS score_medio, count(*) AS n_anomalias FROM anomalies
GROUP BY nombre_comuna ORDER BY avg(anomaly_score) DESC, nombre_comuna LIMIT 5"""))
def top_anomalous_communes(spark, sf):
    return rounded(score.top_anomalous_communes(flagged(spark, sf)))


@query("severity_by_hour", from_flagged("""
SELECT hora, count(*) FILTER (severity_level = 'MODERADO') AS "MODERADO", count(*) FILTER (severity_level = 'ALTO') AS "ALTO",
  count(*) FILTER (severity_level = 'CRÍTICO') AS "CRÍTICO" FROM anomalies GROUP BY hora"""))
def severity_by_hour(spark, sf):
    return pivots.severity_by_hour(anomalies(spark, sf))


@query("severe_by_hour_and_day", from_flagged("""
, s AS (SELECT * FROM anomalies WHERE severity_level IN ('CRÍTICO', 'ALTO'))
SELECT CAST(h AS INTEGER) AS hora, """ + ", ".join(
    f"count(event_id) FILTER (dia_num = {i}) AS \"{d}\"" for i, d in enumerate(
        ["Lun", "Mar", "Mié", "Jue", "Vie", "Sáb", "Dom"], 1))
    + " FROM (SELECT unnest(range(24)) AS h) LEFT JOIN s ON hora = h GROUP BY h"))
def severe_by_hour_and_day(spark, sf):
    return pivots.severe_by_hour_and_day(anomalies(spark, sf))


@query("summary_counts", from_flagged("""
SELECT count(*) FILTER (severity_level <> 'NORMAL') AS total_anomalias, count(*) AS total_registros,
  round_even(100.0::DOUBLE * count(*) FILTER (severity_level <> 'NORMAL') / count(*), 2) AS pct_anomalos,
  count(*) FILTER (severity_level = 'NORMAL') AS nivel_0, count(*) FILTER (severity_level = 'MODERADO') AS nivel_1,
  count(*) FILTER (severity_level = 'ALTO') AS nivel_2, count(*) FILTER (severity_level = 'CRÍTICO') AS nivel_3,
  count(*) FILTER (z_score_anomaly) AS n_z_score, count(*) FILTER (iqr_anomaly) AS n_iqr,
  count(*) FILTER (speed_drop_anomaly) AS n_speed_drop, count(*) FILTER (isolation_forest_anomaly) AS n_isolation_forest,
  count(*) FILTER (dbscan_anomaly) AS n_dbscan FROM flagged"""))
def summary_counts(spark, sf):
    return score.summary_counts(flagged(spark, sf))


@query("anomaly_headline", from_flagged("""
SELECT count(*) AS n_anomalias, count(*) FILTER (severity_level = 'CRÍTICO') AS n_criticos,
  round_even(100.0::DOUBLE * count(*) FILTER (severity_level = 'CRÍTICO') / count(*), 1) AS pct_criticos,
  (SELECT corredor FROM anomalies GROUP BY corredor ORDER BY count(*) FILTER (severity_level = 'CRÍTICO') DESC,
    CASE WHEN count(*) FILTER (severity_level = 'CRÍTICO') = 0 THEN avg(anomaly_score) END DESC NULLS LAST, corredor LIMIT 1) AS corredor_critico,
  (SELECT hora FROM anomalies GROUP BY hora ORDER BY avg(anomaly_score) DESC, hora LIMIT 1) AS hora_critica
FROM anomalies"""))
def anomaly_headline(spark, sf):
    return reports.anomaly_headline(anomalies(spark, sf))


@query("detector_breakdown", from_flagged("""
, c AS (SELECT count(*) AS a, count(*) FILTER (z_score_anomaly) z, count(*) FILTER (iqr_anomaly) i,
  count(*) FILTER (speed_drop_anomaly) s, count(*) FILTER (isolation_forest_anomaly) f, count(*) FILTER (dbscan_anomaly) d FROM anomalies),
l AS (SELECT 'z_score' AS detector, z AS n, a FROM c UNION ALL SELECT 'iqr', i, a FROM c UNION ALL SELECT 'speed_drop', s, a FROM c
  UNION ALL SELECT 'isolation_forest', f, a FROM c UNION ALL SELECT 'dbscan', d, a FROM c)
SELECT detector, n, round(100.0 * n / a, 4) AS pct FROM l"""))
def breakdown(spark, sf):
    return rounded(detector_breakdown(anomalies(spark, sf)))


@query("latest_alerts", from_flagged("""
SELECT event_id, fecha_trafico, hora, corredor, nombre_comuna, velocidad_km_h, intensidad, icv, anomaly_score, severity_level
FROM anomalies ORDER BY anomaly_score DESC, event_id LIMIT 50"""))
def latest_alerts(spark, sf):
    rows = anomalies(spark, sf).select(
        "event_id", "fecha_trafico", "hora", "corredor", "nombre_comuna", "velocidad_km_h", "intensidad",
        "icv", "anomaly_score", "severity_level")
    return reports.latest_alerts(rows, 50, "event_id")


@query("alert_timestamps", from_flagged("""
SELECT event_id, date_trunc('day', fecha_trafico) + to_hours(hora) AS timestamp FROM anomalies"""))
def alert_timestamps(spark, sf):
    return reports.with_timestamp(anomalies(spark, sf)).select("event_id", "timestamp")


@query("severity_counts", from_flagged("""
SELECT severity_level, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 4) AS pct FROM anomalies GROUP BY severity_level"""))
def severity_counts(spark, sf):
    return rounded(reports.severity_counts(anomalies(spark, sf)))


@query("anomalous_corridors", from_flagged("""
SELECT corredor, count(*) AS n_anomalias, round(avg(icv), 4) AS icv_medio, round(avg(velocidad_km_h), 4) AS velocidad_media,
  round(avg(intensidad), 4) AS intensidad_media, round(avg(anomaly_score), 4) AS anomaly_score_med,
  count(*) FILTER (severity_level = 'MODERADO') AS "MODERADO", count(*) FILTER (severity_level = 'ALTO') AS "ALTO",
  count(*) FILTER (severity_level = 'CRÍTICO') AS "CRÍTICO"
FROM anomalies GROUP BY corredor ORDER BY n_anomalias DESC, corredor LIMIT 20"""))
def anomalous_corridors(spark, sf):
    return rounded(reports.anomalous_corridors(anomalies(spark, sf)))


@query("anomalous_communes", from_flagged("""
SELECT nombre_comuna, count(*) AS n_anomalias, round(avg(icv), 4) AS icv_medio, round(avg(velocidad_km_h), 4) AS velocidad_media
FROM anomalies GROUP BY nombre_comuna"""))
def anomalous_communes(spark, sf):
    return rounded(reports.anomalous_communes(anomalies(spark, sf)))


@query("anomalous_slots", from_flagged("""
SELECT franja_horaria, count(corredor) AS n_anomalias, round(avg(icv), 4) AS icv_medio FROM anomalies GROUP BY franja_horaria"""))
def anomalous_slots(spark, sf):
    return rounded(reports.anomalous_slots(anomalies(spark, sf)))


FOREST_ROWS_SQL = f"WITH {SERIES_SQL}, {FOREST_SQL} SELECT event_id, isolation_forest_anomaly, round(isolation_score, 4) AS isolation_score FROM forest"


@query("isolation_forest", FOREST_ROWS_SQL)
def isolation_forest(spark, sf):
    rows = forest.detect_forest(series(spark, sf), row_id=ID)
    return rounded(rows.select("event_id", "isolation_forest_anomaly", "isolation_score"), DIGITS)


@query("isolation_forest_salted", FOREST_ROWS_SQL)
def isolation_forest_salted(spark, sf):
    """The way for more models than should be broadcast."""
    rows = forest.detect_forest(series(spark, sf), row_id=ID, broadcast_nodes=0, salt_rows=500)
    return rounded(rows.select("event_id", "isolation_forest_anomaly", "isolation_score"), DIGITS)


def _located(spark, sf):
    """Two axes of the embeddings as places; the label as the hour."""
    return table(spark, sf, "embeddings").select(
        "vec_id", F.col("embedding")[0].cast("double").alias("simm_lat"),
        F.col("embedding")[1].cast("double").alias("simm_lon"), F.col("label").alias("hora"))


NOISE_SQL = """WITH p AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS a, CAST(embedding[2] AS DOUBLE) AS b,
  CAST(label AS DOUBLE) AS c FROM embeddings),
m AS (SELECT avg(a) ma, stddev_pop(a) sa, avg(b) mb, stddev_pop(b) sb, avg(c) mc, stddev_pop(c) sc FROM p),
z AS (SELECT vec_id, (a - ma) / sa AS x, (b - mb) / sb AS y, (c - mc) / sc AS w FROM p, m),
near AS (SELECT l.vec_id AS i, r.vec_id AS j FROM z l JOIN z r
  ON (l.x - r.x) ** 2 + (l.y - r.y) ** 2 + (l.w - r.w) ** 2 <= 0.25),
cores AS (SELECT i FROM near GROUP BY i HAVING count(*) >= 5)
SELECT vec_id, vec_id NOT IN (SELECT i FROM near WHERE j IN (SELECT i FROM cores)) AS dbscan_anomaly FROM z"""


@query("density_noise", NOISE_SQL)
def density_noise(spark, sf):
    return noise.detect_noise(_located(spark, sf)).select("vec_id", "dbscan_anomaly")


@query("density_noise_split_cells", NOISE_SQL)
def density_noise_split_cells(spark, sf):
    """With the points of a cell spread over several tasks."""
    return noise.detect_noise(_located(spark, sf), cell_points=2).select("vec_id", "dbscan_anomaly")


def _spread_key(key: Column) -> Column:
    """A rank both engines can compute: odd steps through 63 bits, then the sign bit by the last bit."""
    mixed = key * F.lit(40503) % F.lit(65521) * F.lit(65521) + key % F.lit(65521)
    return mixed * F.lit(2147483647) + F.when(key % 2 == 0, F.lit(-(1 << 63))).otherwise(F.lit(0))


def _spread_sql(key: str) -> str:
    return (f"((CAST({key} AS HUGEINT) * 40503 % 65521 * 65521 + ({key}) % 65521) * 2147483647 "
            f"+ CASE WHEN ({key}) % 2 = 0 THEN 9223372036854775808::HUGEINT ELSE 0 END)")


@query("stratified_sample", f"""WITH {MASTER_SQL},
r AS (SELECT l_orderkey, l_linenumber, l_partkey, nombre_comuna, count(*) OVER (PARTITION BY nombre_comuna) AS n,
  row_number() OVER (PARTITION BY nombre_comuna ORDER BY {_spread_sql("l_orderkey * 8 + l_linenumber")}, l_orderkey, l_linenumber, l_partkey) AS place
  FROM master)
SELECT l_orderkey, l_linenumber, l_partkey, nombre_comuna FROM r
WHERE place <= greatest(10, CAST(floor(5000 * n / (SELECT count(*) FROM master)) AS BIGINT))""")
def stratified_sample(spark, sf):
    rows = master(spark, sf).select("l_orderkey", "l_linenumber", "l_partkey", "nombre_comuna")
    key = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    return sampling.sample_stratified(rows, 5000, rank=_spread_key(key))


@query("bounded_sample", f"""SELECT event_id, user_id FROM events ORDER BY {_spread_sql("event_id")}, event_id LIMIT 3000""")
def bounded_sample(spark, sf):
    rows = table(spark, sf, "events").select("event_id", "user_id")
    return sampling.sample_rows(rows, 3000, rank=_spread_key(F.col("event_id")))


@query("sampled_rows", f"""SELECT event_id FROM events ORDER BY {_spread_sql("event_id")}, event_id LIMIT 777""")
def sampled_rows(spark, sf):
    """The sample is the rows with the smallest ranks, whatever the way they are found."""
    events = table(spark, sf, "events")
    return sampling.sample_rows(events, 777, row_id=["event_id"], rank=_spread_key(F.col("event_id"))).select("event_id")


@query("sampled_rows_in_buckets", f"""SELECT event_id FROM events ORDER BY {_spread_sql("event_id")}, event_id LIMIT 777""")
def sampled_rows_in_buckets(spark, sf):
    events = table(spark, sf, "events")
    return sampling.sample_rows(
        events, 777, row_id=["event_id"], rank=_spread_key(F.col("event_id")), bucket_rows=100).select("event_id")


RUN_SQL = f"""WITH {FENCE_SQL.replace("> 1.5 THEN", f"> {Z_THRESHOLD} THEN")}, {FOREST_SQL},
marked AS (SELECT fenced.*, isolation_forest_anomaly, isolation_score, false AS dbscan_anomaly FROM fenced JOIN forest USING (event_id)),
{SCORE_SQL}
SELECT event_id, {", ".join(f"round({c}, 4) AS {c}" if c in ("speed_drop_pct", "isolation_score") else c for c in ANOMALY_COLUMNS)} FROM flagged"""


@query("detector_run", RUN_SQL)
def detector_run(spark, sf):
    """All detectors, score and severity without a sample."""
    config = {**CONFIG, "paths": {}}
    rows = AnomalyDetector(config, row_id=ID).detect(series(spark, sf))
    return rounded(rows.select("event_id", *ANOMALY_COLUMNS))


@query("both_series_detectors", f"""WITH {ALONG_SQL} SELECT corredor, count(*) AS n, count(*) FILTER (z_score_anomaly) AS n_z,
  count(*) FILTER (speed_drop_anomaly) AS n_caidas FROM along GROUP BY corredor""")
def both_series_detectors(spark, sf):
    rows = detect_along_series(series(spark, sf), row_id=ID, **Z_OPTIONS)
    return rows.groupBy("corredor").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("z_score_anomaly").alias("n_z"),
        F.count_if("speed_drop_anomaly").alias("n_caidas"))
