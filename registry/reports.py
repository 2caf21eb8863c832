"""Index, rankings, statistics and reports on the measurements."""

from __future__ import annotations

from pyspark.sql import functions as F

from registry.tables import (
    CONFIG, MEASUREMENTS_SQL, from_hotspots, from_master, master, measurements, once, query, rounded, table,
)
from viario.operators import features, index, pivots, quantiles, ranking, sketches, stats
from viario.plans import reports

MEANS = """round(avg(velocidad_km_h), 4) AS velocidad_media, round(avg(intensidad), 4) AS intensidad_media,
  round(avg(icv), 4) AS icv_medio"""
KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "corredor"]


@query("time_features", f"""WITH {MEASUREMENTS_SQL}
SELECT l_orderkey, l_linenumber, l_partkey, corredor, hora, dia_num, mes_num, es_fin_semana,
  franja_horaria, es_hora_pico FROM measured""")
def time_features(spark, sf):
    return measurements(spark, sf).select(
        *KEYS, "hora", "dia_num", "mes_num", "es_fin_semana", "franja_horaria", "es_hora_pico")


@query("criticality_index", from_master("""
SELECT l_orderkey, l_linenumber, l_partkey, corredor, icv FROM master"""))
def criticality_index(spark, sf):
    return index.add_icv(measurements(spark, sf), CONFIG).select(*KEYS, "icv")


@query("criticality_index_documented", f"""WITH {MEASUREMENTS_SQL},
peak AS (SELECT * FROM measured WHERE NOT es_fin_semana AND hora IN (6,7,8,9,17,18,19,20)),
ends AS (SELECT min(velocidad_km_h) v0, max(velocidad_km_h) v1, min(intensidad) i0, max(intensidad) i1,
  min(poblacion_2019) p0, max(poblacion_2019) p1, median(poblacion_2019) pm FROM peak)
SELECT l_orderkey, l_linenumber, l_partkey, corredor, round_even(100.0::DOUBLE * (
    0.40::DOUBLE * (1 - (velocidad_km_h - v0) / (v1 - v0)) + 0.40::DOUBLE * ((intensidad - i0) / (i1 - i0))
    + 0.20::DOUBLE * ((coalesce(poblacion_2019, pm) - p0) / (p1 - p0))), 2) AS icv FROM peak, ends""")
def criticality_index_documented(spark, sf):
    return index.documented_icv(measurements(spark, sf)).select(*KEYS, "icv")


@query("min_max_scaling", f"""WITH {MEASUREMENTS_SQL},
e AS (SELECT min(intensidad) lo, max(intensidad) hi FROM measured)
SELECT l_orderkey, l_linenumber, l_partkey, corredor, round((intensidad - lo) / (hi - lo), 6) AS escalada
FROM measured, e""")
def min_max_scaling(spark, sf):
    df = measurements(spark, sf)
    return df.select(*KEYS, F.round(stats.scaled(df, "intensidad"), 6).alias("escalada"))


@query("median_imputation", f"""WITH {MEASUREMENTS_SQL},
m AS (SELECT median(ocupacion) mid FROM measured)
SELECT franja_horaria, count(*) AS n, round(sum(coalesce(ocupacion, mid)), 4) AS total
FROM measured, m GROUP BY franja_horaria""")
def median_imputation(spark, sf):
    df = measurements(spark, sf)
    filled = df.withColumn("v", F.coalesce("ocupacion", quantiles.median(df, "ocupacion")))
    return rounded(filled.groupBy("franja_horaria").agg(
        F.count(F.lit(1)).alias("n"), F.sum("v").alias("total")))


@query("standardised", f"""WITH {MEASUREMENTS_SQL},
m AS (SELECT avg(velocidad_km_h) a, stddev_pop(velocidad_km_h) s FROM measured)
SELECT l_orderkey, l_linenumber, l_partkey, corredor, round((velocidad_km_h - a) / s, 6) AS z FROM measured, m""")
def standardised(spark, sf):
    df = measurements(spark, sf)
    return df.select(*KEYS, F.round(stats.standardised(df, ["velocidad_km_h"])["velocidad_km_h"], 6).alias("z"))


@query("physical_range_filter", f"""WITH {MEASUREMENTS_SQL}
SELECT corredor, count(*) AS n FROM measured WHERE velocidad_km_h BETWEEN 1 AND 100 AND intensidad >= 0
  AND hora BETWEEN 0 AND 23 AND ocupacion IS NOT NULL GROUP BY corredor""")
def physical_range_filter(spark, sf):
    df = features.physical_range(measurements(spark, sf).dropna(subset=["ocupacion"]))
    return df.groupBy("corredor").agg(F.count(F.lit(1)).alias("n"))


@query("exact_duplicates", """WITH d AS (SELECT DISTINCT l_returnflag, l_linestatus, l_shipdate, l_discount,
  l_tax, l_quantity FROM lineitem)
SELECT l_returnflag, l_linestatus, count(*) AS n FROM d GROUP BY ALL""")
def exact_duplicates(spark, sf):
    rows = table(spark, sf, "lineitem").select(
        "l_returnflag", "l_linestatus", "l_shipdate", "l_discount", "l_tax", "l_quantity")
    return rows.dropDuplicates().groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"))


@query("combined_filters", from_master("""
SELECT corredor, count(*) AS n, round(avg(icv), 4) AS icv_medio FROM master
WHERE nombre_comuna IN ('NATION_1', 'NATION_2', 'NATION_3', 'NATION_10', 'NATION_15')
  AND franja_horaria = 'tarde' AND dia_num = 3 GROUP BY corredor"""))
def combined_filters(spark, sf):
    communes = ["NATION_1", "NATION_2", "NATION_3", "NATION_10", "NATION_15"]
    rows = features.apply_filters(master(spark, sf), communes, None, "tarde", "Miercoles")
    return rounded(rows.groupBy("corredor").agg(
        F.count(F.lit(1)).alias("n"), F.avg("icv").alias("icv_medio")))


@query("filter_options", from_master("""
SELECT DISTINCT trim(nombre_comuna) AS nombre_comuna, trim(corredor) AS corredor FROM master"""))
def filter_options(spark, sf):
    return features.filter_options(master(spark, sf))


@query("corridor_options", from_master("""
SELECT DISTINCT corredor FROM master WHERE nombre_comuna = 'NATION_15'"""))
def corridor_options(spark, sf):
    return features.corridor_options(features.filter_options(master(spark, sf)), "NATION_15")


@query("flow_classes", from_master("""
, q AS (SELECT quantile_cont(velocidad_km_h, 0.3) v30, quantile_cont(intensidad, 0.7) i70 FROM master),
c AS (SELECT CASE WHEN velocidad_km_h <= v30 AND intensidad >= i70 THEN 'Crítico (Baja vel + Alto flujo)'
  WHEN intensidad >= i70 THEN 'Alto flujo' WHEN velocidad_km_h <= v30 THEN 'Baja velocidad'
  ELSE 'Normal' END AS criticidad, icv FROM master, q)
SELECT criticidad, count(*) AS n, round(avg(icv), 4) AS icv_medio FROM c GROUP BY criticidad"""))
def flow_classes(spark, sf):
    return rounded(features.flow_class(master(spark, sf)).groupBy("criticidad").agg(
        F.count(F.lit(1)).alias("n"), F.avg("icv").alias("icv_medio")))


@query("first_rows_by_class", from_master("""
, q AS (SELECT quantile_cont(velocidad_km_h, 0.3) v30, quantile_cont(intensidad, 0.7) i70 FROM master),
c AS (SELECT l_orderkey, l_linenumber, l_partkey, corredor, CASE WHEN velocidad_km_h <= v30 AND intensidad >= i70
  THEN 'Crítico (Baja vel + Alto flujo)' WHEN intensidad >= i70 THEN 'Alto flujo' WHEN velocidad_km_h <= v30
  THEN 'Baja velocidad' ELSE 'Normal' END AS criticidad, intensidad FROM master, q)
SELECT * FROM c ORDER BY criticidad, l_orderkey, l_linenumber, l_partkey, corredor, intensidad LIMIT 50"""))
def first_rows_by_class(spark, sf):
    rows = features.flow_class(master(spark, sf)).select(*KEYS, "criticidad", "intensidad")
    return ranking.first_by_class(rows, 50, *KEYS, "intensidad")


@query("flow_statistics", from_hotspots(f"""
SELECT {MEANS}, (SELECT count(*) FROM hotspots) AS n_criticos,
  round((SELECT 100.0 * count(*) FROM hotspots) / count(*), 4) AS pct_criticos FROM master"""))
def flow_statistics(spark, sf):
    return rounded(reports.flow_stats(master(spark, sf)))


@query("top_corridors", from_master("""
, g AS (SELECT corredor, avg(icv) AS m, max(icv) AS icv_maximo, count(icv) AS n_registros FROM master
  WHERE NOT es_fin_semana GROUP BY corredor)
SELECT CAST(row_number() OVER (ORDER BY m DESC, corredor) AS INTEGER) AS rank, corredor,
  round(m, 4) AS icv_medio, round(icv_maximo, 4) AS icv_maximo, n_registros
FROM g ORDER BY m DESC, corredor LIMIT 10"""))
def top_corridors(spark, sf):
    return rounded(ranking.rank_corridors(master(spark, sf), CONFIG))


@query("top_corridors_by_load", from_master("""
, l AS (SELECT coalesce(nullif(upper(trim(regexp_replace(regexp_replace(lower(strip_accents(corredor)),
    '[^a-z0-9\\s]', '', 'g'), '^[0-9\\s]+', ''))), ''), 'DESCONOCIDO') AS corredor,
    intensidad, velocidad_km_h FROM master WHERE intensidad >= 0 AND velocidad_km_h > 0 AND velocidad_km_h < 120),
g AS (SELECT corredor, avg(intensidad / 2500) AS ivc, avg(velocidad_km_h) AS v, avg(intensidad) AS i,
  avg(greatest(0, least(1, 1 - velocidad_km_h / 60))) AS s, count(*) AS n_registros FROM l GROUP BY corredor)
SELECT CAST(row_number() OVER (ORDER BY ivc DESC, corredor) AS INTEGER) AS rank, corredor,
  round(ivc, 4) AS ivc_medio, round(v, 4) AS velocidad_media, round(i, 4) AS intensidad_media,
  round(s, 4) AS icv_simple_medio, n_registros FROM g ORDER BY ivc DESC, corredor LIMIT 15"""))
def top_corridors_by_load(spark, sf):
    return rounded(ranking.rank_corridors_by_load(master(spark, sf), CONFIG))


@query("top_communes", from_master("""
, g AS (SELECT nombre_comuna, avg(icv) AS m FROM master WHERE es_hora_pico GROUP BY nombre_comuna)
SELECT CAST(row_number() OVER (ORDER BY m DESC, nombre_comuna) AS INTEGER) AS rank, nombre_comuna,
  round(m, 4) AS icv_medio FROM g ORDER BY m DESC, nombre_comuna LIMIT 5"""))
def top_communes(spark, sf):
    return rounded(ranking.rank_communes(master(spark, sf), CONFIG))


@query("hotspots", from_hotspots("""
SELECT l_orderkey, l_linenumber, l_partkey, corredor, velocidad_km_h, intensidad, icv FROM hotspots"""))
def hotspots(spark, sf):
    return ranking.hotspots(master(spark, sf), CONFIG).select(
        *KEYS, "velocidad_km_h", "intensidad", "icv")


@query("quantiles_by_group", from_master("""
SELECT franja_horaria, round(quantile_cont(intensidad, 0.2), 4) AS p20, round(median(intensidad), 4) AS p50,
  round(quantile_cont(intensidad, 0.8), 4) AS p80, count(intensidad) AS n_values FROM master GROUP BY franja_horaria"""))
def quantiles_by_group(spark, sf):
    return rounded(quantiles.quantiles(
        master(spark, sf), "intensidad", {"p20": 0.2, "p50": 0.5, "p80": 0.8}, ["franja_horaria"]))


@query("quantiles_by_group_large", from_master("""
SELECT nombre_comuna, round(quantile_cont(intensidad, 0.2), 4) AS p20, round(median(intensidad), 4) AS p50,
  round(quantile_cont(intensidad, 0.8), 4) AS p80, count(intensidad) AS n_values FROM master GROUP BY nombre_comuna"""))
def quantiles_by_group_large(spark, sf):
    """The way for groups with more distinct values than a buffer should hold."""
    return rounded(quantiles.quantiles(
        master(spark, sf), "intensidad", {"p20": 0.2, "p50": 0.5, "p80": 0.8}, ["nombre_comuna"],
        distinct_values=0))


@query("quantiles_whole_large", from_master("""
SELECT round(quantile_cont(intensidad, 0.67), 4) AS p67, round(median(intensidad), 4) AS p50,
  count(intensidad) AS n_values FROM master"""))
def quantiles_whole_large(spark, sf):
    return rounded(quantiles.quantiles(
        master(spark, sf), "intensidad", {"p67": 0.67, "p50": 0.5}, distinct_values=0))


@query("describe_measures", from_master("""
, long AS (SELECT 'icv' AS variable, icv AS x FROM master UNION ALL SELECT 'velocidad_km_h', velocidad_km_h FROM master
  UNION ALL SELECT 'ocupacion', ocupacion FROM master)
SELECT variable, count(x) AS count, round(avg(x), 4) AS mean, round(stddev_samp(x), 4) AS std, round(min(x), 4) AS min,
  round(quantile_cont(x, 0.25), 4) AS p25, round(median(x), 4) AS p50, round(quantile_cont(x, 0.75), 4) AS p75,
  round(max(x), 4) AS max FROM long GROUP BY variable"""))
def describe_measures(spark, sf):
    return rounded(stats.describe(master(spark, sf), ["icv", "velocidad_km_h", "ocupacion"]))


@query("correlations", from_master("""
, t AS (SELECT corr(velocidad_km_h, intensidad) vi, corr(velocidad_km_h, icv) vc, corr(intensidad, icv) ic FROM master)
SELECT 'velocidad_km_h' AS variable, 1.0::DOUBLE AS velocidad_km_h, round(vi, 4) AS intensidad, round(vc, 4) AS icv FROM t
UNION ALL SELECT 'intensidad', round(vi, 4), 1.0, round(ic, 4) FROM t
UNION ALL SELECT 'icv', round(vc, 4), round(ic, 4), 1.0 FROM t"""))
def correlations(spark, sf):
    return rounded(stats.correlations(master(spark, sf), ["velocidad_km_h", "intensidad", "icv"]))


@query("histogram", from_master("""
, e AS (SELECT min(icv) lo, max(icv) hi FROM master),
c AS (SELECT CAST(least(floor(60 * (icv - lo) / (hi - lo)), 59) AS INTEGER) AS bin, count(*) AS n FROM master, e GROUP BY 1)
SELECT CAST(b.bin AS INTEGER) AS bin, round(lo + (hi - lo) * b.bin / 60, 4) AS from_value,
  round(lo + (hi - lo) * (b.bin + 1) / 60, 4) AS to_value, coalesce(n, 0) AS n
FROM (SELECT unnest(range(60)) AS bin) b CROSS JOIN e LEFT JOIN c ON c.bin = b.bin"""))
def histogram(spark, sf):
    return rounded(stats.histogram(master(spark, sf), "icv", 60))


@query("box_statistics", from_master("""
, q AS (SELECT franja_horaria, quantile_cont(icv, 0.25) p25, median(icv) p50, quantile_cont(icv, 0.75) p75,
  count(icv) AS n_values FROM master GROUP BY franja_horaria),
f AS (SELECT *, p25 - 1.5 * (p75 - p25) AS lo, p75 + 1.5 * (p75 - p25) AS hi FROM q)
SELECT f.franja_horaria, round(p25, 4) AS p25, round(p50, 4) AS p50, round(p75, 4) AS p75, n_values,
  round(lo, 4) AS low_fence, round(hi, 4) AS high_fence,
  round(min(icv) FILTER (icv BETWEEN lo AND hi), 4) AS low_whisker,
  round(max(icv) FILTER (icv BETWEEN lo AND hi), 4) AS high_whisker,
  count(*) FILTER (NOT icv BETWEEN lo AND hi) AS n_outliers
FROM f JOIN master USING (franja_horaria) GROUP BY ALL"""))
def box_statistics(spark, sf):
    return rounded(stats.box_stats(master(spark, sf), "icv", ["franja_horaria"]))


@query("mode_by_group", from_master("""
, c AS (SELECT corredor, dia_num, count(*) AS n FROM master GROUP BY ALL)
SELECT corredor, min(dia_num) AS dia FROM c JOIN (SELECT corredor, max(n) AS n FROM c GROUP BY corredor)
USING (corredor, n) GROUP BY corredor"""))
def mode_by_group(spark, sf):
    return stats.mode_by_group(master(spark, sf), "dia_num", ["corredor"], "dia")


@query("first_value_by_group", from_master("""
SELECT corredor, arg_min(ocupacion, (fecha_trafico, hora, l_orderkey, l_linenumber, l_partkey, intensidad)) AS primera
FROM master WHERE ocupacion IS NOT NULL GROUP BY corredor"""))
def first_value_by_group(spark, sf):
    order = ["fecha_trafico", "hora", "l_orderkey", "l_linenumber", "l_partkey", "intensidad"]
    return reports.first_value(master(spark, sf), "corredor", "ocupacion", order, "primera")


@query("value_counts", from_master("""
SELECT franja_horaria, count(*) AS n FROM master GROUP BY franja_horaria"""))
def value_counts(spark, sf):
    return stats.value_counts(master(spark, sf), "franja_horaria")


@query("extreme_groups", from_master("""
, h AS (SELECT hora, avg(icv) AS m, avg(velocidad_km_h) AS v FROM master GROUP BY hora)
SELECT (SELECT hora FROM h ORDER BY m DESC, hora LIMIT 1) AS peor, (SELECT hora FROM h ORDER BY v, hora LIMIT 1) AS lenta"""))
def extreme_groups(spark, sf):
    df = master(spark, sf)
    worst = ranking.extreme_group(df, "hora", "icv").select(F.col("hora").alias("peor"))
    slow = ranking.extreme_group(df, "hora", "velocidad_km_h", largest=False)
    return worst.withColumn("lenta", slow.select("hora").scalar())


SLOTS = ["madrugada", "manana", "mediodia", "tarde", "noche"]


@query("index_by_commune_and_slot", from_master(
    "SELECT nombre_comuna, " + ", ".join(
        f"round(coalesce(avg(icv) FILTER (franja_horaria = '{s}'), 0), 4) AS {s}" for s in SLOTS)
    + " FROM master GROUP BY nombre_comuna"))
def index_by_commune_and_slot(spark, sf):
    return rounded(pivots.commune_by_slot(master(spark, sf)))


HOURS = ", ".join(
    f"round(coalesce(avg(intensidad / velocidad_km_h) FILTER (hora = {h}), 0), 4) AS h{h:02d}" for h in range(24))
TOTAL = " + ".join(
    f"coalesce(avg(intensidad / velocidad_km_h) FILTER (hora = {h}), 0)" for h in range(24))


@query("load_by_corridor_and_hour", from_master(f"""
SELECT corredor, {HOURS} FROM master WHERE velocidad_km_h > 0 GROUP BY corredor
ORDER BY {TOTAL} DESC, corredor LIMIT 20"""))
def load_by_corridor_and_hour(spark, sf):
    return rounded(pivots.load_by_corridor_and_hour(master(spark, sf)))


DAYS = ["Lun", "Mar", "Mié", "Jue", "Vie", "Sáb", "Dom"]


@query("flow_by_hour_and_day", from_master("SELECT hora, " + ", ".join(
    f"round(coalesce(avg(CAST(round(intensidad * 100) AS BIGINT)) FILTER (dia_num = {i}), 0), 4) AS \"{d}\""
    for i, d in enumerate(DAYS, 1)) + " FROM master GROUP BY hora"))
def flow_by_hour_and_day(spark, sf):
    """In whole hundredths, whose sums are exact: means of few rows often end in a 5."""
    whole = F.round(F.col("intensidad") * 100).cast("bigint")
    return rounded(pivots.flow_by_hour_and_day(master(spark, sf).withColumn("intensidad", whole)))


@query("overview", from_master("""
SELECT count(*) AS n_total, min(fecha_trafico) AS fecha_min, max(fecha_trafico) AS fecha_max,
  count(DISTINCT corredor) AS n_corredores, count(DISTINCT nombre_comuna) AS n_comunas,
  count(*) FILTER (NOT es_fin_semana) AS n_semana, count(*) FILTER (es_fin_semana) AS n_fin_semana,
  count(*) FILTER (es_hora_pico) AS n_hora_pico, round(100.0 * count(*) FILTER (NOT es_fin_semana) / count(*), 4) AS pct_semana,
  round(100.0 * count(*) FILTER (es_hora_pico) / count(*), 4) AS pct_hora_pico FROM master"""))
def overview(spark, sf):
    return rounded(reports.overview(master(spark, sf)))


@query("overview_measures", from_master("""
, long AS (SELECT 'icv' AS variable, icv AS x FROM master UNION ALL SELECT 'velocidad_km_h', velocidad_km_h FROM master)
SELECT variable, count(x) AS count, round(avg(x), 4) AS mean, round(stddev_samp(x), 4) AS std, round(min(x), 4) AS min,
  round(quantile_cont(x, 0.25), 4) AS p25, round(median(x), 4) AS p50, round(quantile_cont(x, 0.75), 4) AS p75,
  round(max(x), 4) AS max FROM long GROUP BY variable"""))
def overview_measures(spark, sf):
    return rounded(reports.overview_measures(master(spark, sf)))


@query("speed_by_slot", from_master("""
SELECT franja_horaria, round(avg(velocidad_km_h), 4) AS velocidad_media, round(stddev_samp(velocidad_km_h), 4) AS velocidad_std,
  count(velocidad_km_h) AS n_registros, round(avg(icv), 4) AS icv_medio FROM master GROUP BY franja_horaria"""))
def speed_by_slot(spark, sf):
    return rounded(reports.speed_by_slot(master(spark, sf)))


@query("index_by_day", from_master("""
SELECT dia_num, CASE dia_num WHEN 1 THEN 'Lunes' WHEN 2 THEN 'Martes' WHEN 3 THEN 'Miercoles' WHEN 4 THEN 'Jueves'
  WHEN 5 THEN 'Viernes' WHEN 6 THEN 'Sabado' WHEN 7 THEN 'Domingo' END AS dia, round(avg(icv), 4) AS icv_medio,
  round(stddev_samp(icv), 4) AS icv_std, round(avg(velocidad_km_h), 4) AS velocidad_media, count(icv) AS n_registros
FROM master GROUP BY dia_num"""))
def index_by_day(spark, sf):
    return rounded(reports.icv_by_day(master(spark, sf)))


@query("worst_hours", from_master(f"""
SELECT hora, count(icv) AS n_registros, {MEANS} FROM master GROUP BY hora ORDER BY avg(icv) DESC, hora LIMIT 5"""))
def worst_hours(spark, sf):
    return rounded(reports.worst_hours(master(spark, sf)))


PROFILE = f"""corredor, {MEANS}, round(max(icv), 4) AS icv_maximo, round(avg(ocupacion), 4) AS ocupacion_media,
  count(icv) AS n_registros, round(avg(es_hora_pico::INT) * 100, 4) AS pct_hora_pico"""


@query("critical_corridors", from_master(f"""
SELECT {PROFILE}, CAST(row_number() OVER (ORDER BY avg(icv) DESC, corredor) AS INTEGER) AS rank
FROM master WHERE NOT es_fin_semana GROUP BY corredor ORDER BY avg(icv) DESC, corredor LIMIT 10"""))
def critical_corridors(spark, sf):
    return rounded(reports.critical_corridors(master(spark, sf)))


@query("commune_pressure", from_master(f"""
SELECT nombre_comuna, {MEANS}, round(max(icv), 4) AS icv_maximo, count(icv) AS n_registros,
  max(poblacion_2019) AS poblacion_2019, round(CASE WHEN max(poblacion_2019) > 0
    THEN avg(intensidad) / max(poblacion_2019) * 1000 END, 4) AS vehiculos_por_1000hab,
  CAST(row_number() OVER (ORDER BY avg(icv) DESC, nombre_comuna) AS INTEGER) AS rank
FROM master WHERE es_hora_pico GROUP BY nombre_comuna"""))
def commune_pressure(spark, sf):
    return rounded(reports.commune_pressure(master(spark, sf)))


@query("hotspot_places", from_hotspots(f"""
SELECT corredor, nombre_comuna, count(icv) AS n_eventos, {MEANS}, round(avg(es_hora_pico::INT) * 100, 4) AS hora_pico_pct,
  CAST(row_number() OVER (ORDER BY count(icv) DESC, corredor, nombre_comuna) AS INTEGER) AS rank
FROM hotspots GROUP BY corredor, nombre_comuna ORDER BY n_eventos DESC, corredor, nombre_comuna LIMIT 20"""))
def hotspot_places(spark, sf):
    return rounded(reports.hotspot_places(master(spark, sf), CONFIG))


@query("hotspot_slots", from_hotspots(f"""
SELECT franja_horaria, count(icv) AS n_eventos, {MEANS},
  round(count(icv) * 100.0 / sum(count(icv)) OVER (), 4) AS pct_del_total FROM hotspots GROUP BY franja_horaria"""))
def hotspot_slots(spark, sf):
    return rounded(reports.hotspot_slots(master(spark, sf), CONFIG))


INTERVENTION_SQL = f"""
, wd AS (SELECT * FROM master WHERE NOT es_fin_semana),
g AS (SELECT corredor, avg(icv) AS i, avg(velocidad_km_h) AS v, avg(intensidad) AS f, avg(poblacion_2019) AS p,
  arg_min(nombre_comuna, nombre_comuna) AS nombre_comuna FROM wd GROUP BY corredor),
q AS (SELECT (SELECT quantile_cont(intensidad, 0.8) FROM wd) AS p80, (SELECT quantile_cont(p, 0.67) FROM g) AS p67),
k AS (SELECT g.*, i >= 50 AND v < 25 AS a, f >= p80 AND i >= 45 AS b,
  corredor IN (SELECT corredor FROM hotspots) AND coalesce(p >= p67, false) AS c FROM g, q),
kinds AS (SELECT *, CASE WHEN a::INT + b::INT + c::INT >= 2 THEN 'Multiples Intervenciones' WHEN a THEN 'Gestion Semafórica'
  WHEN b THEN 'Rutas Alternas' WHEN c THEN 'Transporte Sostenible' ELSE 'Sin clasificar' END AS intervencion FROM k)"""


@query("interventions", from_hotspots(INTERVENTION_SQL + """
SELECT corredor, nombre_comuna, round(i, 4) AS icv_medio, round(p, 4) AS poblacion_2019, intervencion FROM kinds"""))
def interventions(spark, sf):
    return rounded(reports.interventions(master(spark, sf), CONFIG).select(
        "corredor", "nombre_comuna", "icv_medio", "poblacion_2019", "intervencion"))


@query("intervention_counts", from_hotspots(INTERVENTION_SQL + """
SELECT intervencion, count(*) AS n_corredores, round(100.0 * count(*) / sum(count(*)) OVER (), 4) AS pct
FROM kinds GROUP BY intervencion"""))
def intervention_counts(spark, sf):
    return rounded(reports.intervention_counts(master(spark, sf), CONFIG))


@query("index_by_hour", from_master("SELECT hora, round(avg(icv), 4) AS icv_medio FROM master GROUP BY hora"))
def index_by_hour(spark, sf):
    return rounded(reports.icv_by_hour(master(spark, sf)))


@query("commune_map", from_master("""
SELECT lpad(codigo_comuna, 2, '0') AS codigo_geo, nombre_comuna, round(avg(icv), 4) AS icv_medio, count(*) AS registros,
  round(avg(velocidad_km_h), 4) AS velocidad_media, round(avg(intensidad), 4) AS intensidad_media,
  count(DISTINCT corredor) AS corredores_activos, lpad(codigo_comuna, 2, '0') || ' - ' || nombre_comuna AS comuna_mapa
FROM master GROUP BY codigo_comuna, nombre_comuna"""))
def commune_map(spark, sf):
    return rounded(reports.commune_map(master(spark, sf)))


@query("headline", from_hotspots("""
SELECT round_even(avg(icv), 1) AS icv_promedio,
  (SELECT corredor FROM master WHERE NOT es_fin_semana GROUP BY corredor ORDER BY avg(icv) DESC, corredor LIMIT 1) AS corredor_critico,
  (SELECT hora FROM master GROUP BY hora ORDER BY avg(icv) DESC, hora LIMIT 1) AS hora_critica,
  (SELECT count(*) FROM hotspots) AS n_hotspots FROM master"""))
def headline(spark, sf):
    return reports.headline(master(spark, sf), CONFIG)


def _view(name: str):
    def run(spark, sf):
        views = reports.filtered_views(
            master(spark, sf), CONFIG, ["NATION_15", "NATION_20", "NATION_8"], None, "Todas", "Sabado")
        return rounded(views[name])
    return run


FILTER = "nombre_comuna IN ('NATION_15', 'NATION_20', 'NATION_8') AND dia_num = 6"
query("filtered_view_corridors", from_master(f"""
SELECT CAST(row_number() OVER (ORDER BY avg(icv) DESC, corredor) AS INTEGER) AS rank, corredor,
  round(avg(icv), 4) AS icv_medio, round(max(icv), 4) AS icv_maximo, count(icv) AS n_registros
FROM master WHERE {FILTER} GROUP BY corredor ORDER BY avg(icv) DESC, corredor LIMIT 10"""))(_view("corredores"))
query("filtered_view_hotspots", from_master(f"""
, f AS (SELECT * FROM master WHERE {FILTER}), q AS (SELECT quantile_cont(velocidad_km_h, 0.3) v30,
  quantile_cont(intensidad, 0.7) i70 FROM f)
SELECT l_orderkey, l_linenumber, l_partkey, corredor, round(icv, 4) AS icv FROM f, q
WHERE velocidad_km_h <= v30 AND intensidad >= i70"""))(
    lambda spark, sf: _view("hotspots")(spark, sf).select(*KEYS, "icv"))


query("filtered_view_communes", from_master(f"""
SELECT CAST(row_number() OVER (ORDER BY avg(icv) DESC, nombre_comuna) AS INTEGER) AS rank, nombre_comuna,
  round(avg(icv), 4) AS icv_medio FROM master WHERE {FILTER} AND es_hora_pico GROUP BY nombre_comuna"""))(
    lambda spark, sf: _view("comunas")(spark, sf).select("rank", "nombre_comuna", "icv_medio"))


query("filtered_view_load", from_master(f"""
, l AS (SELECT coalesce(nullif(upper(trim(regexp_replace(regexp_replace(lower(strip_accents(corredor)),
    '[^a-z0-9\\s]', '', 'g'), '^[0-9\\s]+', ''))), ''), 'DESCONOCIDO') AS corredor,
    intensidad, velocidad_km_h FROM master WHERE {FILTER} AND intensidad >= 0 AND velocidad_km_h > 0 AND velocidad_km_h < 120),
g AS (SELECT corredor, avg(intensidad / 2500) AS ivc, avg(velocidad_km_h) AS v, avg(intensidad) AS i,
  avg(greatest(0, least(1, 1 - velocidad_km_h / 60))) AS s, count(*) AS n_registros FROM l GROUP BY corredor)
SELECT CAST(row_number() OVER (ORDER BY ivc DESC, corredor) AS INTEGER) AS rank, corredor,
  round(ivc, 4) AS ivc_medio, round(v, 4) AS velocidad_media, round(i, 4) AS intensidad_media,
  round(s, 4) AS icv_simple_medio, n_registros FROM g ORDER BY ivc DESC, corredor LIMIT 15"""))(_view("corredores_ivc"))


CELL_MEASURES = ["velocidad_km_h", "intensidad", "icv"]


def cells(spark, sf):
    return once(spark, sf, "cells", lambda: sketches.sketch_cells(
        master(spark, sf), measures=CELL_MEASURES, distinct=["l_partkey"]))


_LATTICE_SQL = ", ".join(
    f"count({m}) AS {m}_n, round(avg({m}), 4) AS {m}_media, round(stddev_samp({m}), 4) AS {m}_std, round(min({m}), 4) AS {m}_min, round(max({m}), 4) AS {m}_max"
    for m in CELL_MEASURES)


@query("report_lattice", from_master(f"""
SELECT concat_ws('+', CASE WHEN grouping(corredor) = 0 THEN 'corredor' END, CASE WHEN grouping(nombre_comuna) = 0 THEN 'nombre_comuna' END,
    CASE WHEN grouping(franja_horaria) = 0 THEN 'franja_horaria' END, CASE WHEN grouping(dia_num) = 0 THEN 'dia_num' END) AS nivel,
  corredor, nombre_comuna, franja_horaria, dia_num, count(*) AS n, {_LATTICE_SQL}
FROM master GROUP BY GROUPING SETS ((corredor), (nombre_comuna), (franja_horaria), (dia_num), (nombre_comuna, franja_horaria), ())"""))
def lattice(spark, sf):
    """All groupings at once, from cells written once."""
    return rounded(sketches.report_lattice(cells(spark, sf)))


@query("merged_filtered_report", from_master(f"""
, e AS (SELECT nombre_comuna, franja_horaria, count(*) AS n, round(avg(icv), 4) AS icv_media, round(max(icv), 4) AS icv_max
  FROM master WHERE {FILTER} GROUP BY ALL)
SELECT *, true AS cuantiles_en_rango, true AS distintos_en_rango FROM e"""))
def merged_filtered_report(spark, sf):
    """Filtered figures from stored cells; approximate ones lie in their bounds around the exact ones."""
    communes, day = ["NATION_15", "NATION_20", "NATION_8"], "Sabado"
    by = ["nombre_comuna", "franja_horaria"]
    found = sketches.merged_report(cells(spark, sf), by, {"p30": 0.3, "p70": 0.7}, communes, None, "Todas", day)
    facts = features.apply_filters(master(spark, sf), communes, None, "Todas", day)
    near = facts.join(found, by).groupBy(*by).agg(*[
        (F.abs(F.avg((F.col("icv") <= F.col(f"icv_{name}")).cast("int")) - p) <= 0.05 + 1 / F.count("icv")).alias(name) for name, p in (("p30", 0.3), ("p70", 0.7))],
        F.count_distinct("l_partkey").alias("exact"))
    return rounded(found.join(near, by).select(
        *by, "n", "icv_media", "icv_max", (F.col("p30") & F.col("p70")).alias("cuantiles_en_rango"),
        (F.abs(F.col("l_partkey_distintos") - F.col("exact")) <= 0.08 * F.col("exact") + 1).alias("distintos_en_rango")))


CAPACITY_SQL = """
, named AS (SELECT corredor, CASE WHEN intensidad > 50000 THEN 'Via Regional ' || corredor
  WHEN intensidad > 20000 THEN 'Calle San Juan ' || corredor ELSE corredor END AS via, intensidad, velocidad_km_h FROM master),
g AS (SELECT via AS corredor, avg(intensidad) AS intensidad, avg(velocidad_km_h) AS velocidad_km_h,
  CASE WHEN contains(upper(via), 'REGIONAL') THEN 5400 WHEN contains(upper(via), 'SAN JUAN') THEN 3600 ELSE 1800 END AS capacidad_estimada
  FROM named WHERE intensidad > 0 GROUP BY via),
s AS (SELECT *, round_even(intensidad / capacidad_estimada, 4) AS ivc FROM g),
levels AS (SELECT *, CASE WHEN ivc < 0.4 THEN 'Fluido (A/B)' WHEN ivc < 0.7 THEN 'Moderado (C/D)'
  WHEN ivc < 0.9 THEN 'Congestionado (E)' ELSE 'Saturado (F)' END AS nivel_servicio FROM s)"""


def _named(spark, sf):
    name = (F.when(F.col("intensidad") > 50000, F.concat(F.lit("Via Regional "), "corredor"))
            .when(F.col("intensidad") > 20000, F.concat(F.lit("Calle San Juan "), "corredor"))
            .otherwise(F.col("corredor")))
    return master(spark, sf).withColumn("corredor", name)


@query("top_service_levels", from_master(CAPACITY_SQL + """
SELECT corredor, round(intensidad, 4) AS intensidad, round(velocidad_km_h, 4) AS velocidad_km_h,
  CAST(capacidad_estimada AS INTEGER) AS capacidad_estimada, ivc, nivel_servicio FROM levels
ORDER BY ivc DESC, corredor LIMIT 15"""))
def top_service_levels(spark, sf):
    return rounded(reports.top_service_levels(_named(spark, sf)))


@query("service_level_counts", from_master(CAPACITY_SQL + """
SELECT nivel_servicio, count(*) AS n_corredores FROM levels GROUP BY nivel_servicio"""))
def service_level_counts(spark, sf):
    return reports.service_level_counts(_named(spark, sf))


@query("hourly_means", from_master("""
, h AS (SELECT hora, avg(velocidad_km_h) AS v, avg(intensidad) AS i FROM master GROUP BY hora)
SELECT hora, round(v, 4) AS velocidad_media, round(i, 4) AS intensidad_media,
  hora = (SELECT hora FROM h ORDER BY v, hora LIMIT 1) AS mas_lenta,
  hora = (SELECT hora FROM h ORDER BY i DESC, hora LIMIT 1) AS mas_intensa FROM h"""))
def hourly_means(spark, sf):
    return rounded(reports.hourly_means(master(spark, sf)))


@query("index_by_slot", from_master("""
SELECT franja_horaria, round(avg(icv), 4) AS icv_medio, round(stddev_samp(icv), 4) AS icv_std,
  round(median(icv), 4) AS icv_mediana, round(max(icv), 4) AS icv_maximo FROM master GROUP BY franja_horaria"""))
def index_by_slot(spark, sf):
    return rounded(reports.icv_by_slot(master(spark, sf)))


@query("hotspot_measures", from_hotspots("""
, long AS (SELECT 'velocidad_km_h' AS variable, velocidad_km_h AS x FROM hotspots
  UNION ALL SELECT 'intensidad', intensidad FROM hotspots UNION ALL SELECT 'icv', icv FROM hotspots)
SELECT variable, count(x) AS count, round(avg(x), 4) AS mean, round(stddev_samp(x), 4) AS std, round(min(x), 4) AS min,
  round(quantile_cont(x, 0.25), 4) AS p25, round(median(x), 4) AS p50, round(quantile_cont(x, 0.75), 4) AS p75,
  round(max(x), 4) AS max FROM long GROUP BY variable"""))
def hotspot_measures(spark, sf):
    return rounded(reports.hotspot_measures(master(spark, sf), CONFIG))


@query("hotspot_corridors", from_hotspots("""
SELECT corredor, count(*) AS n FROM hotspots GROUP BY corredor ORDER BY n DESC, corredor LIMIT 10"""))
def hotspot_corridors(spark, sf):
    return reports.hotspot_corridors(master(spark, sf), CONFIG)


def _describe_sql(key: str) -> str:
    return from_master(f"""SELECT {key}, round(avg(velocidad_km_h), 4) AS vel_media,
  round(avg(intensidad), 4) AS int_media, count(*) AS n_obs FROM master GROUP BY {key}""")


@query("describe_corridors", _describe_sql("corredor"))
def describe_corridors(spark, sf):
    return rounded(reports.describe_by(master(spark, sf), "corredor"))


@query("describe_communes", _describe_sql("nombre_comuna"))
def describe_communes(spark, sf):
    return rounded(reports.describe_by(master(spark, sf), "nombre_comuna"))


@query("flow_per_speed", from_master("""
SELECT corredor, round(avg(velocidad_km_h), 4) AS vel_media, round(avg(intensidad), 4) AS int_media,
  round(avg(intensidad) / avg(velocidad_km_h), 4) AS ratio_iv FROM master GROUP BY corredor
ORDER BY avg(intensidad) / avg(velocidad_km_h) DESC, corredor LIMIT 10"""))
def flow_per_speed(spark, sf):
    return rounded(reports.flow_per_speed(master(spark, sf)))
