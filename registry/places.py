"""Joins by name and by place."""

from __future__ import annotations

from pyspark.sql import functions as F

from registry.tables import (
    CONFIG, MASTER_SQL, MEASUREMENTS_SQL, from_hotspots, from_master, master, measurements, query,
    rounded, table,
)
from viario.operators import geo, joins, ranking
from viario.plans import reports
from viario.plans.datasets import POSITION
from viario.plans.master import build_indexed_master

# ---------------------------------------------------------------- names


def _areas(spark, sf):
    """Nations, then regions, as areas with a figure each, in an order."""
    nations = table(spark, sf, "nation").select(
        F.upper(F.replace("n_name", F.lit("_"), F.lit("–"))).alias("nombre_area"),
        (F.col("n_nationkey") * 10.0 + 5).alias("total_2019"),
        F.col("n_nationkey").cast("bigint").alias(POSITION))
    regions = table(spark, sf, "region").select(
        F.col("r_name").alias("nombre_area"), (F.col("r_regionkey") * 1000.0).alias("total_2019"),
        (F.col("r_regionkey") + 1000).cast("bigint").alias(POSITION))
    nameless = spark.createDataFrame([("", 9.0, -1), (" -", 8.0, -2)], regions.schema)
    return nations.unionByName(regions).unionByName(nameless)


def _places(spark, sf):
    """Suppliers with a place name: some equal to an area, some longer, some part of one."""
    joined = table(spark, sf, "supplier").join(
        table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey")
    ).join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    name = F.replace("n_name", F.lit("_"), F.lit(" "))
    place = (F.when(F.col("s_acctbal") < 2000, F.concat(F.lit("Zona "), name, F.lit(" de "), F.initcap("r_name")))
             .when(F.col("s_acctbal") < 4000, F.substring("r_name", 1, 4))
             .when(F.col("s_acctbal") < 5000, F.lit("Ñuble"))
             .when(F.col("s_acctbal") < 5500, F.lit(None)).otherwise(name))
    return joined.select("s_suppkey", place.alias("nombre_comuna"))


@query("population_by_name", """
WITH areas AS (SELECT lower(replace(n_name, '_', ' ')) AS k, n_nationkey * 10.0::DOUBLE + 5 AS v, n_nationkey::BIGINT AS pos FROM nation
  UNION ALL SELECT lower(r_name), r_regionkey * 1000.0::DOUBLE, r_regionkey + 1000 FROM region
  UNION ALL SELECT '', 9.0::DOUBLE, -1),
names AS (SELECT s_suppkey, CASE WHEN s_acctbal < 2000 THEN 'zona ' || lower(replace(n_name, '_', ' ')) || ' de ' || lower(r_name)
  WHEN s_acctbal < 4000 THEN lower(substr(r_name, 1, 4)) WHEN s_acctbal < 5000 THEN 'nuble'
  WHEN s_acctbal < 5500 THEN '' ELSE lower(replace(n_name, '_', ' ')) END AS k
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
SELECT s_suppkey, coalesce((SELECT any_value(v) FROM areas a WHERE a.k = n.k AND n.k <> ''),
  (SELECT arg_min(v, pos) FROM areas a WHERE n.k <> '' AND a.k <> '' AND (contains(a.k, n.k) OR contains(n.k, a.k)))) AS poblacion_2019
FROM names n""")
def population_by_name(spark, sf):
    joined = joins.join_population(_places(spark, sf), _areas(spark, sf))
    return joined.select("s_suppkey", "poblacion_2019")


@query("counts_by_area", """
WITH counts AS (SELECT lower(replace(n_name, '_', ' ')) AS k, avg(c_acctbal) AS a FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1)
SELECT s_suppkey, round(a, 4) AS aforo_medio FROM supplier JOIN nation ON s_nationkey = n_nationkey
  LEFT JOIN counts ON k = lower(replace(n_name, '_', ' '))""")
def counts_by_area(spark, sf):
    nations = table(spark, sf, "nation")
    counts = table(spark, sf, "customer").join(
        nations, F.col("c_nationkey") == F.col("n_nationkey")
    ).select(
        # Two spellings of each name.
        F.when(F.col("c_custkey") % 2 == 0, F.upper(F.replace("n_name", F.lit("_"), F.lit("-"))))
        .otherwise(F.replace("n_name", F.lit("_"), F.lit("  "))).alias("nombre_comuna"),
        F.col("c_acctbal").alias("volumen_total_hora"))
    rows = table(spark, sf, "supplier").join(nations, F.col("s_nationkey") == F.col("n_nationkey")).select(
        "s_suppkey", F.replace("n_name", F.lit("_"), F.lit(" ")).alias("nombre_comuna"))
    return rounded(joins.join_counts(rows, counts).select("s_suppkey", "aforo_medio"))


SENSOR_SQL = """
sensors AS (SELECT s_name AS corredor, l_tax AS velocidad, l_quantity AS intensidad, l_discount AS lat, l_tax * 2 AS lon
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE s_acctbal > 1000),
sensor_means AS (SELECT corredor, avg(velocidad) AS simm_vel_media, avg(intensidad) AS simm_int_media, avg(lat) AS simm_lat,
  avg(lon) AS simm_lon FROM sensors GROUP BY corredor)"""


def _sensors(spark, sf):
    return table(spark, sf, "lineitem").join(
        table(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")
    ).where("s_acctbal > 1000").select(
        F.col("s_name").alias("corredor"), F.col("l_tax").alias("velocidad"),
        F.col("l_quantity").alias("intensidad"), F.col("l_discount").alias("lat"),
        (F.col("l_tax") * 2).alias("lon"))


@query("sensor_means", f"""WITH {MEASUREMENTS_SQL}, {SENSOR_SQL}
SELECT corredor, count(*) AS n, round(any_value(simm_vel_media), 4) AS simm_vel_media, round(any_value(simm_int_media), 4) AS simm_int_media,
  round(any_value(simm_lat), 4) AS simm_lat, round(any_value(simm_lon), 4) AS simm_lon
FROM measured LEFT JOIN sensor_means USING (corredor) GROUP BY corredor""")
def sensor_means(spark, sf):
    joined = joins.join_sensors(measurements(spark, sf), _sensors(spark, sf))
    means = ["simm_vel_media", "simm_int_media", "simm_lat", "simm_lon"]
    return rounded(joined.groupBy("corredor").agg(
        F.count(F.lit(1)).alias("n"), *[F.max(c).alias(c) for c in means]))


@query("master_table", f"""WITH {MEASUREMENTS_SQL}, {SENSOR_SQL},
areas AS (SELECT n_name AS nombre_comuna, n_nationkey * 10.0::DOUBLE + 5 AS total FROM nation),
joined AS (SELECT m.* EXCLUDE (poblacion_2019), total AS poblacion_2019, simm_vel_media, simm_lat
  FROM measured m LEFT JOIN areas USING (nombre_comuna) LEFT JOIN sensor_means USING (corredor)),
ends AS (SELECT min(velocidad_km_h) v0, max(velocidad_km_h) v1, min(intensidad) i0, max(intensidad) i1, min(ocupacion) o0,
  max(ocupacion) o1, median(ocupacion) om, min(poblacion_2019) p0, max(poblacion_2019) p1 FROM joined),
indexed AS (SELECT joined.*, round_even(greatest(0.0::DOUBLE, least(100.0::DOUBLE, 100.0::DOUBLE * (
      0.40::DOUBLE * (1 - (velocidad_km_h - v0) / (v1 - v0)) + 0.35::DOUBLE * ((intensidad - i0) / (i1 - i0))
      + 0.25::DOUBLE * ((coalesce(ocupacion, om) - o0) / (o1 - o0)))
    * (1 + 0.15::DOUBLE * ((poblacion_2019 - p0) / (p1 - p0))))), 2) AS icv FROM joined, ends)
SELECT corredor, nombre_comuna, count(*) AS n, any_value(poblacion_2019) AS poblacion_2019, round(any_value(simm_lat), 4) AS simm_lat,
  round(sum(icv), 2) AS icv_total FROM indexed GROUP BY ALL""")
def master_table(spark, sf):
    """Everything joined to the measurements, then the index, from the given tables."""
    counts = table(spark, sf, "customer").join(
        table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")
    ).select(F.col("n_name").alias("nombre_comuna"), F.col("c_acctbal").alias("volumen_total_hora"))
    areas = table(spark, sf, "nation").select(
        F.col("n_name").alias("nombre_area"), (F.col("n_nationkey") * 10.0 + 5).alias("total_2019"),
        F.col("n_nationkey").cast("bigint").alias(POSITION))
    speed = measurements(spark, sf).drop("poblacion_2019")
    built = build_indexed_master(speed, counts, _sensors(spark, sf), areas, CONFIG)
    out = built.groupBy("corredor", "nombre_comuna").agg(
        F.count(F.lit(1)).alias("n"), F.max("poblacion_2019").alias("poblacion_2019"),
        F.max("simm_lat").alias("simm_lat"), F.sum("icv").alias("icv_total"))
    return out.withColumns({"simm_lat": F.round("simm_lat", 4), "icv_total": F.round("icv_total", 2)})


@query("hotspot_membership", from_hotspots("""
SELECT l_partkey, l_partkey IN (SELECT l_partkey FROM hotspots) AS es_hotspot FROM master GROUP BY l_partkey"""))
def hotspot_membership(spark, sf):
    """Parts with and without a row among all hotspots."""
    df = master(spark, sf)
    return joins.flag_members(df.select("l_partkey").distinct(), ranking.hotspots(df, CONFIG), "l_partkey", "es_hotspot")


@query("available_corridors", from_master("""
SELECT corredor FROM (SELECT corredor, avg(icv) AS m FROM master WHERE NOT es_fin_semana GROUP BY corredor ORDER BY m DESC, corredor LIMIT 10)
WHERE corredor IN (SELECT s_name FROM supplier WHERE s_acctbal > 3000)"""))
def available_corridors(spark, sf):
    top = ranking.rank_corridors(master(spark, sf), CONFIG).select("corredor")
    existing = table(spark, sf, "supplier").where("s_acctbal > 3000").select(F.col("s_name").alias("corredor"))
    return joins.available(top, existing, "corredor")


# ---------------------------------------------------------------- places


def _diamond(x, y, r):
    """A closed ring as coordinate text."""
    points = [(x + r, y), (x, y + r), (x - r, y), (x, y - r), (x + r, y)]
    texts = [F.concat(F.lit("["), a.cast("string"), F.lit(","), b.cast("string"), F.lit("]")) for a, b in points]
    return F.concat(F.lit("["), F.concat_ws(",", *texts), F.lit("]"))


def communes(spark, sf):
    """Nations as diamonds on a grid; odd ones have a second, smaller part."""
    key = F.col("n_nationkey")
    x, y = (key % 5) * 20.0 + 10.0, F.floor(key / 5) * 20.0 + 10.0
    r = F.lit(6.0) + key * 0.1
    main, small = _diamond(x, y, r), _diamond(x + 9.0, y + 9.0, F.lit(2.5))
    odd = key % 2 == 1
    geometry = F.struct(
        F.when(odd, "MultiPolygon").otherwise("Polygon").alias("type"),
        F.when(odd, F.concat(F.lit("[["), small, F.lit("],["), main, F.lit("]]")))
        .otherwise(F.concat(F.lit("["), main, F.lit("]"))).alias("coordinates"))
    code = F.when(key == 24, F.lit("sin codigo")).otherwise(key.cast("string"))
    return table(spark, sf, "nation").select(
        F.lit("Feature").alias("type"),
        F.create_map(F.lit("codigo"), code, F.lit("nombre"), F.concat(F.lit(" "), "n_name")).alias("properties"),
        geometry.alias("geometry"), key.cast("bigint").alias("feature_id"))


COMMUNES_SQL = """
grid AS (SELECT n_nationkey, n_name, (n_nationkey % 5) * 20.0 + 10.0 AS x, floor(n_nationkey / 5) * 20.0 + 10.0 AS y,
  6.0 + n_nationkey * 0.1 AS r FROM nation),
shapes AS (SELECT x::DOUBLE x, y::DOUBLE y, r::DOUBLE r FROM grid UNION ALL
  SELECT x + 9.0, y + 9.0, 2.5 FROM grid WHERE n_nationkey % 2 = 1)"""


def lines(spark, sf):
    """Each embedding is a line of 32 vertices; its label names the corridor."""
    def vertex(i):
        axis = [F.col("embedding")[2 * i + k].cast("double") * 150.0 + 50.0 for k in (0, 1)]
        return F.concat(F.lit("["), axis[0].cast("string"), F.lit(","), axis[1].cast("string"), F.lit("]"))

    def part(first, last):
        return F.concat(F.lit("["), F.concat_ws(",", *[vertex(i) for i in range(first, last)]), F.lit("]"))

    two = F.col("vec_id") % 2 == 1
    geometry = F.struct(
        F.when(two, "MultiLineString").otherwise("LineString").alias("type"),
        F.when(two, F.concat(F.lit("["), part(0, 16), F.lit(","), part(16, 32), F.lit("]")))
        .otherwise(part(0, 32)).alias("coordinates"))
    name = F.concat(F.lit(" Corredor "), F.col("label").cast("string"))
    return table(spark, sf, "embeddings").select(
        F.lit("Feature").alias("type"), F.create_map(F.lit("corredor_dataset"), name).alias("properties"),
        geometry.alias("geometry"), F.col("vec_id").alias("feature_id"))


LINES_SQL = COMMUNES_SQL + """,
vertices AS (SELECT 'Corredor ' || label AS corredor, vec_id AS feature_id, i,
    CASE WHEN vec_id % 2 = 1 THEN i // 16 ELSE 0 END AS part,
    CAST(embedding[2 * i + 1] AS DOUBLE) * 150.0 + 50.0 AS lon, CAST(embedding[2 * i + 2] AS DOUBLE) * 150.0 + 50.0 AS lat
  FROM embeddings, (SELECT unnest(range(32)) AS i)),
inside AS (SELECT v.* FROM vertices v WHERE EXISTS (SELECT 1 FROM shapes WHERE abs(v.lon - x) + abs(v.lat - y) < r)),
islands AS (SELECT *, i - row_number() OVER (PARTITION BY feature_id, part ORDER BY i) AS run FROM inside),
segments AS (SELECT corredor, feature_id, part, run, lon, lat, count(*) OVER w AS n_points,
    row_number() OVER (w ORDER BY i) - 1 AS position FROM islands WINDOW w AS (PARTITION BY feature_id, part, run)
  QUALIFY count(*) OVER w >= 2)"""


@query("commune_codes", """SELECT lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS codigo_geo, n_name AS nombre_comuna FROM nation WHERE n_nationkey <> 24""")
def commune_codes(spark, sf):
    return geo.commune_features(communes(spark, sf)).select("codigo_geo", "nombre_comuna")


@query("commune_labels", f"""WITH {COMMUNES_SQL} SELECT lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS codigo_geo, n_name AS nombre_comuna,
  round(x::DOUBLE, 4) AS lon_label, round(y::DOUBLE, 4) AS lat_label FROM grid WHERE n_nationkey <> 24""")
def commune_labels(spark, sf):
    return rounded(geo.commune_labels(communes(spark, sf)))


@query("exterior_rings", f"""WITH {COMMUNES_SQL} SELECT round(x - r, 4) AS x0, round(y - r, 4) AS y0, round(x + r, 4) AS x1,
  round(y + r, 4) AS y1, 5 AS n_lados FROM shapes""")
def exterior_rings(spark, sf):
    return rounded(geo.urban_rings(communes(spark, sf)).select(
        "box.x0", "box.y0", "box.x1", "box.y1", F.size("edges").alias("n_lados")))


CUSTOMER_POINT = "(c_acctbal + 1000) / 110"


def _points(spark, sf):
    return table(spark, sf, "customer").select(
        "c_custkey", (F.expr(CUSTOMER_POINT)).alias("lon"),
        (F.col("c_custkey") * 7919 % 10007 / 10007 * 100).alias("lat"))


@query("points_in_area", f"""WITH {COMMUNES_SQL}, p AS (SELECT c_custkey, {CUSTOMER_POINT} AS lon, c_custkey * 7919 % 10007 / 10007 * 100 AS lat FROM customer)
SELECT c_custkey FROM p WHERE EXISTS (SELECT 1 FROM shapes WHERE abs(lon - x) + abs(lat - y) < r)""")
def points_in_area(spark, sf):
    points = _points(spark, sf)
    found = geo.points_in_area(points, geo.urban_rings(communes(spark, sf)))
    return points.join(found, ["lon", "lat"], "left_semi").select("c_custkey")


RAGGED = 720  # corners of a ragged commune


def ragged_communes(spark, sf):
    """Nations on the same grid as rings of many corners whose distance from the centre goes up and down."""
    key, i = F.col("n_nationkey"), F.col("i")
    r = (F.lit(6.0) + key * 0.1) * (F.lit(0.7) + (i * 37 + key) % 11 / 40.0)
    angle = i * F.pi() / (RAGGED / 2)
    lon = (key % 5) * 20.0 + 10.0 + F.cos(angle) * r
    lat = F.floor(key / 5) * 20.0 + 10.0 + F.sin(angle) * r
    corner = F.concat(F.lit("["), lon.cast("string"), F.lit(","), lat.cast("string"), F.lit("]"))
    corners = table(spark, sf, "nation").select("n_nationkey", F.explode(F.sequence(F.lit(0), F.lit(RAGGED - 1))).alias("i"))
    ring = corners.groupBy("n_nationkey").agg(F.array_sort(F.collect_list(F.struct(i, corner.alias("c")))).alias("ring"))
    return ring.select(F.struct(
        F.lit("Polygon").alias("type"),
        F.concat(F.lit("[["), F.array_join("ring.c", ","), F.lit("]]")).alias("coordinates")).alias("geometry"))


@query("points_in_ragged_area", f"""WITH p AS (SELECT c_custkey, {CUSTOMER_POINT} AS lon, c_custkey * 7919 % 10007 / 10007 * 100 AS lat FROM customer),
corners AS (SELECT n_nationkey AS k, i, (6.0 + n_nationkey * 0.1)::DOUBLE * (0.7 + (i * 37 + n_nationkey) % 11 / 40.0) AS r,
    (n_nationkey % 5) * 20.0::DOUBLE + 10.0 AS x, floor(n_nationkey / 5) * 20.0::DOUBLE + 10.0 AS y FROM nation, (SELECT unnest(range({RAGGED})) AS i)),
ring AS (SELECT k, i, x + cos(i * pi() / {RAGGED // 2}) * r AS px, y + sin(i * pi() / {RAGGED // 2}) * r AS py FROM corners),
sides AS (SELECT a.k, a.px AS x1, a.py AS y1, b.px AS x2, b.py AS y2 FROM ring a JOIN ring b ON a.k = b.k AND b.i = (a.i + 1) % {RAGGED}),
boxes AS (SELECT k, min(px) AS west, max(px) AS east, min(py) AS south, max(py) AS north FROM ring GROUP BY k),
met AS (SELECT c_custkey, k, count(*) AS n FROM p JOIN boxes ON lon BETWEEN west AND east AND lat BETWEEN south AND north JOIN sides USING (k)
  WHERE (y1 > lat) <> (y2 > lat) AND lon < (x2 - x1) * (lat - y1) / (y2 - y1) + x1 GROUP BY c_custkey, k)
SELECT DISTINCT c_custkey FROM met WHERE n % 2 = 1""")
def points_in_ragged_area(spark, sf):
    points = _points(spark, sf)
    found = geo.points_in_area(points, geo.urban_rings(ragged_communes(spark, sf)))
    return points.join(found, ["lon", "lat"], "left_semi").select("c_custkey")


def _segments(spark, sf):
    return geo.clip_lines(geo.line_points(lines(spark, sf)), geo.urban_rings(communes(spark, sf)))


@query("clipped_lines", f"""WITH {LINES_SQL} SELECT corredor, feature_id, CAST(part AS INTEGER) AS part, CAST(position AS INTEGER) AS position, n_points,
  round(lon, 4) AS lon, round(lat, 4) AS lat FROM segments""")
def clipped_lines(spark, sf):
    return rounded(_segments(spark, sf).drop("run"))


@query("corridor_labels", f"""WITH {LINES_SQL} SELECT corredor, round(avg(lon), 4) AS lon, round(avg(lat), 4) AS lat FROM segments
WHERE position = n_points // 2 GROUP BY corredor""")
def corridor_labels(spark, sf):
    return rounded(geo.corridor_labels(_segments(spark, sf)))


@query("thinned_lines", f"""WITH {LINES_SQL}, s AS (SELECT greatest(1, ceil(count(*) / 1500.0)::BIGINT) AS step FROM segments)
SELECT corredor, count(*) AS n, round(sum(lon), 4) AS lon_total FROM segments, s
WHERE position % step = 0 OR position = n_points - 1 GROUP BY corredor""")
def thinned_lines(spark, sf):
    thin = geo.thin_lines(_segments(spark, sf), 1500)
    return rounded(thin.groupBy("corredor").agg(F.count(F.lit(1)).alias("n"), F.sum("lon").alias("lon_total")))


@query("official_communes", f"""WITH {MASTER_SQL}, {COMMUNES_SQL},
stats AS (SELECT lpad(codigo_comuna, 2, '0') AS codigo_geo, nombre_comuna, round(avg(icv), 4) AS icv_medio, count(*) AS registros,
  round(avg(velocidad_km_h), 4) AS velocidad_media, round(avg(intensidad), 4) AS intensidad_media,
  count(DISTINCT corredor) AS corredores_activos FROM master GROUP BY codigo_comuna, nombre_comuna),
official AS (SELECT lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS codigo_geo, n_name AS nombre_comuna,
  round(x::DOUBLE, 4) AS lon_label, round(y::DOUBLE, 4) AS lat_label FROM grid WHERE n_nationkey <> 24)
SELECT official.*, icv_medio, registros, velocidad_media, intensidad_media, corredores_activos,
  codigo_geo || ' - ' || nombre_comuna AS comuna_mapa FROM official LEFT JOIN stats USING (codigo_geo, nombre_comuna)""")
def official_communes(spark, sf):
    labels = geo.commune_labels(communes(spark, sf))
    return rounded(reports.official_communes(labels, master(spark, sf)))
