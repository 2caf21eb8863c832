"""Dataset cleaners, loading by key, the file cleaner and saved forests, on rows of the given tables."""

from __future__ import annotations

import posixpath
import uuid

from pyspark.sql import functions as F

from registry.tables import CONFIG, SERIES_SQL, query, rounded, series, table
from viario.config import FOREST, POPULATION_TOTAL_ROWS
from viario.operators.detect import forest
from viario.plans import datasets
from viario.plans.cleaning import CsvCleaner
from viario.sources.files import load_dataset, write_csv
from viario.storage import shared_dir

BROKEN = "�"


def _folder(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{uuid.uuid4().hex}-{name}"


@query("passengers_cleaned", """
WITH p AS (SELECT o_orderkey AS orden, CAST(year(o_orderdate) AS DOUBLE) AS ano, CASE WHEN o_orderkey % 7 <> 0
    THEN CAST(o_custkey - 200 AS DOUBLE) END AS a, CASE WHEN o_orderkey % 3 <> 0 THEN CAST(o_custkey % 50 AS DOUBLE) END AS b FROM orders),
t AS (SELECT *, CASE WHEN a IS NOT NULL OR b IS NOT NULL THEN coalesce(a, 0) + coalesce(b, 0) END AS total_pax FROM p)
SELECT CAST(orden AS VARCHAR) AS orden, ano, total_pax FROM t WHERE coalesce(total_pax, 0) >= 0""")
def passengers_cleaned(spark, sf):
    """The year column by its damaged name, the total of what was counted, nothing negative."""
    key = F.col("o_orderkey")
    raw = table(spark, sf, "orders").select(
        key.cast("string").alias("orden"), F.year("o_orderdate").cast("string").alias(f"A{BROKEN}O"),
        F.when(key % 7 != 0, (F.col("o_custkey") - 200).cast("string")).alias("PAX_MOV_A"),
        F.when(key % 3 != 0, (F.col("o_custkey") % 50).cast("string")).alias("PAX_MOV_B"))
    return datasets.clean_passengers(raw).select("orden", "ano", "total_pax")


@query("counts_cleaned", """SELECT CAST(l_orderkey AS VARCHAR) AS pedido, CAST(l_linenumber AS VARCHAR) AS linea,
  CAST(l_suppkey AS DOUBLE) AS lon, CASE WHEN l_linenumber % 3 <> 0 THEN CAST(l_partkey AS DOUBLE) END AS lat,
  nullif(trim(l_returnflag), 'N') AS nombre_comuna FROM lineitem""")
def counts_cleaned(spark, sf):
    """Coordinates under their names, blanks and lone quotes as nulls."""
    raw = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("PEDIDO"), F.col("l_linenumber").cast("string").alias("LINEA"),
        F.col("l_suppkey").cast("string").alias("CoordenadaX"),
        F.when(F.col("l_linenumber") % 3 == 0, "x").otherwise(F.col("l_partkey").cast("string")).alias("CoordenadaY"),
        F.when(F.trim("l_returnflag") == "N", ' "" ').otherwise(F.concat(F.lit(" "), F.trim("l_returnflag"))).alias("NOMBRE_COMUNA"))
    return datasets.clean_counts(raw).select("pedido", "linea", "lon", "lat", "nombre_comuna")


@query("population_cleaned", """SELECT 'Zona ' || c_custkey AS nombre_area, c_acctbal AS total_2019 FROM customer
WHERE c_custkey % 3 <> 0 AND c_custkey % 10 <> 1 AND c_custkey % 11 <> 0""")
def population_cleaned(spark, sf):
    """Totals of all ages only, no rows that add up areas, no rows without a number."""
    key = F.col("c_custkey")
    raw = table(spark, sf, "customer").select(
        F.when(key % 10 == 1, POPULATION_TOTAL_ROWS[0]).otherwise(F.concat(F.lit("  Zona "), key.cast("string"))).alias("Código"),
        F.when(key % 3 == 0, "0-4").when(key % 2 == 0, " TOTAL ").otherwise("total").alias("Grupo Edad"),
        F.when(key % 11 == 0, "sin dato").otherwise(F.col("c_acctbal").cast("string")).alias("TOTAL 2019"))
    return datasets.clean_population(raw).select("nombre_area", "total_2019")


@query("dataset_by_key", """SELECT o_orderkey, 'aforos' AS clave FROM orders""")
def dataset_by_key(spark, sf):
    """A registered file is found by its key; an absent one is nothing."""
    raw = _folder(spark, "raw")
    config = {**CONFIG, "paths": {"raw": raw}}
    write_csv(table(spark, sf, "orders").select("o_orderkey"), posixpath.join(raw, config["files"]["aforos"]))
    found = {key: load_dataset(spark, config, key) for key in ("aforos", "simm")}
    rows = [df.select(F.col("o_orderkey").cast("bigint").alias("o_orderkey"), F.lit(key).alias("clave"))
            for key, df in found.items() if df is not None]
    return rows[0] if len(rows) == 1 else rows[0].unionByName(rows[1])


@query("files_cleaned", """
SELECT 'buena' AS clave, count(*) AS filas, count(*) FILTER (o_orderkey % 4 = 0) AS celdas, false AS fallo FROM orders
UNION ALL SELECT 'otra', count(*), count(*), false FROM orders
UNION ALL SELECT 'falta', 0, 0, false
UNION ALL SELECT 'rota', 0, 0, true""")
def files_cleaned(spark, sf):
    """Files are cleaned one by one: an absent one counts nothing, a damaged one stops no other."""
    raw, clean = _folder(spark, "raw"), _folder(spark, "clean")
    orders = table(spark, sf, "orders")
    mark = F.when(F.col("o_orderkey") % 4 == 0, F.concat(F.lit("\x01"), "o_orderpriority")).otherwise(F.col("o_orderpriority"))
    write_csv(orders.select("o_orderkey", mark.alias("texto")), f"{raw}/buena.csv")
    write_csv(orders.select("o_orderkey", F.concat("o_orderpriority", F.lit("  x")).alias("texto")), f"{raw}/otra.csv")
    orders.select("o_orderpriority").write.option("compression", "none").text(f"{raw}/rota.csv")
    damaged = spark._jvm.org.apache.hadoop.fs.Path(f"{raw}/rota.csv/part-9.csv.gz")  # no archive
    out = damaged.getFileSystem(spark._jsc.hadoopConfiguration()).create(damaged)
    out.write(7)
    out.close()
    spec = {"encoding": "utf-8", "separator": ",", "text": ["texto"]}
    names = {key: {"filename": f"{key}.csv", **spec} for key in ("buena", "rota", "falta", "otra")}
    found = CsvCleaner(spark, raw, clean, f"{clean}/log", files=names).clean_all()
    rows = [(key, m.get("filas_procesadas", 0), m.get("celdas_modificadas", 0), "error" in m) for key, m in found.items()]
    return spark.createDataFrame(rows, "clave string, filas bigint, celdas bigint, fallo boolean")


# One tree, written by hand: slow rows and rows of high occupation are easy to isolate.
_LEAVES = {"slow": 1.0, "full": 2.0, "calm": 6.0}
_SUBSAMPLE, _CUTOFF = 64, -0.6


def _score(path: float) -> float:
    return -(2.0 ** (-path / float(forest.expected_path(_SUBSAMPLE))))


@query("forest_by_saved_model", f"""WITH {SERIES_SQL},
m AS (SELECT nombre_comuna, median(velocidad_km_h) AS v, median(ocupacion) AS o FROM series GROUP BY nombre_comuna),
x AS (SELECT event_id, coalesce(velocidad_km_h, v) AS v, coalesce(ocupacion, o) AS o FROM series JOIN m USING (nombre_comuna)),
s AS (SELECT event_id, CASE WHEN v <= 20 THEN {_score(_LEAVES["slow"])!r}::DOUBLE WHEN o <= 80 THEN {_score(_LEAVES["calm"])!r}::DOUBLE
  ELSE {_score(_LEAVES["full"])!r}::DOUBLE END AS p FROM x)
SELECT event_id, round(p, 4) AS isolation_score, p < {_CUTOFF} AS isolation_forest_anomaly FROM s""")
def forest_by_saved_model(spark, sf):
    """Saved trees are used again: gaps filled by the group's median, path lengths, score and cutoff."""
    rows = series(spark, sf)
    features = forest.features_of(rows)
    speed, full = features.index("velocidad_km_h"), features.index("ocupacion")
    models = _folder(spark, "models")
    tree = [(0, speed, 20.0, 1, 2, 0.0), (1, -1, 0.0, 1, 1, _LEAVES["slow"]), (2, full, 80.0, 3, 4, 0.0),
            (3, -1, 0.0, 3, 3, _LEAVES["calm"]), (4, -1, 0.0, 4, 4, _LEAVES["full"])]
    nodes = spark.createDataFrame(
        tree, "node int, feature int, threshold double, lo int, hi int, path double").withColumns(
        {"tree": F.lit(0), "subsample": F.lit(_SUBSAMPLE), "cutoff": F.lit(_CUTOFF)})
    groups = rows.select(F.col("nombre_comuna").alias("grp")).distinct().withColumn(
        "node", F.explode(F.array(*[F.lit(t[0]) for t in tree])))
    key = forest.model_key(features, "nombre_comuna", FOREST)
    trained = nodes.join(groups, "node").select(
        "grp", "tree", "node", "feature", "threshold", "lo", "hi", "path", "subsample", "cutoff")
    forest.save_model(trained.withColumn("cutoff", F.lit(0.0)), f"{models}/forest-{key}")
    forest.save_model(trained, f"{models}/forest-{key}")  # takes the place of the first one
    found = forest.detect_forest(rows, models, FOREST, ["event_id"])
    return rounded(found.select("event_id", "isolation_score", "isolation_forest_anomaly"))
