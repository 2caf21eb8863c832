"""Reading and writing: what is written from the given tables is read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window, functions as F

from registry.places import communes
from registry.tables import query, rounded, table
from viario.functions import numbers
from viario.operators import geo
from viario.schema import typed
from viario.sources import files
from viario.storage import shared_dir
from viario.streaming.text_stream import clean_stream, clean_stream_with_log, read_csv_stream


def _target(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{uuid.uuid4().hex}-{name}"


PART_ROWS = 100_000  # features of one collection


def _in_order(df: DataFrame, key: str, part_rows: int) -> DataFrame:
    """The rows by their key, in parts of about so many rows; rows with one key as they lie in the table."""
    parts = max(1, -(-df.count() // part_rows))
    placed = df.withColumn("__at", F.monotonically_increasing_id())
    return placed.repartitionByRange(parts, key, "__at").sortWithinPartitions(key, "__at").drop("__at")


def _write_lines(lines, header: str, path: str) -> None:
    """Lines as they are, after a header."""
    lines.sparkSession.createDataFrame([(header,)], "value string").union(lines).coalesce(1).write.text(path)


@query("csv_round_trip", """SELECT o_orderkey, o_custkey, o_orderpriority, o_totalprice, o_orderdate FROM orders""")
def csv_round_trip(spark, sf):
    path = _target(spark, "orders")
    files.write_csv(table(spark, sf, "orders"), path)
    raw = files.read_csv(spark, path)
    return raw.select(
        F.col("o_orderkey").try_cast("bigint").alias("o_orderkey"),
        F.col("o_custkey").try_cast("bigint").alias("o_custkey"), "o_orderpriority",
        numbers.number(F.col("o_totalprice")).alias("o_totalprice"),
        F.col("o_orderdate").try_cast("timestamp_ntz").alias("o_orderdate"))


@query("csv_quoted_text", """SELECT doc_id, md5(text) AS huella FROM documents""")
def csv_quoted_text(spark, sf):
    """Texts with line breaks, quotes and separators in their fields."""
    path = _target(spark, "documents")
    files.write_csv(table(spark, sf, "documents").select("doc_id", "text", F.lit("fin").alias("fin")), path)
    back = files.read_csv(spark, path, encoding="utf-8").where("fin = 'fin'")
    return back.select(F.col("doc_id").cast("bigint").alias("doc_id"),
                       F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("huella"))


@query("csv_record_numbers", """SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS fila FROM documents""")
def csv_record_numbers(spark, sf):
    """Records are counted, not lines, and in the order of the files."""
    path = _target(spark, "numbered-documents")
    files.write_csv(_in_order(table(spark, sf, "documents").select("doc_id", "text"), "doc_id", 10_000), path)
    back = files.read_csv(spark, path, encoding="utf-8", row_numbers=True, over_files=True)
    return back.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(files.ROW_NUMBER).alias("fila"))


@query("csv_stray_quotes", """SELECT doc_id, md5(CASE doc_id % 4 WHEN 0 THEN doc_id || '" pipe of "' || source || '"'
  WHEN 1 THEN 'a "' || chr(10) || '", ' || source WHEN 2 THEN source || '" and, "' ELSE source END) AS huella FROM documents""")
def csv_stray_quotes(spark, sf):
    """Quotes inside fields without quotes are characters; in quoted ones they are doubled, or end the quoting."""
    path = _target(spark, "stray")
    kind = F.col("doc_id") % 4
    field = (F.when(kind == 0, F.concat("doc_id", F.lit('" pipe of "'), "source", F.lit('"')))
             .when(kind == 1, F.concat(F.lit('"a ""\n"", "'), "source")).when(kind == 2, F.concat(F.lit('"'), "source", F.lit('"" and, """')))
             .otherwise(F.col("source")))
    _write_lines(table(spark, sf, "documents").select(F.concat_ws(",", "doc_id", field)), "doc_id,campo", path)
    back = files.read_csv(spark, path, encoding="utf-8")
    return back.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.md5(F.col("campo").cast("binary")).alias("huella"))


@query("csv_rejected_records", """
SELECT o_orderkey % 7 = 0 AS con_comillas, 'too many fields' AS motivo, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS suma,
  (SELECT count(*) FROM orders WHERE o_orderkey % 5 <> 0) AS leidos FROM orders WHERE o_orderkey % 5 = 0 GROUP BY ALL""")
def csv_rejected_records(spark, sf):
    """Records with too many fields come back with the reason; the others are read."""
    path = _target(spark, "surplus")
    key = F.col("o_orderkey")
    extra = F.when(key % 5 == 0, F.concat(F.lit(","), key)).otherwise("")
    text = F.concat(F.when(key % 7 == 0, F.lit('"two\nlines"')).otherwise("o_orderpriority"), extra)
    _write_lines(table(spark, sf, "orders").select(F.concat_ws(",", "o_orderkey", text)), "o_orderkey,texto", path)
    rows, bad, counts = files.read_csv_checked(spark, path, encoding="utf-8")
    own = F.substring_index("texto", ",", 1).cast("bigint")
    return bad.groupBy(F.contains("texto", F.lit('"')).alias("con_comillas"), "motivo").agg(
        F.count(F.lit(1)).alias("n"), F.sum(own).alias("suma")).withColumn("leidos", F.lit(counts["rows"]).cast("bigint"))


@query("csv_latin_encoding", """SELECT doc_id, 'Año de ' || lang || ', Medellín' AS etiqueta FROM documents""")
def csv_latin_encoding(spark, sf):
    """Bytes that are no UTF-8 are found and read as Latin-1."""
    path = _target(spark, "latin")
    label = F.concat(F.lit("Año de "), "lang", F.lit(", Medellín"))
    table(spark, sf, "documents").select("doc_id", label.alias("etiqueta")).write.options(
        header=True, encoding="ISO-8859-1").csv(path)
    back = files.read_csv(spark, path)
    return back.select(F.col("doc_id").cast("bigint").alias("doc_id"), "etiqueta")


@query("csv_line_numbers", """SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS fila FROM orders""")
def csv_line_numbers(spark, sf):
    """Numbers follow the order of the files, over all of their blocks."""
    path = _target(spark, "numbered")
    files.write_csv(_in_order(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", 1_000_000), path)
    rows = files.read_csv(spark, path, encoding="utf-8", row_numbers=True, over_files=True)
    return rows.select(F.col("o_orderkey").cast("bigint").alias("o_orderkey"), F.col(files.ROW_NUMBER).alias("fila"))


@query("scan_wanted_columns", """SELECT l_suppkey, round(sum(l_quantity), 2) AS cantidad, count(*) AS n, 0 AS con_falta FROM lineitem GROUP BY l_suppkey""")
def scan_wanted_columns(spark, sf):
    wanted = {"l_suppkey": "bigint", "l_quantity": "double", "no_existe": "string"}
    rows = files.read_columns(spark, f"{sf}/lineitem.parquet", wanted)
    return typed(rows, wanted).groupBy("l_suppkey").agg(
        F.round(F.sum("l_quantity"), 2).alias("cantidad"), F.count(F.lit(1)).alias("n"),
        F.count("no_existe").cast("int").alias("con_falta"))


@query("stable_empty_schema", """SELECT CAST(NULL AS VARCHAR) AS codigo_geo, CAST(NULL AS DOUBLE) AS icv_medio FROM nation WHERE false""")
def stable_empty_schema(spark, sf):
    none = table(spark, sf, "nation").where("n_nationkey < 0")
    return typed(none, {"codigo_geo": "string", "icv_medio": "double"})


@query("read_or_compute", """SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY l_suppkey""")
def read_or_compute(spark, sf):
    """The second call reads what the first one wrote."""
    path = _target(spark, "counts")

    def compute():
        return table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"))

    files.read_or_compute(spark, path, compute)
    return files.read_or_compute(spark, path, lambda: compute().where("false"))


@query("geojson_features", """SELECT lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS codigo_geo, n_name AS nombre_comuna,
  round((n_nationkey % 5) * 20.0 + 10.0, 4)::DOUBLE AS lon_label, round(floor(n_nationkey / 5) * 20.0 + 10.0, 4)::DOUBLE AS lat_label
FROM nation WHERE n_nationkey <> 24""")
def geojson_features(spark, sf):
    path = _target(spark, "communes.geojsonl")
    shapes = communes(spark, sf)
    line = F.concat(
        F.lit('{"type":"Feature","properties":'), F.to_json("properties"),
        F.lit(',"geometry":{"type":"'), F.col("geometry.type"), F.lit('","coordinates":'),
        F.col("geometry.coordinates"), F.lit("}}"))
    shapes.select(line.alias("value")).write.text(path)
    return rounded(geo.commune_labels(files.read_features(spark, path)))


@query("geojson_collection", """SELECT l_orderkey, l_linenumber, '} "features":[{ ' || l_returnflag || ' \\' AS modo,
  l_quantity::DOUBLE AS lon, l_orderkey * 0.5::DOUBLE AS lat FROM lineitem""")
def geojson_collection(spark, sf):
    """Collections of many features, with braces, quotes and backslashes in their texts."""
    path = _target(spark, "lines.geojson")
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", F.col("l_quantity").cast("double").alias("lon"))
    text = F.to_json(F.struct(
        F.lit("Feature").alias("type"),
        F.struct("l_orderkey", "l_linenumber", F.concat(F.lit('} "features":[{ '), "l_returnflag", F.lit(" \\")).alias("modo")).alias("properties"),
        F.struct(F.lit("Point").alias("type"), F.array("lon", F.col("l_orderkey") * 0.5).alias("coordinates")).alias("geometry")))
    parts = max(1, -(-lines.count() // PART_ROWS))
    dealt = lines.withColumn("part", F.monotonically_increasing_id() % parts)
    order = Window.partitionBy("part").orderBy("l_orderkey", "l_linenumber")
    head = '{"type":"FeatureCollection","otros":[{"type":"Feature"}],"features":[\n'
    first, last = F.lag(F.lit(1)).over(order).isNull(), F.lead(F.lit(1)).over(order).isNull()
    value = F.concat(F.when(first, head).otherwise(","), text, F.when(last, "\n]}").otherwise(""))
    dealt.select("part", value.alias("value")).write.partitionBy("part").text(path)
    place = F.from_json("geometry.coordinates", "array<double>")
    return files.read_features(spark, path).select(
        F.col("properties.l_orderkey").cast("bigint").alias("l_orderkey"), F.col("properties.l_linenumber").cast("bigint").alias("l_linenumber"),
        F.col("properties.modo").alias("modo"), place[0].alias("lon"), place[1].alias("lat"))


@query("cleaned_stream", """SELECT o_orderkey, o_orderpriority FROM orders""")
def cleaned_stream(spark, sf):
    """Dirty files cleaned as a stream until none is left."""
    source, target, progress = (_target(spark, n) for n in ("in", "out", "progress"))
    dirt = F.concat(F.lit('  "'), "o_orderpriority", F.lit('" \x01'))
    files.write_csv(table(spark, sf, "orders").select("o_orderkey", dirt.alias("o_orderpriority")), source)
    rows = read_csv_stream(spark, source, "o_orderkey bigint, o_orderpriority string")
    clean_stream(rows, ["o_orderpriority"], target, progress).awaitTermination()
    return spark.read.parquet(target)


@query("cleaned_stream_log", """SELECT 'pedidos.csv' AS archivo, o_orderkey + 2 AS fila, 'o_orderpriority' AS columna,
  '"' || o_orderpriority || '" ' || chr(1) AS valor_original, o_orderpriority AS valor_limpio FROM orders WHERE o_orderkey % 3 = 0""")
def cleaned_stream_log(spark, sf):
    """The log of a stream of several batches, each written once."""
    source, target, log, progress = (_target(spark, n) for n in ("in", "out", "log", "progress"))
    dirt = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit('"'), "o_orderpriority", F.lit('" \x01'))).otherwise(F.col("o_orderpriority"))
    files.write_csv(table(spark, sf, "orders").select("o_orderkey", dirt.alias("o_orderpriority")).repartition(3), source)
    rows = read_csv_stream(spark, source, "o_orderkey bigint, o_orderpriority string", files_at_once=1)
    clean_stream_with_log(rows, ["o_orderpriority"], "o_orderkey", "pedidos.csv", target, log, progress).awaitTermination()
    return spark.read.parquet(log).drop("lote")
