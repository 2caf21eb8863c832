"""Text, number and date expressions on the documents, orders and events."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from registry.tables import MEASUREMENTS_SQL, measurements, query, rounded, table
from viario.functions import dates, numbers, text
from viario.operators import cleaning, features, stats
from viario.plans import reports
from viario.plans.datasets import passenger_columns
from viario.sources.files import spread

BROKEN = "�"
# What is put around the documents so that every rule has something to do.
CONTROL_DIRT = "\x07"
WORD_DIRT = f" T{BROKEN}nel r{BROKEN}{BROKEN}o V{BROKEN}a Crist{BROKEN}bal {BROKEN}XITO DO{BROKEN}A energ{BROKEN}a {BROKEN}x "
FOREIGN_DIRT = "Привет 你好 مرحبا"


def dirty(spark, sf):
    """Whole texts with control characters, broken words, doubled spaces and quotes."""
    docs = spread(table(spark, sf, "documents").select("doc_id", "lang", "text"))
    return docs.select(
        "doc_id", "lang",
        F.concat(F.lit(CONTROL_DIRT), F.replace("text", F.lit(" "), F.lit("   ")),
                 F.lit(WORD_DIRT), F.lit(FOREIGN_DIRT)).alias("sucio"),
        F.concat(F.lit("  \""), F.replace("text", F.lit('"'), F.lit("")), F.lit("\"  ")).alias("citado"),
        F.col("text").alias("limpio"),
    )


def _sql_text(value: str) -> str:
    return " || ".join(f"chr({ord(c)})" if not c.isascii() or not c.isprintable() else "'" + c + "'"
                       for c in value)


DIRTY_SQL = f"""
dirty AS (
  SELECT doc_id, lang, {_sql_text(CONTROL_DIRT)} || replace(text, ' ', '   ') || {_sql_text(WORD_DIRT)}
      || {_sql_text(FOREIGN_DIRT)} AS sucio,
    '  "' || replace(text, '"', '') || '"' || chr(160) || ' ' AS citado, text AS limpio FROM documents)"""

SPACE_CLASS = r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def strip_sql(c: str) -> str:
    return f"regexp_replace({c}, '^{SPACE_CLASS}+|{SPACE_CLASS}+$', '', 'g')"


FFFD = r"\x{FFFD}"
REPAIR_SQL = [
    (rf"\bV{FFFD}+a", "Vía"), (rf"T{FFFD}+nel", "Túnel"), (rf"Crist{FFFD}+bal", "Cristóbal"),
    (rf"r{FFFD}+o", "río"), (rf"{FFFD}+XITO", "ÉXITO"), (rf"DO{FFFD}+A", "DOÑA"),
]


def repair_sql(c: str, leading: bool) -> str:
    pairs = ([(rf"{FFFD}+a\b", "ía")] if leading else []) + REPAIR_SQL
    return reduce(lambda x, kv: f"regexp_replace({x}, '{kv[0]}', '{kv[1]}', 'g')", pairs, c)


def unwrap_sql(c: str) -> str:
    t = strip_sql(c)
    return (f"CASE WHEN length({t}) >= 2 AND left({t}, 1) IN ('\"', '''') AND right({t}, 1) = left({t}, 1) "
            f"AND NOT contains(substr({t}, 2, length({t}) - 2), left({t}, 1)) "
            f"THEN substr({t}, 2, length({t}) - 2) ELSE {c} END")


CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]"
FOREIGN = r"[^\x09\x0A\x0D\x20-\x7E\x{A0}-\x{24F}\x{2000}-\x{206F}\x{20A0}-\x{20CF}]"


def _steps_sql(column: str) -> str:
    return f"""
s0 AS (SELECT doc_id, {column} AS original, {repair_sql(column, False)} AS t FROM dirty),
s1 AS (SELECT doc_id, original, regexp_replace(regexp_replace(regexp_replace(t, '[\\x{{FFFD}}-\\x{{FFFF}}]', '', 'g'),
  '{CONTROL}', '', 'g'), '{FOREIGN}', '', 'g') AS t FROM s0),
s2 AS (SELECT doc_id, original, regexp_replace({unwrap_sql('t')}, ' {{2,}}', ' ', 'g') AS t FROM s1),
cleaned AS (SELECT doc_id, original, {strip_sql('t')} AS cleaned FROM s2)"""


def _clean(column: str):
    def run(spark, sf):
        df = dirty(spark, sf)
        out = text.clean_text(F.col(column))
        return df.select(
            "doc_id", F.md5(out.cast("binary")).alias("huella"), F.length(out).alias("largo"),
            text.text_changed(F.col(column), out).alias("cambio"),
        )
    return run


for _name, _column in (("clean_cells", "sucio"), ("clean_quoted_cells", "citado"), ("clean_plain_cells", "limpio")):
    query(_name, f"""WITH {DIRTY_SQL}, {_steps_sql(_column)}
SELECT doc_id, md5(cleaned) AS huella, CAST(length(cleaned) AS INTEGER) AS largo, cleaned <> original AS cambio
FROM cleaned""")(_clean(_column))


@query("repair_broken_words", f"""WITH {DIRTY_SQL}
SELECT doc_id, md5(replace({repair_sql('sucio', True)}, chr(65533), '')) AS huella FROM dirty""")
def repair_broken_words(spark, sf):
    return dirty(spark, sf).select(
        "doc_id", F.md5(text.repair_words(F.col("sucio")).cast("binary")).alias("huella"))


def _cell_rule(name: str, function, sql: str, column: str = "sucio"):
    def run(spark, sf):
        return dirty(spark, sf).select(
            "doc_id", F.md5(function(F.col(column)).cast("binary")).alias("huella"))
    query(name, f"WITH {DIRTY_SQL} SELECT doc_id, md5({sql}) AS huella FROM dirty")(run)


_cell_rule("drop_replacement_chars", text.drop_replacement_chars,
           r"regexp_replace(sucio, '[\x{FFFD}-\x{FFFF}]', '', 'g')")
_cell_rule("drop_control_chars", text.drop_control_chars, f"regexp_replace(sucio, '{CONTROL}', '', 'g')")
_cell_rule("drop_foreign_chars", text.drop_foreign_chars, f"regexp_replace(sucio, '{FOREIGN}', '', 'g')")
_cell_rule("collapse_spaces", text.collapse_spaces, "regexp_replace(sucio, ' {2,}', ' ', 'g')")
_cell_rule("strip_text", text.strip, strip_sql("citado"), "citado")
_cell_rule("unwrap_quotes", text.unwrap_quotes, unwrap_sql("citado"), "citado")


@query("removed_characters", f"""WITH {DIRTY_SQL}, {_steps_sql('sucio')},
gone AS (SELECT doc_id, unnest(list_distinct(list_filter(string_split(original, ''), lambda ch: NOT contains(cleaned, ch)))) AS ch FROM cleaned)
SELECT printf('U+%04X', unicode(ch)) AS codigo, count(*) AS n FROM gone WHERE ch <> '' GROUP BY codigo""")
def removed_characters(spark, sf):
    df = dirty(spark, sf)
    gone = text.removed_characters(F.col("sucio"), text.clean_text(F.col("sucio")))
    return df.select(F.explode(gone).alias("codigo")).groupBy("codigo").agg(F.count(F.lit(1)).alias("n"))


def _two_texts(spark, sf):
    return dirty(spark, sf).select("doc_id", "sucio", "citado", "limpio")


LOG_SQL = f"""WITH {DIRTY_SQL},
all_cells AS (SELECT doc_id, 'sucio' AS columna, sucio AS v FROM dirty UNION ALL
  SELECT doc_id, 'citado', citado FROM dirty UNION ALL SELECT doc_id, 'limpio', limpio FROM dirty),
s0 AS (SELECT doc_id, columna, v AS original, {repair_sql('v', False)} AS t FROM all_cells),
s1 AS (SELECT doc_id, columna, original, regexp_replace(regexp_replace(regexp_replace(t, '[\\x{{FFFD}}-\\x{{FFFF}}]', '', 'g'),
  '{CONTROL}', '', 'g'), '{FOREIGN}', '', 'g') AS t FROM s0),
s2 AS (SELECT doc_id, columna, original, regexp_replace({unwrap_sql('t')}, ' {{2,}}', ' ', 'g') AS t FROM s1),
s3 AS (SELECT doc_id, columna, original, {strip_sql('t')} AS cleaned FROM s2),
log AS (SELECT 'documents' AS archivo, doc_id + 2 AS fila, columna, md5(original) AS valor_original,
  md5(cleaned) AS valor_limpio FROM s3 WHERE cleaned <> original)"""


@query("change_log", LOG_SQL + " SELECT * FROM log")
def change_log(spark, sf):
    log = cleaning.change_log(_two_texts(spark, sf), ["sucio", "citado", "limpio"], "documents", "doc_id")
    return log.withColumns({c: F.md5(F.col(c).cast("binary")) for c in ("valor_original", "valor_limpio")})


@query("cleaning_totals", LOG_SQL + """,
t AS (SELECT count(*) AS celdas_modificadas, string_agg(DISTINCT columna, ',' ORDER BY columna) AS columnas_limpias FROM log)
SELECT 'documents' AS archivo, * FROM t UNION ALL SELECT NULL, * FROM t""")
def cleaning_totals(spark, sf):
    log = cleaning.change_log(_two_texts(spark, sf), ["sucio", "citado", "limpio"], "documents", "doc_id")
    return cleaning.cleaning_totals(log).withColumn("columnas_limpias", F.concat_ws(",", "columnas_limpias"))


_NUMBER_SQL = "regexp_full_match({0}, '\\s*[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?\\s*')"
_TEXT_COLUMNS = {
    "o_orderstatus": "o_orderstatus", "o_orderpriority": "o_orderpriority",
    "o_totalprice": "CAST(o_totalprice AS VARCHAR)",
    "numbers_first": "CASE WHEN o_orderkey % 4 = 0 THEN o_orderpriority ELSE CAST(o_orderkey AS VARCHAR) END",
    "few_texts": "CASE WHEN o_orderkey % 32 = 0 THEN o_orderpriority ELSE CAST(o_orderkey AS VARCHAR) END",
    "nulls": "CAST(NULL AS VARCHAR)",
}


@query("text_column_detection", "WITH " + ", ".join(["s AS (SELECT " + ", ".join(
    f"avg(CASE WHEN {c} IS NOT NULL THEN CAST({_NUMBER_SQL.format('(' + c + ')')} AS INT) END) AS {n}" for n, c in _TEXT_COLUMNS.items())
    + " FROM orders)", "u AS (UNPIVOT s ON COLUMNS(*) INTO NAME columna VALUE parte)"]) + " SELECT columna FROM u WHERE parte < 0.9")
def text_column_detection(spark, sf):
    """Columns with texts, some of them behind many numbers."""
    columns = {n: F.expr(c.replace("VARCHAR", "STRING")) for n, c in _TEXT_COLUMNS.items()}
    names = cleaning.text_columns(table(spark, sf, "orders").select(*[c.alias(n) for n, c in columns.items()]))
    return spark.createDataFrame([(n,) for n in names], "columna string")


@query("blank_to_null", """SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderpriority END AS valor FROM orders""")
def blank_to_null(spark, sf):
    mixed = (F.when(F.col("o_orderkey") % 8 == 0, F.lit('  "" ')).when(F.col("o_orderkey") % 8 == 4, F.lit(" \t "))
             .otherwise(F.col("o_orderpriority")))
    return table(spark, sf, "orders").select("o_orderkey", text.blank_to_null(mixed).alias("valor"))


@query("area_key", r"""
WITH spelled AS (SELECT doc_id, strip_accents(replace(replace(replace(
    regexp_replace(text, '[–—]', '-', 'g'), 'ß', 'ss'), 'æ', 'ae'), 'œ', 'oe')) AS t FROM documents)
SELECT doc_id, md5(trim(regexp_replace(replace(lower(regexp_replace(t, '[^\x00-\x7F\p{L}\p{N}]', '', 'g')), '-', ' '), '\s+', ' ', 'g')))
  AS huella FROM spelled
UNION ALL SELECT doc_id, md5('privet omega 漢字 ' || doc_id) FROM documents""")
def area_key(spark, sf):
    """Keys of all texts, and of names in other scripts: two are spelled in Latin letters, others stay."""
    plain = F.translate("text", "–—", "--")
    documents = table(spark, sf, "documents")
    other = documents.select("doc_id", F.concat(F.lit("  ПРИВЕТ-Ωμέγα-漢字-"), F.col("doc_id").cast("string")).alias("t"))
    return documents.select("doc_id", plain.alias("t")).unionByName(other).select(
        "doc_id", F.md5(text.area_key(F.col("t")).cast("binary")).alias("huella"))


@query("corridor_label", """WITH s AS (SELECT doc_id, lower(strip_accents(text)) AS t FROM documents),
w AS (SELECT doc_id, regexp_replace(t, '[^a-z0-9\\s]', '', 'g') AS t FROM s)
SELECT doc_id, md5(coalesce(nullif(upper(regexp_replace(regexp_replace(t, '^[0-9\\s]+', ''), '\\s+$', '')), ''), 'DESCONOCIDO')) AS huella FROM w""")
def corridor_label(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", F.md5(text.corridor_label(F.col("text")).cast("binary")).alias("huella"))


@query("commune_code", """SELECT o_orderkey, lpad(regexp_extract(o_orderpriority, '[0-9]+'), 2, '0') AS codigo,
  CASE WHEN length(CAST(o_custkey AS VARCHAR)) < 2 THEN lpad(CAST(o_custkey AS VARCHAR), 2, '0') ELSE CAST(o_custkey AS VARCHAR) END AS cliente
FROM orders""")
def commune_code(spark, sf):
    return table(spark, sf, "orders").select(
        "o_orderkey", text.commune_code(F.col("o_orderpriority")).alias("codigo"),
        text.commune_code(F.col("o_custkey")).alias("cliente"))


@query("safe_name", """SELECT o_orderkey, regexp_replace(replace('Via_' || replace(o_orderpriority, '/', '_') || '_' || o_orderstatus,
  ' ', '_'), '[^A-Za-z0-9_]', '', 'g') AS nombre FROM orders""")
def safe_name(spark, sf):
    label = F.concat(F.lit("Vía "), "o_orderpriority", F.lit("/"), "o_orderstatus")
    return table(spark, sf, "orders").select("o_orderkey", text.safe_name(label).alias("nombre"))


@query("snake_case_columns", "SELECT o_orderkey AS ano_mes, o_custkey AS linea_o FROM orders")
def snake_case_columns(spark, sf):
    raw = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias(" AÑO-MES"), F.col("o_custkey").alias("LÍNEA_O "))
    return raw.toDF(*[text.snake_case(c) for c in raw.columns])


PRICE = "o_totalprice"


@query("lenient_numbers", """SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_totalprice END AS precio FROM orders""")
def lenient_numbers(spark, sf):
    shown = F.col(PRICE).cast("decimal(12,2)").cast("string")
    bad = (F.when(F.col("o_orderkey") % 15 == 0, F.lit("NaN")).when(F.col("o_orderkey") % 15 == 5, F.lit("12d"))
           .when(F.col("o_orderkey") % 15 == 10, F.lit("s/d")).otherwise(F.concat(F.lit(" "), shown)))
    return table(spark, sf, "orders").select("o_orderkey", numbers.number(bad).alias("precio"))


@query("decimal_comma", "SELECT o_orderkey, o_totalprice AS precio FROM orders")
def decimal_comma(spark, sf):
    shown = F.replace(F.col(PRICE).cast("decimal(12,2)").cast("string"), F.lit("."), F.lit(","))
    return table(spark, sf, "orders").select("o_orderkey", numbers.decimal_comma(shown).alias("precio"))


@query("spanish_numbers", """SELECT o_orderkey, o_totalprice AS con_coma,
  CAST(o_orderkey + 1000 AS DOUBLE) AS con_miles, CASE WHEN o_custkey < 10 THEN CAST(o_custkey AS DOUBLE) END AS dudoso FROM orders""")
def spanish_numbers(spark, sf):
    shown = F.translate(F.format_number(F.col(PRICE).cast("decimal(12,2)"), 2), ",.", ".,")
    key = F.col("o_orderkey") + 1000
    thousands = F.concat_ws(".", F.floor(key / 1000).cast("string"), F.lpad((key % 1000).cast("string"), 3, "0"))
    unclear = F.when(F.col("o_custkey") < 10, F.col("o_custkey").cast("string")).otherwise(F.lit("1.234.567"))
    return table(spark, sf, "orders").select(
        "o_orderkey", numbers.spanish_number(F.concat(F.lit('"'), shown, F.lit('"'))).alias("con_coma"),
        numbers.spanish_number(thousands).alias("con_miles"), numbers.spanish_number(unclear).alias("dudoso"))


@query("row_totals", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice,
  CASE WHEN nullif(l_discount, 0) IS NOT NULL OR nullif(l_tax, 0) IS NOT NULL
    THEN round(coalesce(nullif(l_discount, 0), 0) + coalesce(nullif(l_tax, 0), 0), 4) END AS total_pax FROM lineitem""")
def row_totals(spark, sf):
    rows = table(spark, sf, "lineitem").withColumns({
        "pax_mov_a": F.nullif("l_discount", F.lit(0.0)), "pax_mov_b": F.nullif("l_tax", F.lit(0.0))})
    total = numbers.row_sum([F.col(c) for c in passenger_columns(rows.columns)])
    return rounded(rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice",
                               total.alias("total_pax")))


@query("booleans", """SELECT o_orderkey, o_orderstatus = 'F' AS verdad, o_orderstatus = 'F' AS restaurada FROM orders""")
def booleans(spark, sf):
    word = (F.when(F.col("o_orderstatus") == "F", F.lit(" Si ")).when(F.col("o_orderstatus") == "O", F.lit("no"))
            .otherwise(F.lit("?")))
    df = table(spark, sf, "orders").select("o_orderkey", word.alias("verdad"), word.alias("restaurada"))
    return numbers.restore_booleans(df, ["restaurada"]).withColumn("verdad", numbers.to_bool(F.col("verdad")))


@query("day_first_dates", """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 2 THEN NULL ELSE o_orderdate END AS fecha FROM orders""")
def day_first_dates(spark, sf):
    shown = (F.when(F.col("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))
             .when(F.col("o_orderkey") % 3 == 1, F.date_format("o_orderdate", "dd/MM/yyyy"))
             .otherwise(F.date_format("o_orderdate", "'99'/MM/yyyy")))
    return table(spark, sf, "orders").select("o_orderkey", dates.day_first_timestamp(shown).alias("fecha"))


@query("ddmmyy_dates", """SELECT o_orderkey, o_orderdate AS fecha,
  CASE WHEN o_orderkey % 2 = 0 THEN make_timestamp(1969 + (o_orderkey % 30)::BIGINT, 1::BIGINT, 2::BIGINT, 0::BIGINT, 0::BIGINT, 0.0::DOUBLE) END AS siglo FROM orders""")
def ddmmyy_dates(spark, sf):
    shown = F.regexp_replace(F.date_format("o_orderdate", "ddMMyy"), "^0", "")
    old = F.when(F.col("o_orderkey") % 2 == 0,
                 F.concat(F.lit("201"), (69 + F.col("o_orderkey") % 30).cast("string"))).otherwise(F.lit("1234567"))
    return table(spark, sf, "orders").select(
        "o_orderkey", dates.ddmmyy_timestamp(shown).alias("fecha"), dates.ddmmyy_timestamp(old).alias("siglo"))


@query("utc_timestamps", "SELECT event_id, date_trunc('second', ts) - INTERVAL 5 HOUR AS con_zona, date_trunc('second', ts) AS sin_zona FROM events")
def utc_timestamps(spark, sf):
    shown = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    return table(spark, sf, "events").select(
        "event_id", dates.utc_timestamp(F.concat(shown, F.lit("+05:00"))).alias("con_zona"),
        dates.utc_timestamp(shown).alias("sin_zona"))


@query("hour_tokens", "SELECT event_id, CAST(hour(ts) AS INTEGER) AS hora, CAST(hour(ts) AS INTEGER) AS hora_decimal FROM events")
def hour_tokens(spark, sf):
    return table(spark, sf, "events").select(
        "event_id", dates.hour_token(F.date_format("ts", "HH:mm:ss")).alias("hora"),
        dates.hour_token(F.hour("ts").cast("double").cast("string")).alias("hora_decimal"))


@query("place_coordinates", """SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_acctbal END AS lon,
  CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE CAST(c_nationkey AS DOUBLE) END AS lat FROM customer""")
def place_coordinates(spark, sf):
    lon = F.when(F.col("c_custkey") % 7 == 0, F.lit("sin dato")).otherwise(F.col("c_acctbal").cast("decimal(12,2)").cast("string"))
    place = F.concat(F.lit("{'lon': '"), lon, F.lit("', 'lat' : '"), F.col("c_nationkey").cast("string"), F.lit("'}"))
    both = dates.place_coordinates(place)
    return table(spark, sf, "customer").select("c_custkey", both["lon"].alias("lon"), both["lat"].alias("lat"))


@query("period_dates", """SELECT o_orderkey, CASE WHEN o_orderkey % 14 = 13 THEN NULL ELSE make_timestamp(year(o_orderdate), CASE WHEN o_orderkey % 14 = 0 THEN 1 ELSE o_orderkey % 14 END, 1, 0, 0, 0.0::DOUBLE) END AS periodo,
  make_timestamp(year(o_orderdate), 1, 1, 0, 0, 0.0::DOUBLE) AS ano FROM orders""")
def period_dates(spark, sf):
    month = F.nullif(F.col("o_orderkey") % 14, F.lit(0).cast("bigint"))
    year = F.year("o_orderdate").cast("double")
    return table(spark, sf, "orders").select(
        "o_orderkey", dates.period_start(year, month).alias("periodo"), dates.period_start(year).alias("ano"))


@query("date_plus_hour", """SELECT event_id, date_trunc('day', ts) + to_hours(CASE WHEN event_id % 5 = 0 THEN 0 ELSE event_id % 24 END) AS momento FROM events""")
def date_plus_hour(spark, sf):
    hour = F.when(F.col("event_id") % 5 != 0, F.col("event_id") % 24)
    return table(spark, sf, "events").select("event_id", dates.with_hour(F.col("ts"), hour).alias("momento"))


@query("day_labels", """SELECT event_id, CASE isodow(ts) WHEN 1 THEN 'Lunes' WHEN 2 THEN 'Martes' WHEN 3 THEN 'Miercoles'
  WHEN 4 THEN 'Jueves' WHEN 5 THEN 'Viernes' WHEN 6 THEN 'Sabado' ELSE '?' END AS dia FROM events""")
def day_labels(spark, sf):
    day = F.nullif(F.weekday("ts") + 1, F.lit(7))
    return table(spark, sf, "events").select("event_id", dates.day_label(day).alias("dia"))


@query("passenger_trend", """SELECT date_trunc('month', o_orderdate) AS fecha_periodo, round(sum(o_totalprice), 2) AS total_pax,
  date_trunc('month', o_orderdate) >= TIMESTAMP '2020-03-01' AS pandemia FROM orders GROUP BY ALL""")
def passenger_trend(spark, sf):
    return rounded(reports.passenger_trend(_passengers(spark, sf)), 2)


def _passengers(spark, sf):
    return table(spark, sf, "orders").select(
        dates.period_start(F.year("o_orderdate"), F.month("o_orderdate")).alias("fecha_periodo"),
        F.col("o_totalprice").alias("total_pax"))


@query("passenger_peak", """SELECT date_trunc('month', o_orderdate) AS fecha_periodo, round(sum(o_totalprice), 2) AS total_pax
FROM orders GROUP BY ALL ORDER BY sum(o_totalprice) DESC LIMIT 1""")
def passenger_peak(spark, sf):
    return rounded(reports.passenger_peak(_passengers(spark, sf)), 2)


@query("bike_lanes_by_state", """SELECT o_orderstatus AS estado, count(*) AS n_tramos,
  round(100.0 * count(*) / sum(count(*)) OVER (), 4) AS pct FROM orders GROUP BY o_orderstatus""")
def bike_lanes_by_state(spark, sf):
    lanes = table(spark, sf, "orders").withColumnRenamed("o_orderstatus", "estado")
    return rounded(reports.bike_lanes_by_state(lanes))


@query("capacity_by_name", f"""WITH {MEASUREMENTS_SQL}, n AS (SELECT CASE WHEN hora < 8 THEN 'Avenida Regional '
  WHEN hora < 12 THEN 'av 80 ' WHEN hora < 16 THEN 'Av65 ' WHEN hora < 20 THEN 'Calle ' END || corredor AS via, intensidad / 30 AS i FROM measured),
c AS (SELECT i, CASE WHEN contains(upper(via), 'REGIONAL') THEN 5400 WHEN contains(upper(via), 'AV 80') OR contains(upper(via), 'AV65')
  THEN 3600 ELSE 1800 END AS capacidad FROM n),
l AS (SELECT capacidad, CASE WHEN i / capacidad < 0.4 THEN 'Fluido (A/B)' WHEN i / capacidad < 0.7 THEN 'Moderado (C/D)'
  WHEN i / capacidad < 0.9 THEN 'Congestionado (E)' ELSE 'Saturado (F)' END AS nivel FROM c)
SELECT CAST(capacidad AS INTEGER) AS capacidad, nivel, count(*) AS n FROM l GROUP BY ALL""")
def capacity_by_name(spark, sf):
    prefix = (F.when(F.col("hora") < 8, F.lit("Avenida Regional ")).when(F.col("hora") < 12, F.lit("av 80 "))
              .when(F.col("hora") < 16, F.lit("Av65 ")).when(F.col("hora") < 20, F.lit("Calle ")))
    rows = measurements(spark, sf).select(
        F.concat(prefix, "corredor").alias("via"), (F.col("intensidad") / 30).alias("i"))
    capacity = features.estimated_capacity(F.col("via"))
    return rows.select(capacity.alias("capacidad"), features.service_level(F.col("i") / capacity).alias("nivel")).groupBy(
        "capacidad", "nivel").agg(F.count(F.lit(1)).alias("n"))


@query("share_of_total", """SELECT lang, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 4) AS pct FROM documents GROUP BY lang""")
def share_of_total(spark, sf):
    return rounded(stats.share_of_total(stats.value_counts(table(spark, sf, "documents"), "lang"), "n", "pct"))
