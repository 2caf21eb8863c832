"""The queries of this subpackage, each an operator on its whole table, and the SQL that checks them."""

from __future__ import annotations

import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle

from viario.llm.chat import format_conversations, masked_text, read_turns
from viario.llm.decontaminate import find_contamination
from viario.llm.divergence import divergence
from viario.llm.exact import exact_duplicates
from viario.llm.language import identify, learn_dictionaries
from viario.llm.licenses import TEMPLATES, scan, template_table
from viario.llm.packing import copy_cluster, pack, word_count
from viario.llm.quality import judge
from viario.llm.runs import find_runs
from viario.llm.scoring import score_documents
from viario.llm.simhash import near_duplicates
from viario.llm.substrings import remove_repeated
from viario.llm.toxicity import learn_toxicity, score_toxicity

cloudpickle.register_pickle_by_value(sys.modules[__name__])

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(function):
        QUERIES[name] = function
        if sql is not None:
            SQL[name] = sql
        return function

    return keep


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def fold(n: int):
    """The fold of a document: crc32 of its id as text, modulo n."""
    return F.crc32(F.col("doc_id").cast("string")) % n


DECONTAMINATE_SQL = r"""
WITH doc AS (
  SELECT doc_id, list_filter(regexp_split_to_array(lower_az(text), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS words
  FROM documents),
item AS (
  SELECT item_id, list_filter(regexp_split_to_array(lower_az(text), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS words
  FROM benchmark),
win AS (
  SELECT DISTINCT item_id, words[s : s + 9] AS w FROM (
    SELECT item_id, words, unnest(range(1, greatest(len(words) - 9, 1) + 1)) AS s FROM item WHERE len(words) > 0)),
sizes AS (SELECT DISTINCT len(w) AS n FROM win),
place AS (
  SELECT doc_id, s, n, words[s : s + n - 1] AS w FROM (
    SELECT doc_id, words, n, unnest(range(1, len(words) - n + 2)) AS s FROM doc, sizes WHERE len(words) >= n)),
hit AS (SELECT doc_id, s, n, item_id FROM place JOIN win USING (w)),
covered AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (
    SELECT doc_id, unnest(range(s, s + n)) AS p FROM (SELECT DISTINCT doc_id, s, n FROM hit)) GROUP BY doc_id),
named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hit) GROUP BY doc_id)
SELECT doc_id, coalesce(len(words), 0) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)""".replace(
    "lower_az(text)", "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")


@query("op2_decontaminate", DECONTAMINATE_SQL)
def op2_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    rows = find_contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"), keep=["doc_id"])
    return rows.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


@query("op6_language")
def op6_language(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "documents").select("doc_id", "text", "lang", F.coalesce(fold(4) == 2, F.lit(False)).alias("held_out"))
    dictionaries = learn_dictionaries(rows.where("NOT held_out AND doc_id IS NOT NULL"))
    return identify(rows, dictionaries, keep=["doc_id", "held_out"])


@query("op1_pack")
def op1_pack(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "documents").select(
        "doc_id", word_count(F.col("text")).alias("length"), "source", copy_cluster(F.col("text")).alias("cluster"))
    return pack(rows, keep=["doc_id"])


@query("op4_simhash")
def op4_simhash(spark: SparkSession, folder: str) -> DataFrame:
    rows = near_duplicates(table(spark, folder, "documents"))
    digits = F.lpad(F.lower(F.hex("fingerprint")), 16, "0")
    return rows.select("doc_id", digits.alias("fingerprint"), "component_id")


CHAT_SQL = r"""
WITH all_turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
escaped AS (
  SELECT *, replace(replace(replace(text, '\', '\\'), '###', '\###'), '</turn>', '\</turn>') AS body,
    replace(replace(replace(replace(role, '\', '\\'), '###', '\###'), '</turn>', '\</turn>'), ':', '\:') AS head
  FROM all_turns)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(4 + length(head) + 2 + length(body) + 8) AS BIGINT) AS formatted_chars
FROM escaped GROUP BY conv_id"""


@query("op8_chat", CHAT_SQL)
def op8_chat(spark: SparkSession, folder: str) -> DataFrame:
    columns = ["conv_id", "turn", "role", "text"]
    said = F.lit("\\### Assistant: </turn> ok")
    odd = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text"))
    rows = table(spark, folder, "conversations").select(columns).union(odd)
    with open(TOKENIZER, encoding="utf-8") as file:
        made = format_conversations(rows, file.read())
    schema = made.select("conv_id", "n_turns").schema.add("turns_sha256", "string").add("loss_chars", "long").add(
        "loss_sha256", "string").add("formatted_chars", "long")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                turns = read_turns(row["formatted"])
                spans = [(s["start"], s["stop"]) for s in row["spans"]]
                loss = masked_text(row["formatted"], spans, row["token_starts"], row["token_stops"], row["loss_mask"])
                said = "".join(f"{who}\n{text}\n" for who, text in turns)
                out.append((row["conv_id"], len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss),
                            hashlib.sha256(loss.encode()).hexdigest(), len(row["formatted"])))
            names = [f.name for f in schema.fields]
            kinds = [batch.schema.field("conv_id").type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([o[i] for o in out], kind) for i, kind in enumerate(kinds)], names)

    return made.mapInArrow(digest, schema)


SUBSTRINGS_SQL = r"""
WITH doc AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words
  FROM documents),
place AS (
  SELECT doc_id, s, md5(array_to_string(words[s : s + 34], ' ')) AS w FROM (
    SELECT doc_id, words, unnest(range(1, len(words) - 33)) AS s FROM doc WHERE len(words) >= 35)),
often AS (SELECT w FROM place GROUP BY w HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 35)) AS p FROM place SEMI JOIN often USING (w)),
word AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS p FROM doc),
left_over AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS text FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id),
removed AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT doc_id, len(words) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM doc LEFT JOIN left_over USING (doc_id) LEFT JOIN removed USING (doc_id)"""


@query("op9_substrings", SUBSTRINGS_SQL)
def op9_substrings(spark: SparkSession, folder: str) -> DataFrame:
    return remove_repeated(table(spark, folder, "documents").select("doc_id", "text"), digest=True)


@query("op3_quality")
def op3_quality(spark: SparkSession, folder: str) -> DataFrame:
    return judge(table(spark, folder, "documents"), keep=["doc_id"]).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")


_TEMPLATE_ROWS = ", ".join(
    "(" + ", ".join("'" + part.replace("'", "''") + "'" for part in (name, text)) + ")"
    for name, texts in TEMPLATES.items() for text in texts)
LICENSES_SQL = rf"""
WITH text AS (
  SELECT 'doc' AS kind, doc_id, NULL AS license, text FROM documents
  UNION ALL SELECT 'template', NULL, column0, column1 FROM (VALUES {_TEMPLATE_ROWS}) AS v(column0, column1)),
words AS (
  SELECT *, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'),
    lambda w: w <> '') AS ws FROM text),
shingled AS (
  SELECT kind, doc_id, license, text, list_transform(range(1, greatest(len(ws) - 4, 1) + 1),
    lambda i: array_to_string(ws[i : i + 4], ' ')) AS own FROM words WHERE len(ws) > 0),
template AS (SELECT license, text, own, len(own) AS n FROM shingled WHERE kind = 'template'),
flagged AS (
  SELECT DISTINCT doc_id, own FROM shingled WHERE kind = 'doc'
    AND list_has_any(own, (SELECT flatten(list(own)) FROM template))),
cut AS (
  SELECT DISTINCT doc_id, own, n, unnest(list_append(range(0, greatest(len(own) - n, 0) + 1, greatest(n // 4, 1)),
    greatest(len(own) - n, 0))) AS start FROM flagged, (SELECT DISTINCT n FROM template)),
window_ AS (SELECT doc_id, n, start, list_distinct(own[start + 1 : start + n + n // 4]) AS own FROM cut),
hit AS (
  SELECT doc_id, license, n, start,
    CAST(len(list_intersect(w.own, t.own)) AS DOUBLE) / len(list_distinct(t.own)) AS containment
  FROM window_ w JOIN template t USING (n) WHERE list_has_any(w.own, t.own)),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id, license ORDER BY containment DESC, start, n DESC) AS r
  FROM hit WHERE containment >= 0.8)
SELECT doc_id, license, containment, CAST(start AS BIGINT) AS start, CAST(n AS BIGINT) AS n_shingles FROM ranked WHERE r = 1"""


@query("op10_licenses", LICENSES_SQL)
def op10_licenses(spark: SparkSession, folder: str) -> DataFrame:
    return scan(table(spark, folder, "documents"), template_table(spark))


@query("op5_scoring")
def op5_scoring(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "documents").select("doc_id", "text", F.coalesce(fold(10) == 0, F.lit(False)).alias("held_out"))
    return score_documents(rows, ~F.col("held_out"), keep=["doc_id", "held_out"])


@query("op7_toxicity")
def op7_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "documents").select("doc_id", "text", F.coalesce(fold(4) == 2, F.lit(False)).alias("held_out"))
    net = learn_toxicity(rows.where("NOT held_out AND doc_id IS NOT NULL"), table(spark, folder, "labels"))
    return score_toxicity(rows, net, keep=["doc_id", "held_out"]).withColumn(
        "predicted", F.when(F.col("score") >= 0.3, 1).otherwise(0))


EXACT_SQL = r"""
WITH doc AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
  row_number() OVER (PARTITION BY t ORDER BY doc_id) = 1 AS kept, sha256(t) AS text_sha256
FROM doc"""


@query("op11_exact", EXACT_SQL)
def op11_exact(spark: SparkSession, folder: str) -> DataFrame:
    return exact_duplicates(table(spark, folder, "documents"), keep=["doc_id"])


DIVERGENCE_SQL = r"""
WITH doc AS (
  SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x40\x5B-\x60\x7B-\x7F]+'),
    lambda w: w <> '') AS words FROM documents),
word AS (SELECT i, lang, source, unnest(words) AS term FROM doc),
cell AS (SELECT lang, source, term, count(*) AS c, count(DISTINCT i) AS d FROM word GROUP BY ALL),
vocabulary AS (SELECT lang, term, sum(c) AS c FROM cell GROUP BY ALL HAVING sum(d) >= 30),
size AS (SELECT lang, count(*) AS v, sum(c) AS n FROM vocabulary GROUP BY lang),
grp AS (SELECT DISTINCT lang, source FROM doc),
total AS (SELECT lang, source, sum(cell.c) AS n FROM cell JOIN vocabulary USING (lang, term) GROUP BY ALL),
share AS (
  SELECT g.lang, g.source, t.term, coalesce(cell.c, 0) AS c,
    1 + CAST(floor((1000000000::HUGEINT * (coalesce(cell.c, 0) + 5)) // (coalesce(total.n, 0) + 5 * size.v)::HUGEINT) AS BIGINT) AS p,
    1 + CAST(floor((1000000000::HUGEINT * (t.c + 5)::HUGEINT) // (size.n + 5 * size.v)::HUGEINT) AS BIGINT) AS q
  FROM grp g JOIN vocabulary t ON g.lang = t.lang JOIN size ON size.lang = g.lang
  LEFT JOIN cell ON cell.lang = g.lang AND cell.source = g.source AND cell.term = t.term
  LEFT JOIN total ON total.lang = g.lang AND total.source = g.source),
pair AS (
  SELECT a.lang, a.source, b.source AS item, CAST(sum(abs(a.p - b.p)) AS BIGINT) AS value
  FROM share a JOIN share b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
named AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(pair.value, 0) AS value
  FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pair ON pair.lang = a.lang AND pair.source = a.source AND pair.item = b.source
  UNION ALL SELECT lang, source, 'term', term, p - q FROM share WHERE c > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank FROM named)
WHERE part = 'pair' OR rank <= 50"""


@query("op12_divergence", DIVERGENCE_SQL)
def op12_divergence(spark: SparkSession, folder: str) -> DataFrame:
    return divergence(table(spark, folder, "documents"))


# crc32 bit by bit: a number is a byte of the id, -1 one step.
_CRC_SQL = """xor(4294967295, list_reduce(list_concat([4294967295], flatten(list_transform(range(1, length(CAST(doc_id AS VARCHAR)) + 1),
    lambda k: [ascii(CAST(doc_id AS VARCHAR)[k]), -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda a, b: CASE WHEN b >= 0 THEN xor(a, b) ELSE xor(a >> 1, 3988292384 * (a & 1)) END))"""
RUNS_SQL = rf"""
WITH doc AS (
  SELECT doc_id, {_CRC_SQL} AS h, list_filter(regexp_split_to_array(coalesce(text, ''), '[ 	-
]+'), lambda w: w <> '') AS own
  FROM documents),
placed AS (SELECT *, len(own) AS n, (h // 10) % greatest(len(own), 1) AS a, 3 + (h // 10) % 8 AS e FROM doc),
changed AS (
  SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0
    THEN list_transform(range(0, n), lambda i: own[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // e) END]) ELSE own END AS words
  FROM placed),
word AS (SELECT doc_id, n, unnest(words) AS w, unnest(range(0, n)) AS i FROM changed),
same AS (
  SELECT a.doc_id, b.i - a.i AS q, a.i FROM word a JOIN word b ON a.doc_id = b.doc_id AND a.w = b.w AND b.i > a.i AND 3 * (b.i - a.i) <= a.n),
island AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS g FROM same),
stretch AS (SELECT doc_id, q, min(i) AS s, count(*) + q AS l FROM island GROUP BY doc_id, q, g HAVING count(*) + q >= greatest(24, 3 * q)),
run AS (SELECT doc_id, s, l, min(q) AS q FROM stretch GROUP BY doc_id, s, l),
listed AS (
  SELECT doc_id, count(*) AS n_runs, string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q) AS lines FROM run GROUP BY doc_id),
best AS (
  SELECT a.doc_id, a.s, a.l, a.q FROM run a WHERE NOT EXISTS (
    SELECT 1 FROM run b WHERE b.doc_id = a.doc_id AND (b.l * a.q > a.l * b.q OR (b.l * a.q = a.l * b.q AND (b.s < a.s OR (b.s = a.s AND b.q < a.q)))))),
gone AS (SELECT DISTINCT doc_id, unnest(range(s + q, s + l)) AS i FROM run),
stays AS (SELECT doc_id, string_agg(w, ' ' ORDER BY i) AS text FROM word ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, s AS start, l AS length, q AS period, 1000 * l // q AS exponent_milli,
  sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(text, '')) AS collapsed_sha256
FROM doc LEFT JOIN listed USING (doc_id) LEFT JOIN best USING (doc_id) LEFT JOIN stays USING (doc_id)"""


def with_planted_runs(documents: DataFrame) -> DataFrame:
    """Every tenth text by the hash of its id becomes periodic from some word on."""
    h = F.crc32(F.col("doc_id").cast("string"))
    inner = F.btrim("text", F.lit(" \t\n\x0b\x0c\r"))
    chosen = (h % 10 == 0) & (inner != "")
    rows = documents.withColumns({"g": F.floor(h / 10), "w": F.when(chosen, F.split(inner, r"[\x20\x09-\x0D]+"))})
    rows = rows.withColumns({"n": F.size("w").cast("long"), "a": F.col("g") % F.size("w")})
    rows = rows.withColumn("p", F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)) + 1)
    index = F.transform(F.sequence(F.lit(0).cast("long"), F.col("n") - 1), lambda i: F.when(
        i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p")).cast("int"))
    changed = F.array_join(F.transform(index, lambda i: F.get("w", i)), " ")
    return rows.select("doc_id", F.when(F.col("w").isNotNull(), changed).otherwise(F.col("text")).alias("text"))


@query("op13_runs", RUNS_SQL)
def op13_runs(spark: SparkSession, folder: str) -> DataFrame:
    rows = with_planted_runs(table(spark, folder, "documents").select("doc_id", "text"))
    return find_runs(rows, keep=["doc_id"], digest=True).drop("n_words")
