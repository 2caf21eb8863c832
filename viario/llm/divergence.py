"""How the sources of a language differ in their words.

Equal texts of a language are collapsed first, with their number per source, so that each is
cut into terms once; its document frequencies and counts are added with these weights. Smoothed
shares are whole numbers, one for each term that a group holds and one for all it does not.
The distance of two sources is therefore summed over the terms that occur in them:

    sum |p - q| = sum over terms of one |p - q0| + sum over terms of the other |q - p0|
                + sum over common terms (|p - q| - |p - q0| - |q - p0| + |p0 - q0|)
                + |p0 - q0| * (V - terms of one - terms of the other)

where p0 and q0 are the shares of a term that does not occur.
"""

from __future__ import annotations

import sys
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import Column, DataFrame, Window, functions as F

from viario.llm.exact import TextTable
from viario.storage import materialise

cloudpickle.register_pickle_by_value(sys.modules[__name__])

MIN_DOCUMENTS = 30
SMOOTHING = 5
SCALE = 1_000_000_000
TOP_TERMS = 50
TABLE_BYTES = 16 << 20   # different texts collapsed together in a task
SUM_ENTRIES = 800_000    # (lang, source, term) sums that a task holds before it sends them
TASKS_TOGETHER = 1000    # tasks whose copies of a text meet; beyond, a text is cut once per so many tasks
_LETTERS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))


def terms(text: bytes) -> list[bytes]:
    """Runs of ASCII letters and other non-ASCII characters, with A-Z lower-cased."""
    return text.translate(_LETTERS).split()


class _Texts(TextTable):
    """Different (lang, text) with the number of rows per source."""

    def __init__(self):
        super().__init__()
        self.sources: list[dict[str, int]] = []
        self.langs: list[str] = []

    def count(self, h: int, lang: str, text: bytes, source: str, n: int) -> None:
        key = lang.encode()
        key = len(key).to_bytes(4, "big") + key + text
        slot = self.slot(h, key)
        entry = self.slots[slot]
        if entry < 0:
            entry = self.add(slot, h, key)
            self.sources.append({})
            self.langs.append(lang)
        own = self.sources[entry]
        own[source] = own.get(source, 0) + n

    def text(self, entry: int) -> bytes:
        return self.texts[entry][4 + len(self.langs[entry].encode()):]


def _collapse(rows: DataFrame, table_bytes: int) -> DataFrame:
    """Rows (lang, source, text) to (h, task, lang, text, sources, counts), one for each text of a table."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        task, table = TaskContext.get().partitionId(), _Texts()

        def out() -> pa.RecordBatch:
            n = len(table.texts)
            return pa.RecordBatch.from_arrays([
                pa.array(table.hashes, pa.int64()), pa.array([task] * n, pa.int32()), pa.array(table.langs, pa.string()),
                pa.array([table.text(i) for i in range(n)], pa.binary()),
                pa.array([list(s) for s in table.sources], pa.list_(pa.string())),
                pa.array([list(s.values()) for s in table.sources], pa.list_(pa.int64()))],
                ["h", "task", "lang", "text", "sources", "counts"])

        for batch in batches:
            langs, sources, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)
            for i, (lang, source) in enumerate(zip(langs, sources)):
                text = texts[i].as_py()
                table.count(xxhash.xxh64_intdigest(text) - (1 << 63), lang, text, source, 1)
                if table.size > table_bytes:
                    yield out()
                    table = _Texts()
        if table.texts:
            yield out()

    return rows.mapInArrow(run, "h long, task int, lang string, text binary, sources array<string>, counts array<long>")


def _sums(texts: DataFrame, sum_entries: int) -> DataFrame:
    """Rows of _collapse, those of one h together, to partial sums (lang, source, term, n, documents)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple, Counter] = {}
        documents: dict[tuple, Counter] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for (lang, source), own in documents.items():
                names, much = list(own), counts[lang, source]
                for a in range(0, len(names), 50_000):
                    part = names[a:a + 50_000]
                    k = len(part)
                    yield pa.RecordBatch.from_arrays([
                        pa.array([lang] * k, pa.string()), pa.array([source] * k, pa.string()),
                        pa.array([t.decode() for t in part], pa.string()), pa.array([much[t] for t in part], pa.int64()),
                        pa.array([own[t] for t in part], pa.int64())], ["lang", "source", "term", "n", "documents"])
            counts.clear()
            documents.clear()

        def cut(table: _Texts) -> None:
            """The terms of each text, once, for all its sources."""
            for entry, lang in enumerate(table.langs):
                found = terms(table.text(entry))
                once = set(found)
                for source, n in table.sources[entry].items():
                    much, some = counts.setdefault((lang, source), Counter()), documents.setdefault((lang, source), Counter())
                    if n == 1:
                        much.update(found)
                        some.update(once)
                    else:
                        for term, k in Counter(found).items():
                            much[term] += k * n
                            some[term] += n

        here, table, seen = None, _Texts(), 0
        for batch in batches:
            rows = [batch.column(c).to_pylist() for c in ("h", "lang", "sources", "counts")]
            texts = batch.column("text")
            for i, (h, lang, sources, numbers) in enumerate(zip(*rows)):
                if h != here:
                    cut(table)
                    here, table, seen = h, _Texts(), seen + 1
                    if seen % 32 == 0 and sum(map(len, documents.values())) > sum_entries:
                        yield from out()
                text = texts[i].as_py()
                for source, n in zip(sources, numbers):
                    table.count(h, lang, text, source, n)
        cut(table)
        yield from out()

    return texts.mapInArrow(run, "lang string, source string, term string, n long, documents long")


def term_counts(documents: DataFrame, text: str = "text", lang: str = "lang", source: str = "source",
                table_bytes: int = TABLE_BYTES, sum_entries: int = SUM_ENTRIES, tasks_together: int = TASKS_TOGETHER) -> DataFrame:
    """lang, source, term with n occurrences in so many documents; null text, lang and source count as ''."""
    rows = documents.select(
        F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("")).alias("lang"),
        F.coalesce(F.col(f"`{source}`").cast("string"), F.lit("")).alias("source"),
        F.coalesce(F.col(f"`{text}`").cast("binary"), F.lit(b"")).alias("text"))
    texts = _collapse(rows, table_bytes).withColumn("part", F.floor(F.col("task") / tasks_together).cast("int"))
    together = texts.repartition("h", "part").sortWithinPartitions("h")
    return _sums(together, sum_entries).groupBy("lang", "source", "term").agg(
        F.sum("n").alias("n"), F.sum("documents").alias("documents"))


def _share(n: str, total: str, vocabulary: str, smoothing: int, scale: int) -> Column:
    """1 + floor(scale * (n + smoothing) / (total + smoothing * vocabulary)) without overflow."""
    return F.expr(f"1L + (CAST({scale} AS DECIMAL(10, 0)) * CAST({n} + {smoothing} AS DECIMAL(20, 0))) "
                  f"div CAST({total} + {smoothing} * {vocabulary} AS DECIMAL(20, 0))")


def divergence(documents: DataFrame, text: str = "text", lang: str = "lang", source: str = "source",
               min_documents: int = MIN_DOCUMENTS, smoothing: int = SMOOTHING, scale: int = SCALE,
               top_terms: int = TOP_TERMS, **sizes: int) -> DataFrame:
    """lang, source, part, item, value and rank: how far each source is from the others, and by which terms.

    Part `pair`: each other source of the language by falling distance, all of them. Part
    `term`: the terms that a source uses more than its language, `top_terms` at most. Null
    text, lang and source count as ''; groups without a kept term have pairs all the same, with
    distance 0 where the language keeps no term. Repeated rows count each. Other columns of
    the table are not looked at; an empty table gives no rows. The number of pairs is the
    square of the number of sources of a language, which is the report.
    """
    counts = materialise(term_counts(documents, text, lang, source, **sizes), "term-counts")
    vocabulary = materialise(counts.groupBy("lang", "term").agg(
        F.sum("n").alias("lang_n"), F.sum("documents").alias("documents")).where(F.col("documents") >= min_documents), "kept-terms")
    langs = vocabulary.groupBy("lang").agg(F.count("*").alias("v"), F.sum("lang_n").alias("lang_total"))
    held = counts.drop("documents").join(vocabulary.drop("documents"), ["lang", "term"])
    totals = held.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("own"))
    zero = F.lit(0).cast("long")
    groups = documents.select(
        F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("")).alias("lang"),
        F.coalesce(F.col(f"`{source}`").cast("string"), F.lit("")).alias("source")).distinct()
    groups = groups.join(langs, "lang", "left").join(totals, ["lang", "source"], "left").fillna(0, ["v", "total", "own", "lang_total"])
    groups = groups.withColumn("zero", F.when(F.col("v") > 0, _share("0", "total", "v", smoothing, scale)).otherwise(zero))
    groups = materialise(groups, "source-groups")
    cells = held.join(groups, ["lang", "source"]).select(
        "lang", "source", "term", "zero", _share("n", "total", "v", smoothing, scale).alias("p"),
        _share("lang_n", "lang_total", "v", smoothing, scale).alias("q"))
    cells = materialise(cells, "term-shares")

    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    more = cells.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    more = more.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top_terms)

    # Terms of one source against the share of an absent term in each other one: equal shares are counted first.
    shares = cells.groupBy("lang", "source", "p").agg(F.count("*").alias("k"))
    other = groups.select("lang", F.col("source").alias("item"), F.col("zero").alias("other_zero"))
    alone = shares.join(other, "lang").where("source <> item").groupBy("lang", "source", "item").agg(
        F.sum(F.col("k") * F.abs(F.col("p") - F.col("other_zero"))).alias("alone"))
    a, b = cells.drop("q"), cells.select(
        "lang", "term", F.col("source").alias("item"), F.col("p").alias("other_p"), F.col("zero").alias("other_zero"))
    both = a.join(b, ["lang", "term"]).where("source < item").groupBy("lang", "source", "item").agg(F.sum(
        F.abs(F.col("p") - F.col("other_p")) - F.abs(F.col("p") - F.col("other_zero")) - F.abs(F.col("other_p") - F.col("zero"))
        + F.abs(F.col("zero") - F.col("other_zero"))).alias("both"))
    side = groups.select("lang", "source", "v", "zero", "own")
    pairs = side.join(side.select("lang", F.col("source").alias("item"), F.col("zero").alias("other_zero"), F.col("own").alias("other_own")), "lang")
    pairs = pairs.where("source < item").select(
        "lang", "source", "item",
        (F.abs(F.col("zero") - F.col("other_zero")) * (F.col("v") - F.col("own") - F.col("other_own"))).alias("value"))
    turned = alone.select("lang", F.least("source", "item").alias("source"), F.greatest("source", "item").alias("item"), F.col("alone").alias("value"))
    parts = pairs.unionByName(turned).unionByName(both.withColumnRenamed("both", "value"))
    distance = parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    ends = F.array(F.struct(F.col("source").alias("s"), F.col("item").alias("t")), F.struct(F.col("item").alias("s"), F.col("source").alias("t")))
    ranked = distance.select("lang", "value", F.explode(ends).alias("e")).select(
        "lang", F.col("e.s").alias("source"), F.lit("pair").alias("part"), F.col("e.t").alias("item"), "value")
    ranked = ranked.withColumn("rank", F.row_number().over(best))
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return ranked.select(columns).unionByName(more.select(columns))
