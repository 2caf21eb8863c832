"""A corpus made ready for training: five stages, each with one operator of viario.llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from viario.llm.decontaminate import find_contamination
from viario.llm.language import identify, learn_dictionaries
from viario.llm.packing import copy_cluster, pack, word_count
from viario.llm.simhash import keep_one
from viario.llm.substrings import remove_repeated
from viario.storage import materialise


def _numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """The columns under neutral names, so that none clashes with an operator's, and the name of the text."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    return docs.toDF(*names), names[docs.columns.index("text")]


def _named(rows: DataFrame, docs: DataFrame) -> DataFrame:
    return rows.select([f"c{i}" for i in range(len(docs.columns))]).toDF(*docs.columns)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with a clear margin; texts without letters go."""
    rows, text = _numbered(docs)
    found = identify(rows, learn_dictionaries(docs), text, keep=rows.columns)
    return _named(found.where(~F.col("rejected")), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return keep_one(docs)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 35 words or more that stand in several places.

    A text that loses words becomes its other words, joined by single spaces, and n_chars its
    new length; others stay as they are. Documents that lose all their words go.
    """
    rows, text = _numbered(docs)
    found = remove_repeated(rows, text).where("n_removed = 0 OR n_removed < n_words")
    cut = F.col("n_removed") > 0
    new = {text: F.when(cut, F.col("kept_text")).otherwise(F.col(text))}
    if "n_chars" in docs.columns:
        count = f"c{docs.columns.index('n_chars')}"
        new[count] = F.when(cut, F.length("kept_text")).otherwise(F.col(count)).cast(rows.schema[count].dataType)
    return _named(found.withColumns(new), docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of a benchmark item."""
    rows, text = _numbered(docs)
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _named(find_contamination(rows, items, text, keep=rows.columns).where("n_hit = 0"), docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The bin and place of every piece of every document."""
    text = F.col("text")
    rows = docs.select("doc_id", word_count(text).alias("length"), "source", copy_cluster(text).alias("cluster"))
    return pack(rows, keep=["doc_id"])


STAGES = [
    ("language ID", language),
    ("SimHash near-dedup", near_duplicates),
    ("substring dedup", substrings),
    ("benchmark decontamination", benchmark),
    ("best-fit packing", packing),
]
ORACLE_SQL = None  # compression, automata and best-fit cannot be said in SQL; tests/llm/test_pipeline.py has brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages from documents on, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
