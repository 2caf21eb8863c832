"""CSV, Parquet and GeoJSON in; CSV and Parquet out."""

from __future__ import annotations

import posixpath

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from viario.functions.numbers import number, restore_booleans
from viario.schema import keep_present
from viario.sources.features import read_collections
from viario.sources.records import read_records
from viario.storage import materialise, path_exists

ROW_NUMBER = "__row_number"
FILE = "__file"


def spread(scan: DataFrame) -> DataFrame:
    """Use all cores for files too few and small to be split into as many parts.

    Takes the plain scan of a source, whose files are listed without running anything; a source
    of more files than cores, or of large ones, is left as it is."""
    spark = scan.sparkSession
    cores = spark.sparkContext.defaultParallelism
    files = scan.inputFiles()
    if len(files) >= cores:
        return scan
    part = 4 << 20
    return scan.repartition(cores) if sum(-(-_size(spark, f) // part) for f in files) < cores else scan


def _size(spark: SparkSession, path: str) -> int:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(target).getLen()


WHOLE = {"tinyint", "smallint", "int", "bigint"}


def _as_kind(name: str, kind: str) -> Column:
    """Numbers by the lenient rules, whole ones cut after the point; other kinds as Spark casts them."""
    c = F.col(f"`{name}`")
    if kind in WHOLE:
        return F.coalesce(c.try_cast(kind), number(c).try_cast(kind))
    return number(c).try_cast(kind) if kind in ("double", "float") else c.try_cast(kind)


def csv_header(spark: SparkSession, path: str, encoding: str = "UTF-8", separator: str = ",") -> list[str]:
    """Column names on the first line."""
    names = spark.read.options(header=True, sep=separator, encoding=encoding).csv(path).columns
    return [n.removeprefix("\ufeff") for n in names]


def detect_encoding(spark: SparkSession, path: str) -> str:
    """UTF-8 when all lines are valid UTF-8, else Latin-1, which fits any byte.

    The text source keeps the bytes of a line as they are, so all executors can look."""
    valid = spark.read.text(path).agg(F.bool_and(F.is_valid_utf8("value"))).first()[0]
    return "UTF-8" if valid in (True, None) else "ISO-8859-1"


def _spark_encoding(name: str) -> str:
    return {"utf-8-sig": "UTF-8", "utf-8": "UTF-8", "latin-1": "ISO-8859-1"}.get(name.lower(), name)


def read_csv(
    spark: SparkSession, path: str, *, encoding: str | None = None, separator: str = ",", row_numbers: bool = False,
    over_files: bool = False,
) -> DataFrame:
    """All columns as text. Records with too many fields are left out (`read_csv_checked` names
    them), short ones are filled with nulls, and empty fields are null. A line break in quotes
    is part of its field. `row_numbers` adds FILE and ROW_NUMBER, which counts records from 0,
    in each file or with `over_files` on from file to file, in the order of their names."""
    names, records = _records(spark, path, encoding, separator, over_files)
    return _rows(records, names, row_numbers)


def read_csv_checked(
    spark: SparkSession, path: str, *, encoding: str | None = None, separator: str = ",", row_numbers: bool = False,
) -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """The rows of `read_csv`, the rejected records with reason and number, and how many of each.

    The files are read once into a table, and counted while it is written."""
    names, records = _records(spark, path, encoding, separator)
    seen = Observation()
    counted = records.where("__record > 0").observe(
        seen, F.count_if(F.col("reason").isNull()).alias("rows"), F.count("reason").alias("rejected"))
    table = materialise(counted, "csv-checked")
    rejected = table.where("reason IS NOT NULL").select(
        F.col("__file").alias("archivo"), (F.col("__record") - 1).alias("registro"),
        F.col("reason").alias("motivo"), F.col("text").alias("texto"))
    return _rows(table, names, row_numbers), rejected, seen.get


def _records(
    spark: SparkSession, path: str, encoding: str | None, separator: str, over_files: bool = False,
) -> tuple[list[str], DataFrame]:
    charset = detect_encoding(spark, path) if encoding is None else _spark_encoding(encoding)
    names = csv_header(spark, path, charset, separator)
    return names, read_records(spark, path, charset, separator, len(names), over_files=over_files)


def _rows(records: DataFrame, names: list[str], row_numbers: bool) -> DataFrame:
    kept = records.where((F.col("__record") > 0) & F.col("reason").isNull())
    place = [F.col("__file").alias(FILE), (F.col("__record") - 1).alias(ROW_NUMBER)] if row_numbers else []
    return kept.select(*[F.nullif(F.get("fields", F.lit(i)), F.lit("")).alias(n) for i, n in enumerate(names)], *place)


def load_dataset(spark: SparkSession, config: dict, key: str, **options) -> DataFrame | None:
    """A registered raw file; nothing when it is absent."""
    path = posixpath.join(config["paths"]["raw"], config["files"][key])
    return read_csv(spark, path, **options) if path_exists(spark, path) else None


def read_table(spark: SparkSession, path: str) -> DataFrame:
    if path.endswith(".csv"):
        return read_csv(spark, path, encoding="UTF-8")
    return spark.read.parquet(path)


def read_columns(
    spark: SparkSession, path: str, columns: dict[str, str], booleans: list[str] | None = None
) -> DataFrame | None:
    """The wanted columns that exist, with their types; the scan reads no others."""
    if not path_exists(spark, path):
        return None
    table = keep_present(read_table(spark, path), columns)
    flags = [b for b in booleans or [] if b in table.columns]
    kinds = {n: k for n, k in columns.items() if n in table.columns and n not in flags}
    cast = table.withColumns({n: _as_kind(n, k) for n, k in kinds.items()}) if kinds else table
    return restore_booleans(cast, flags)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header in every part, quotes only where needed; white space stays as it is."""
    df.write.mode("overwrite").options(
        header=True, escape='"', emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
    ).csv(path)


def write_table(df: DataFrame, path: str, **options) -> DataFrame:
    """Write Parquet and go on from the files."""
    df.write.mode("overwrite").options(**options).parquet(path)
    return df.sparkSession.read.parquet(path)


FEATURE = (
    "type string, properties map<string,string>, geometry struct<type string, coordinates string>"
)


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """Features of GeoJSON: collections, one per file, or one feature per line (.geojsonl).

    Both are read in parts by all tasks. Coordinates stay text until the geometry type is
    known; `feature_id` rises in the order of files and features. Of a collection that ends
    too early the last, open feature is left out."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], FEATURE).withColumn("feature_id", F.lit(0).cast("bigint"))
    if path.endswith((".geojsonl", ".jsonl", ".ndjson")):
        return spark.read.schema(FEATURE).json(path).withColumn("feature_id", F.monotonically_increasing_id())
    parsed = read_collections(spark, path).select(
        F.from_json("text", FEATURE).alias("feature"),
        F.shiftleft("__block", 32).bitwiseOR(F.col("__index")).alias("feature_id"))
    return parsed.select("feature.*", "feature_id")


def read_or_compute(spark: SparkSession, path: str, compute) -> DataFrame:
    """The table at a path; computed and written first when it is not there."""
    if not path_exists(spark, path):
        write_table(compute(), path)
    return read_table(spark, path)


