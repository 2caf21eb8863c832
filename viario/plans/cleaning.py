"""Cleaning the registered CSV files, with a change log and metrics."""

from __future__ import annotations

import posixpath
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from viario.config import CLEANED_FILES
from viario.operators.cleaning import LOG_SCHEMA, change_log, clean_columns, text_columns
from viario.sources.files import FILE, ROW_NUMBER, read_csv_checked, write_csv
from viario.storage import materialise, path_exists

NOTHING = {"filas_procesadas": 0, "celdas_modificadas": 0, "columnas_limpias": [], "registros_rechazados": 0}
REJECTED_SCHEMA = "archivo string, registro bigint, motivo string, texto string"


class CsvCleaner:
    """Cleans the text columns of the registered files; `dry_run` writes nothing."""

    def __init__(
        self, spark: SparkSession, raw_dir: str, clean_dir: str, log_path: str,
        dry_run: bool = False, files: dict[str, dict] | None = None,
    ):
        self.spark, self.raw_dir, self.clean_dir = spark, str(raw_dir), str(clean_dir)
        self.log_path, self.dry_run = str(log_path), dry_run
        self.files = CLEANED_FILES if files is None else files
        self._logs: list[DataFrame] = []
        self._rejected: list[DataFrame] = []

    def log(self) -> DataFrame:
        """All changes so far."""
        none = self.spark.createDataFrame([], LOG_SCHEMA)
        return reduce(lambda a, b: a.unionByName(b), self._logs, none)

    def rejected(self) -> DataFrame:
        """All records that could not be read so far: file, number of the record, reason, text."""
        none = self.spark.createDataFrame([], REJECTED_SCHEMA)
        return reduce(lambda a, b: a.unionByName(b), self._rejected, none)

    def clean_file(self, key: str) -> dict:
        """Clean one file and return its metrics."""
        if key not in self.files:
            raise ValueError(f"unknown file '{key}', choose from {list(self.files)}")
        spec = self.files[key]
        source = posixpath.join(self.raw_dir, spec["filename"])
        if not path_exists(self.spark, source):
            return dict(NOTHING)
        table, rejected, counts = read_csv_checked(
            self.spark, source, encoding=spec["encoding"], separator=spec["separator"], row_numbers=True,
        )
        self._rejected.append(rejected.withColumn("archivo", F.lit(spec["filename"])))
        names = spec.get("text") or text_columns(table.drop(FILE, ROW_NUMBER))
        changes, seen = change_log(table, names, spec["filename"], ROW_NUMBER), Observation()
        per_column = {f"c{i}": n for i, n in enumerate(names)}
        if names:
            changes = changes.observe(seen, *[F.count_if(F.col("columna") == n).alias(c) for c, n in per_column.items()])
        self._logs.append(materialise(changes, "cleaning-log"))
        if not self.dry_run:
            cleaned = clean_columns(table.drop(FILE, ROW_NUMBER), names)
            write_csv(cleaned, posixpath.join(self.clean_dir, spec["filename"]))
        touched = {n: seen.get[c] for c, n in per_column.items() if seen.get[c]}
        return {
            "filas_procesadas": counts["rows"],
            "celdas_modificadas": sum(touched.values()),
            "columnas_limpias": sorted(touched),
            "registros_rechazados": counts["rejected"],
        }

    def clean_all(self, keys: list[str] | None = None) -> dict[str, dict]:
        """Clean several files; one that fails does not stop the others."""
        results = {}
        for key in keys or list(self.files):
            try:
                results[key] = self.clean_file(key)
            except (ValueError, PySparkException, Py4JJavaError) as error:
                results[key] = {"error": str(error)}
        if self._logs and not self.dry_run:
            write_csv(self.log(), self.log_path)
        return results

    def summary(self, results: dict[str, dict]) -> DataFrame:
        """Rows and changed cells per file with a total."""
        rows = [(k, m["filas_procesadas"], m["celdas_modificadas"])
                for k, m in results.items() if "error" not in m]
        table = self.spark.createDataFrame(
            rows, "archivo string, filas_procesadas bigint, celdas_modificadas bigint"
        )
        totals = table.rollup("archivo").agg(
            F.sum("filas_procesadas").alias("filas_procesadas"),
            F.sum("celdas_modificadas").alias("celdas_modificadas"),
        )
        return totals.withColumn("archivo", F.coalesce("archivo", F.lit("TOTAL")))
