"""Cleaning files as they arrive: the chunked reader as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from viario.operators.cleaning import change_log, clean_columns


def read_csv_stream(spark: SparkSession, folder: str, schema: str, separator: str = ",", files_at_once: int | None = None) -> DataFrame:
    """New CSV files of a folder, all columns with the given types; `files_at_once` bounds a batch."""
    bound = {} if files_at_once is None else {"maxFilesPerTrigger": files_at_once}
    return spark.readStream.schema(schema).options(header=True, sep=separator, escape='"', **bound).csv(folder)


def clean_stream(
    rows: DataFrame, columns: list[str], target: str, progress: str
) -> StreamingQuery:
    """Clean what has arrived and stop; `progress` remembers which files are done."""
    return (
        clean_columns(rows, columns).writeStream.format("parquet")
        .option("path", target).option("checkpointLocation", progress)
        .trigger(availableNow=True).start()
    )


def clean_stream_with_log(
    rows: DataFrame, columns: list[str], position: str, file: str, target: str, log: str, progress: str
) -> StreamingQuery:
    """Clean what has arrived, with the log of every changed cell; `position` names a column that numbers the rows.

    Each batch goes to a folder of its own number, under `target` and under `log`. A batch that
    is run again after a failure replaces its own folders, so rows and changes are there once."""
    def write(batch: DataFrame, number: int) -> None:
        clean_columns(batch, columns).write.mode("overwrite").parquet(f"{target}/lote={number}")
        change_log(batch, columns, file, position).write.mode("overwrite").parquet(f"{log}/lote={number}")

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", progress).trigger(availableNow=True).start()
