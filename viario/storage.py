"""Tables written once and read by several later steps."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

_tables: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables: the checkpoint folder that the cluster names, else one in the warehouse."""
    folder = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/viario-tables"
    return folder.rstrip("/")


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write the table to the shared folder and go on from the files.

    Later steps that read it several times then see the same rows even when the
    executors that made them are gone, and column pruning works on it.
    """
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not _tables:
        atexit.register(_drop_at_end, df.sparkSession)
    _tables.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_tables(spark: SparkSession) -> int:
    """Delete the intermediate tables of this program, once no result is needed any more."""
    for path in _tables:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    count = len(_tables)
    _tables.clear()
    return count


def _drop_at_end(spark: SparkSession) -> None:
    """When the program ends with its session still there, its tables go too."""
    try:
        if spark.sparkContext._jsc is not None:
            drop_tables(spark)
    except Exception:  # the Java side may be gone already
        _tables.clear()


def path_exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)
