"""One local session for tests and checks."""

import os
import tempfile

from pyspark.sql import SparkSession


def make_session(cores: int = 8) -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cores}]").appName("viario-tests")
        .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "8g")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="viario-", dir=os.environ.get("TMPDIR", "/tmp")))
    return spark
