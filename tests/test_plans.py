"""What the physical plans must and must not contain."""

from pyspark.sql import functions as F

from registry.tables import series
from tests.compare import plan_of
from viario.operators.detect.series import detect_along_series
from viario.storage import drop_tables, materialise

FOLDER = "/root/testdata/sf0.001"


def test_series_detectors_share_one_sort(spark):
    plan = plan_of(detect_along_series(series(spark, FOLDER), row_id=["event_id"]))
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("+- Sort ") == 1


def test_scan_is_pruned_and_filtered(spark):
    rows = spark.read.parquet(f"{FOLDER}/lineitem.parquet").where(F.col("l_quantity") > 10).select("l_suppkey")
    plan = plan_of(rows)
    assert "GreaterThan(l_quantity,10.0)" in plan
    assert "ReadSchema: struct<l_suppkey:bigint,l_quantity:double>" in plan


def test_tables_can_be_dropped(spark, monkeypatch):
    import viario.storage as storage

    monkeypatch.setattr(storage, "_tables", [])
    table = materialise(spark.range(3), "kept")
    assert table.count() == 3 and drop_tables(spark) == 1 and drop_tables(spark) == 0
