"""Stored mergeable figures against the measurements they came from."""

import random

import pytest
from pyspark.sql import functions as F

from viario.operators import sketches
from viario.operators.features import apply_filters
from viario.streaming.text_stream import clean_stream_with_log, read_csv_stream


@pytest.fixture(scope="module")
def facts(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["A", "A", "A", "B", None]), f"c{rng.randrange(9)}", rng.choice(["manana", "tarde"]), rng.randrange(1, 8),
             rng.choice([None, float("nan"), rng.gauss(30, 10), rng.gauss(30, 10), rng.gauss(60, 1)]), rng.randrange(5000)) for _ in range(8000)]
    rows.append(("B", "sola", "noche", 1, None, 1))
    return spark.createDataFrame(rows, "nombre_comuna string, corredor string, franja_horaria string, dia_num int, velocidad_km_h double, sensor int")


def test_merged_figures(spark, facts, tmp_path):
    cells = sketches.store_cells(facts, str(tmp_path / "cells"), distinct=["sensor", "nada"])
    for by, options in (["nombre_comuna"], {}), (["corredor", "franja_horaria"], {"communes": ["A"], "day": "Martes"}), ([], {"slot": "tarde"}):
        got = sketches.merged_report(cells, by, {"p10": 0.1, "p50": 0.5, "p95": 0.95}, **options)
        value = F.when(~F.isnan("velocidad_km_h"), F.col("velocidad_km_h"))
        chosen = apply_filters(facts, options.get("communes"), None, options.get("slot"), options.get("day"))
        exact = {tuple(r[k] for k in by): r for r in chosen.groupBy(*by).agg(
            F.count("*").alias("n"), F.count(value).alias("m"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"),
            F.min(value).alias("low"), F.max(value).alias("high"), F.collect_list(value).alias("all"),
            F.count_distinct("sensor").alias("sensors")).collect()}
        found = got.collect()
        assert {tuple(r[k] for k in by) for r in found} == set(exact)
        for r in found:
            want = exact[tuple(r[k] for k in by)]
            assert (r.n, r.velocidad_km_h_n, r.velocidad_km_h_min, r.velocidad_km_h_max) == (want.n, want.m, want.low, want.high)
            if want.m == 0:
                assert r.velocidad_km_h_media is None and r.velocidad_km_h_p50 is None
                continue
            assert r.velocidad_km_h_media == pytest.approx(want["mean"]) and r.sensor_distintos == pytest.approx(want.sensors, rel=0.08, abs=1)
            if want.m > 1:
                assert r.velocidad_km_h_std == pytest.approx(want["std"], rel=1e-6, abs=1e-6)
            for name, p in (("p10", 0.1), ("p50", 0.5), ("p95", 0.95)):
                at = sum(v <= r[f"velocidad_km_h_{name}"] for v in want["all"]) / want.m
                assert abs(at - p) <= 0.05 + 1 / want.m


def test_reports_read_cells_once_and_no_facts(facts):
    cells = sketches.store_cells(facts, distinct=["sensor"])
    lattice = sketches.report_lattice(cells)
    plan = lattice._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("Expand") == 1
    assert all("sketch-cells" in file for file in lattice.inputFiles())
    for by in (["corredor"], ["nombre_comuna", "franja_horaria"], []):
        got = {tuple(r[k] for k in by): (r.n, r.velocidad_km_h_n) for r in sketches.lattice_view(lattice, by).collect()}
        value = F.when(~F.isnan("velocidad_km_h"), F.col("velocidad_km_h"))
        want = {tuple(r[k] for k in by): (r.n, r.m) for r in facts.groupBy(*by).agg(F.count("*").alias("n"), F.count(value).alias("m")).collect()}
        assert got == want


def test_cells_of_little(spark, facts):
    assert sketches.sketch_cells(facts.limit(0)).count() == 0
    bare = sketches.sketch_cells(facts.select("corredor", "sensor"))
    assert bare.columns == ["corredor", "n"] and sketches.merged_report(bare, ["corredor"]).count() == 10


def test_a_batch_run_again_is_there_once(spark, tmp_path):
    """A failure between the rows and the log of a batch, then a restart."""
    (tmp_path / "in").mkdir()
    for i in range(4):
        (tmp_path / "in" / f"{i}.csv").write_text("k,t\n" + "".join(f'{10 * i + j},"\x01x{j}"\n' for j in range(3)) + f"{10 * i + 9},plain\n")
    paths = {name: str(tmp_path / name) for name in ("out", "log", "progress")}

    def start(rows, columns):
        return clean_stream_with_log(rows, columns, "k", "f.csv", paths["out"], paths["log"], paths["progress"])

    stream = read_csv_stream(spark, str(tmp_path / "in"), "k bigint, t string", files_at_once=1)
    broken = stream.withColumn("t", F.when(F.col("k") == 11, F.raise_error(F.lit("lost"))).otherwise(F.col("t")).cast("string"))
    with pytest.raises(Exception):
        start(broken, ["t"]).awaitTermination()
    left = {p.parent.name for p in (tmp_path / "out").rglob("*.parquet")}
    assert "lote=0" in left and not (tmp_path / "log" / "lote=3").exists()
    (tmp_path / "out" / "lote=1").mkdir(exist_ok=True)     # as if the rows of the batch had been written before the failure
    spark.createDataFrame([(10, "old")], "k bigint, t string").write.mode("overwrite").parquet(f"{paths['out']}/lote=1")
    start(stream, ["t"]).awaitTermination()
    rows = spark.read.parquet(paths["out"]).collect()
    log = spark.read.parquet(paths["log"]).collect()
    assert sorted((r.k, r.t) for r in rows) == sorted([(10 * i + j, f"x{j}") for i in range(4) for j in range(3)] + [(10 * i + 9, "plain") for i in range(4)])
    assert sorted((r.fila, r.valor_limpio) for r in log) == sorted((10 * i + j + 2, f"x{j}") for i in range(4) for j in range(3))
