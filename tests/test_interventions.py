"""Several quantiles from two reads, and the intervention report from one table of cells."""

import random

import pytest
from pyspark.sql import functions as F

from tests.compare import plan_of
from viario import default_config
from viario.operators.quantiles import quantiles_at_once
from viario.plans import reports


def exact(values, p):
    v = sorted(x for x in values if x is not None and x == x)
    if not v:
        return None
    at = p * (len(v) - 1)
    low = int(at)
    return v[low] + (v[min(low + 1, len(v) - 1)] - v[low]) * (at - low)


@pytest.mark.parametrize("limit", [None, 0, 5])
def test_quantiles_at_once(spark, limit):
    draw = random.Random(4)
    rows = [(draw.gauss(0, 1), float(draw.randint(0, 3)), draw.choice([None, 1.0, float("nan"), draw.random()]), None)
            for _ in range(3000)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double")
    wanted = {"a": (F.col("a"), 0.1), "b": (F.col("b"), 0.5), "c": (F.col("c"), 0.8), "d": (F.col("d"), 0.5), "top": (F.col("a"), 1.0),
              "half": (F.when(F.col("b") > 1, F.col("a")), 0.67)}
    found = df.limit(1).select(*[v.alias(k) for k, v in quantiles_at_once(df, wanted, limit).items()]).first()
    own = {"a": [r[0] for r in rows], "b": [r[1] for r in rows], "c": [r[2] for r in rows], "d": [], "top": [r[0] for r in rows],
           "half": [r[0] for r in rows if r[1] > 1]}
    for name, (_, p) in wanted.items():
        assert found[name] == (None if exact(own[name], p) is None else pytest.approx(exact(own[name], p)))


def test_report_reads_only_cells(spark, tmp_path):
    draw = random.Random(2)
    rows = [(draw.choice(["A", "B", "C", None]), draw.choice(["X", "Y", None]), draw.uniform(5, 60), draw.uniform(0, 900), 1.0,
             draw.uniform(0, 100), 1000, draw.random() < 0.3, draw.random() < 0.3) for _ in range(400)]
    rows += [("D", "X", 10.0, 900.0, 1.0, 90.0, 1000, True, True)]  # at weekends only
    names = "corredor string, nombre_comuna string, velocidad_km_h double, intensidad double, ocupacion double, icv double, poblacion_2019 long, es_fin_semana boolean, es_hora_pico boolean"
    spark.createDataFrame(rows, names).write.parquet(str(tmp_path / "facts-here"))
    facts = spark.read.parquet(str(tmp_path / "facts-here"))
    report = reports.interventions(facts, default_config())
    assert "facts-here" not in plan_of(report)
    got = {r["corredor"]: r for r in report.collect()}
    assert set(got) == {"A", "B", "C"}
    for name, r in got.items():
        own = [x for x in rows if x[0] == name and not x[7]]
        assert r["icv_medio"] == pytest.approx(sum(x[5] for x in own) / len(own)) and r["n_registros"] == len(own)
        assert r["icv_maximo"] == max(x[5] for x in own)
        counts = {c: sum(x[1] == c for x in own) for c in ("X", "Y")}
        assert r["nombre_comuna"] == min(counts, key=lambda c: (-counts[c], c))
        assert r["pct_hora_pico"] == pytest.approx(100 * sum(x[8] for x in own) / len(own))
    assert reports.interventions(facts.where("false"), default_config()).count() == 0
