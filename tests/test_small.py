"""Figures of groups brought to the facts, with a hot group."""

import random

import pytest
from pyspark.sql import functions as F

from tests.compare import plan_of
from viario.operators import joins
from viario.operators.detect.fence import detect_iqr
from viario.operators.small import join_groups


@pytest.fixture(scope="module")
def facts(spark):
    """A third of 9,000 rows in one group, a few without a group."""
    key = F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 101 == 0, F.lit(None)).otherwise(
        F.concat(F.lit("g"), (F.col("id") % 40).cast("string")))
    return spark.range(9000).select("id", key.alias("k"), (F.col("id") % 977).cast("double").alias("icv"))


@pytest.mark.parametrize("how", ["left", "inner"])
def test_both_ways_agree(facts, how):
    figures = facts.dropna(subset=["k"]).where("k <> 'g7'").groupBy("k").agg(F.avg("icv").alias("m"))
    sent = join_groups(facts, figures, ["k"], how)
    salted = join_groups(facts, figures, ["k"], how, broadcast_rows=1, salts=5)
    assert sorted(map(repr, sent.collect())) == sorted(map(repr, salted.select(sent.columns).collect()))
    assert "BroadcastHashJoin" in plan_of(sent)


@pytest.mark.parametrize("how", ["left", "inner", "left_semi"])
def test_many_figures_are_shuffled_once(facts, how):
    """However small their files, figures beyond the limit are not sent whole."""
    figures = facts.dropna(subset=["k"]).where("k <> 'g7'").groupBy("k").agg(F.avg("icv").alias("m"))
    sent = join_groups(facts, figures, ["k"], how)
    for hot_rows in (1, 1000, 100_000):
        salted = join_groups(facts, figures, ["k"], how, broadcast_rows=1, salts=5, hot_rows=hot_rows)
        assert sorted(map(repr, sent.collect())) == sorted(map(repr, salted.select(sent.columns).collect()))
        assert "SortMergeJoin" in plan_of(salted)


def test_facts_stay_where_they_are(spark, facts):
    """With small figures no fact is shuffled by its group, whatever Spark's own broadcast limit."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1")
    try:
        rows = facts.withColumnsRenamed({"k": "corredor"}).withColumns({
            "nombre_comuna": F.col("corredor"), "franja_horaria": F.lit("noche"), "es_fin_semana": F.lit(False)})
        areas = spark.createDataFrame([("HOT", 5.0, 0), ("g1", 7.0, 1)], "nombre_area string, total_2019 double, posicion long")
        sensors = rows.select("corredor", F.col("icv").alias("velocidad"), F.col("icv").alias("intensidad"))
        for df in (detect_iqr(rows), joins.join_sensors(rows, sensors), joins.join_population(rows, areas),
                   joins.flag_members(rows, rows.where("icv > 900"), "corredor", "flag")):
            plan = plan_of(df)
            assert "SortMergeJoin" not in plan and "Exchange hashpartitioning" not in plan
            assert df.count() == 9000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_empty_names_match_nothing(spark):
    rows = spark.createDataFrame([("Привет", 1), ("Ελλάδα", 2), (None, 3), ("--", 4), ("Centro", 5), ("ПРИВЕТ", 6)], "nombre_comuna string, i int")
    counts = spark.createDataFrame([("привет", 10.0), ("ελλάδα", 30.0), (None, 50.0), ("", 70.0), ("CENTRO", 90.0)],
                                   "nombre_comuna string, volumen_total_hora double")
    found = {r.i: r.aforo_medio for r in joins.join_counts(rows, counts).collect()}
    assert found == {1: 10.0, 2: 30.0, 3: None, 4: None, 5: 90.0, 6: 10.0}


def test_containment_equals_brute_force(spark):
    draw = random.Random(3)
    inner, outer = ({"".join(draw.choice("ab cñ") for _ in range(draw.randrange(9))) for _ in range(n)} for n in (200, 300))
    inner, outer = sorted(inner | {"común x", "z"}), sorted(outer | {"la común x y", "zz"})
    a = spark.createDataFrame([(x, i) for i, x in enumerate(inner)] + [(None, -1)], "area string, pos long")
    b = spark.createDataFrame([(x,) for x in outer] + [(None,)], "key string")
    found = joins.containing(a, b, "area", "key").select("area", "pos", "key").collect()
    assert sorted(map(tuple, found)) == sorted((x, i, y) for i, x in enumerate(inner) if x for y in outer if x in y)
    assert joins.containing(a.where("false"), b, "area", "key").count() == 0
