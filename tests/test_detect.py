"""Detectors on a synthetic master, with and without optional columns."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from viario.config import ANOMALY_COLUMNS, FOREST, default_config
from viario.operators.detect import forest, noise
from viario.operators.detect.fence import detect_iqr
from viario.operators.detect.score import add_score, summaries
from viario.operators.detect.series import detect_along_series, detect_speed_drop, detect_z_score
from viario.plans.detection import AnomalyDetector

SLOTS = ["madrugada", "manana", "mediodia", "tarde", "noche"]


@pytest.fixture(scope="module")
def frame():
    """Four roads, one of them with half of the hours; daily waves with noise, some stops and some peaks."""
    rng = np.random.default_rng(7)
    road = np.sort(rng.choice(4, 1300, p=[0.5, 0.25, 0.15, 0.1]))
    hours = pd.Series(road).groupby(road).cumcount().to_numpy()
    wave = np.sin(hours / 24 * 2 * np.pi)
    n = len(road)
    data = pd.DataFrame({
        "simm_lon": -75.6 + road * 0.02 + rng.normal(0, 0.004, n), "simm_lat": 6.25 + rng.normal(0, 0.01, n),
        "poblacion_2019": 90000.0 + 30000.0 * road, "icv": np.clip(48 - 14 * wave + rng.normal(0, 11, n), 0, 96).round(2),
        "ocupacion": np.clip(30 - 9 * wave + rng.gamma(2, 6, n), 0, 100).round(1),
        "intensidad": (320 - 140 * wave + rng.normal(0, 60, n)).round(0),
        "velocidad_km_h": np.clip(41 + 17 * wave + rng.normal(0, 9, n), 2, None).round(1),
        "hora": hours % 24, "fecha_trafico": pd.Timestamp("2021-03-01") + pd.to_timedelta(hours, unit="h"),
        "dia_num": hours // 24 % 7 + 1, "es_fin_semana": hours // 24 % 7 >= 5, "es_hora_pico": np.isin(hours % 24, [7, 8, 17, 18]),
        "franja_horaria": np.array(SLOTS)[np.digitize(hours % 24, [5, 11, 14, 19])],
        "nombre_comuna": [f"Zona {r + 1}" for r in road], "corredor": [f"Via {r + 1}" for r in road], "id": np.arange(n),
    })
    data.loc[data.index % 41 == 5, "velocidad_km_h"] = 3.0
    data.loc[data.index % 59 == 8, "icv"] = 98.5
    return data


@pytest.fixture(scope="module")
def master(spark, frame):
    return spark.createDataFrame(frame).cache()


@pytest.fixture(scope="module")
def config(tmp_path_factory):
    cfg = default_config()
    cfg["paths"]["processed"] = str(tmp_path_factory.mktemp("processed"))
    return cfg


@pytest.fixture(scope="module")
def result(master, config):
    return AnomalyDetector(config, row_id=["id"]).run(master)


def expected_z(frame):
    out = pd.Series(False, index=frame.index)
    for _, g in frame.groupby("corredor"):
        if len(g) < 24:
            continue
        g = g.sort_values(["fecha_trafico", "hora"])
        hits = 0
        for c in ("velocidad_km_h", "intensidad", "ocupacion"):
            roll = g[c].rolling(24, min_periods=6)
            z = ((g[c] - roll.mean()) / roll.std().replace(0, np.nan)).abs()
            hits = hits + (z > 1.6).astype(int)
        out.loc[g.index[hits >= 2]] = True
    return out


@pytest.mark.parametrize("sizes", [{}, {"group_rows": 10, "block_rows": 37}])
def test_along_series_against_pandas(master, frame, sizes):
    rows = detect_along_series(master, row_id=["id"], sizes=sizes, threshold=1.6).toPandas().set_index("id").sort_index()
    assert (rows["z_score_anomaly"] == expected_z(frame)).all()
    ordered = frame.sort_values(["corredor", "fecha_trafico", "hora"])
    pct = ordered.groupby("corredor")["velocidad_km_h"].pct_change() * 100
    want = pct.reindex(frame.index)
    assert np.allclose(rows["speed_drop_pct"], want, equal_nan=True)
    assert (rows["speed_drop_anomaly"] == (want <= -30)).all()


def test_gap_zero_and_missing_key(spark):
    rows = [("a", 1, 10.0), ("a", 2, None), ("a", 3, 5.0), ("a", 4, 0.0), ("a", 5, 3.0), (None, 1, 9.0), (None, 2, 1.0),
            ("b", 1, 7.0)]
    df = spark.createDataFrame(rows, "corredor string, hora int, velocidad_km_h double")
    out = {(r["corredor"], r["hora"]): (r["speed_drop_pct"], r["speed_drop_anomaly"])
           for r in detect_speed_drop(df).collect()}
    assert out[("a", 1)] == (None, False) and out[("a", 2)] == (0.0, False)
    assert out[("a", 3)] == (-50.0, True) and out[("a", 4)] == (-100.0, True)
    assert out[("a", 5)] == (float("inf"), False)
    assert out[(None, 1)] == out[(None, 2)] == out[("b", 1)] == (None, False)


def test_small_group_and_missing_measures(master):
    small = master.where("corredor = 'Corredor 3'").limit(10)
    assert detect_z_score(small, row_id=["id"], threshold=0.1).where("z_score_anomaly").count() == 0
    one = master.drop("intensidad", "ocupacion")
    assert detect_z_score(one, row_id=["id"], threshold=0.1).where("z_score_anomaly").count() == 0


def test_fence_against_pandas(master, frame):
    rows = detect_iqr(master, factor=0.2).toPandas().set_index("id").sort_index()
    out = pd.Series(False, index=frame.index)
    for _, g in frame.groupby(["corredor", "franja_horaria", "es_fin_semana"]):
        if len(g) >= 4:
            q1, q3 = g["icv"].quantile(0.25), g["icv"].quantile(0.75)
            out.loc[g.index[g["icv"] > q3 + 0.2 * (q3 - q1)]] = True
    assert out.any() and (rows["iqr_anomaly"] == out).all()
    assert detect_iqr(master.drop("icv")).where("iqr_anomaly").count() == 0


def brute_noise(x, eps=0.5, least=5):
    near = ((x[:, None, :] - x[None, :, :]) ** 2).sum(-1) <= eps * eps
    core = near.sum(1) >= least
    return ~(near & core[None, :]).any(1)


@pytest.mark.parametrize("cell_points", [1_000_000, 3])
def test_noise_against_brute_force(spark, cell_points):
    rng = np.random.default_rng(3)
    clusters = rng.normal(0, 0.02, (500, 2)) + rng.choice([6.2, 6.25, 6.3], 500)[:, None]
    spread = rng.uniform(6.0, 6.5, (90, 2))
    same = np.repeat([[6.9, 6.9]], 200, axis=0)   # one place holds many rows
    few = np.repeat([[7.4, 6.1]], 4, axis=0)      # too few rows to be dense
    places = np.vstack([clusters, spread, same, few])
    data = pd.DataFrame(places, columns=["simm_lat", "simm_lon"])
    data["hora"] = np.r_[rng.integers(0, 24, 590), np.full(204, 5)]
    data["id"] = np.arange(len(data))
    x = data[["simm_lat", "simm_lon", "hora"]].to_numpy(float)
    want = brute_noise((x - x.mean(0)) / x.std(0))
    df = spark.createDataFrame(data)
    got = noise.detect_noise(df, cell_points=cell_points).toPandas().sort_values("id")["dbscan_anomaly"].to_numpy()
    assert want.any() and not want.all() and (got == want).all()


def test_noise_needs_enough_places(master):
    sparse = master.withColumn("simm_lat", F.when(F.col("id") < 50, F.col("simm_lat")))
    assert noise.detect_noise(sparse).where("dbscan_anomaly").count() == 0
    assert noise.detect_noise(master.drop("simm_lat")).where("dbscan_anomaly").count() == 0


def test_forest_finds_injected_outliers(spark, frame):
    data = frame.copy()
    odd = data.index[data["corredor"] == "Corredor 0"][:8]
    data.loc[odd, ["velocidad_km_h", "intensidad", "ocupacion"]] = [500.0, 9000.0, 900.0]
    data.loc[data.index[-3:], "nombre_comuna"] = "chica"
    data.loc[data.index[5], "nombre_comuna"] = None
    df = spark.createDataFrame(data)
    rows = forest.detect_forest(df, row_id=["id"]).toPandas().set_index("id").sort_index()
    assert rows.loc[odd, "isolation_forest_anomaly"].all()
    assert 0.03 < rows["isolation_forest_anomaly"].mean() < 0.08
    quiet = (data["nombre_comuna"] == "chica") | data["nombre_comuna"].isna()
    assert (rows.loc[quiet, "isolation_score"] == 0.0).all()
    assert not rows.loc[quiet, "isolation_forest_anomaly"].any()
    assert ((rows["isolation_score"] >= -1) & (rows["isolation_score"] <= 0)).all()
    salted = forest.detect_forest(df, row_id=["id"], broadcast_nodes=0, salt_rows=100)
    salted = salted.toPandas().set_index("id").sort_index()
    assert np.allclose(salted["isolation_score"], rows["isolation_score"])
    assert (salted["isolation_forest_anomaly"] == rows["isolation_forest_anomaly"]).all()


def test_forest_fills_gaps_and_reuses_models(spark, master, tmp_path):
    gaps = master.withColumn("ocupacion", F.when(F.col("id") % 5 != 0, F.col("ocupacion")))
    path, params = str(tmp_path / "models"), {**FOREST, "trees": 10}
    first = forest.detect_forest(gaps, path, params, ["id"]).select("id", "isolation_score").collect()
    files = {p.name for p in (tmp_path / "models").rglob("*.parquet")}
    again = forest.detect_forest(gaps, path, params, ["id"]).select("id", "isolation_score").collect()
    assert sorted(first) == sorted(again)
    assert files and files == {p.name for p in (tmp_path / "models").rglob("*.parquet")}
    for file in (tmp_path / "models").rglob("*.parquet"):
        file.write_bytes(b"damaged")
    for file in (tmp_path / "models").rglob("*.crc"):
        file.unlink()
    repaired = forest.detect_forest(gaps, path, params, ["id"]).select("id", "isolation_score").collect()
    assert sorted(first) == sorted(repaired)
    assert forest.detect_forest(master.drop("velocidad_km_h", "intensidad", "ocupacion", "icv")).where(
        "isolation_forest_anomaly").count() == 0


def test_grown_trees(spark):
    """Every node splits its own rows inside their extremes, or is a leaf for a reason; the same rows give the same trees."""
    rng = np.random.default_rng(0)
    x = np.round(rng.normal(size=(400, 3)), 1)
    x[0] = 40.0
    same = np.ones((30, 3))
    data = pd.DataFrame(np.vstack([x, same, x[:40]]), columns=["__f0", "__f1", "__f2"])
    data["__grp"] = ["many"] * 400 + ["same"] * 30 + ["few"] * 40
    data["id"] = np.arange(len(data))
    df, params = spark.createDataFrame(data), {**FOREST, "trees": 20}
    groups = spark.createDataFrame([("many", 400), ("same", 30), ("few", 40)], "__grp string, n long")
    nodes = forest.train(df, groups, 3, params, ["id"]).toPandas()
    assert nodes[nodes["grp"] == "same"]["node"].eq(0).all() and len(nodes[nodes["grp"] == "same"]) == 20
    assert set(nodes["subsample"][nodes["grp"] == "many"]) == {256} and set(nodes["subsample"][nodes["grp"] == "few"]) == {40}
    for _, tree in nodes.groupby(["grp", "tree"]):
        own = tree.set_index("node")
        limit = int(np.ceil(np.log2(own["subsample"].iloc[0])))
        for node, row in own.iterrows():
            depth = int(np.log2(node + 1))
            assert depth <= limit and (row["lo"] in own.index) == (row["hi"] in own.index) == (row["feature"] >= 0)
            if row["feature"] < 0:
                assert row["path"] >= depth
    scores = forest.tree_scores(forest.pack_trees(nodes[nodes["grp"] == "many"], 256), x)
    assert scores.argmin() == 0 and scores.min() < -0.7
    again = forest.train(df.repartition(5), groups, 3, params, ["id"]).toPandas()
    order = ["grp", "tree", "node"]
    pd.testing.assert_frame_equal(nodes.sort_values(order, ignore_index=True), again.sort_values(order, ignore_index=True))
    assert forest.expected_path(2) == 1.0 and forest.expected_path(1) == 0.0
    assert forest.expected_path(256) == pytest.approx(10.2448, abs=1e-3)


def test_a_model_takes_the_place_of_its_group(spark, tmp_path):
    def model(groups, cutoff):
        rows = [(g, 0, 0, -1, 0.0, 1, 2, 1.0, 16, cutoff) for g in groups]
        return spark.createDataFrame(rows, forest.NODES + ", subsample int, cutoff double")

    path = str(tmp_path / "model")
    forest.save_model(model(["a", "", "x/y=z"], 0.5), path, afresh=True)
    forest.save_model(model(["a", "b"], 0.25), path)
    assert sorted((r.grp, r.cutoff) for r in forest._saved(spark, path).collect()) == [("", 0.5), ("a", 0.25), ("b", 0.25), ("x/y=z", 0.5)]


def test_new_groups_join_saved_models(spark, master, tmp_path):
    path, params = str(tmp_path / "models"), {**FOREST, "trees": 8}
    communes = sorted(r[0] for r in master.select("nombre_comuna").dropna().distinct().collect())
    part = forest.detect_forest(master.where(F.col("nombre_comuna") == communes[0]), path, params, ["id"])
    first = {r["id"]: tuple(r) for r in part.select("id", "isolation_score", "isolation_forest_anomaly").collect()}
    every = forest.detect_forest(master, path, params, ["id"]).select("id", "isolation_score", "isolation_forest_anomaly").collect()
    assert len(every) == master.count() and all(tuple(r) == first.get(r["id"], tuple(r)) for r in every)
    fresh = forest.detect_forest(master, None, params, ["id"]).select("id", "isolation_score", "isolation_forest_anomaly").collect()
    assert sorted(fresh) == sorted(every)


def test_run_result(result, master):
    rows = result["flagged"].toPandas()
    assert set(ANOMALY_COLUMNS) <= set(rows.columns) and len(rows) == 1300
    assert rows["anomaly_score"].between(0, 100).all()
    level = pd.cut(rows["anomaly_score"], [-np.inf, 25, 50, 75, np.inf], right=False,
                   labels=["NORMAL", "MODERADO", "ALTO", "CRÍTICO"]).astype(str)
    assert (rows["severity_level"] == level).all()
    assert result["top_corridors"].count() <= 10 and result["top_communes"].count() <= 5
    stats = result["summary_stats"].first()
    assert stats["total_registros"] == 1300 and stats["total_anomalias"] == result["df_anomalies"].count()
    assert stats["n_speed_drop"] == int(rows["speed_drop_anomaly"].sum())
    assert stats["n_isolation_forest"] > 0


def test_run_on_little_data(spark, master, tmp_path):
    cfg = {"paths": {"processed": str(tmp_path)}}
    few = master.limit(60).drop("ocupacion", "simm_lat", "simm_lon", "fecha_trafico")
    rows = AnomalyDetector(cfg, row_id=["id"]).run(few)
    assert rows["flagged"].count() == 60
    sampled = AnomalyDetector({"paths": {}}, row_id=["id"]).detect(master, max_rows=300)
    assert 290 <= sampled.count() <= 310


def test_run_on_empty_table(spark):
    empty = spark.createDataFrame([], "x int")
    out = AnomalyDetector({"paths": {}}).run(empty)
    assert {"df_anomalies", "top_corridors", "top_communes", "hourly_pattern", "summary_stats"} <= set(out)
    assert out["summary_stats"].first()["total_registros"] == 0


def test_score_and_severity(spark):
    cases = [((True, True, True, True), True, False, 100.0, "CRÍTICO"),
             ((False, False, True, False), False, True, 30.0, "MODERADO"),
             ((True, True, False, False), False, False, 49.5, "MODERADO"),
             ((True, True, False, False), True, False, 59.4, "ALTO"),
             ((False, True, False, False), False, True, 20.0, "NORMAL"),
             ((True, False, False, False), False, True, 25.0, "MODERADO")]
    names = ["z_score_anomaly", "iqr_anomaly", "speed_drop_anomaly", "isolation_forest_anomaly"]
    df = spark.createDataFrame(
        [(i, *flags, peak, weekend) for i, (flags, peak, weekend, _, _) in enumerate(cases)],
        ["i", *names, "es_hora_pico", "es_fin_semana"])
    got = add_score(df).orderBy("i").collect()
    assert [(r["anomaly_score"], r["severity_level"]) for r in got] == [(s, l) for *_, s, l in cases]


def test_summaries_without_optional_columns(spark):
    df = spark.createDataFrame([(0.0, "NORMAL", False, False, False, False, False)],
                               "anomaly_score double, severity_level string, z_score_anomaly boolean, iqr_anomaly boolean, "
                               "speed_drop_anomaly boolean, isolation_forest_anomaly boolean, dbscan_anomaly boolean")
    assert all(summaries(df)[n].count() == 0 for n in ("df_anomalies", "top_corridors", "top_communes", "hourly_pattern"))
