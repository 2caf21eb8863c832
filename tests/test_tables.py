"""Raw files to cleaned tables, the master, the rankings and the views."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from viario import CsvCleaner, default_config, run
from viario.operators import geo, joins, ranking
from viario.operators.features import add_time_features, apply_filters, estimated_capacity, service_level
from viario.plans import datasets, reports
from viario.plans.run import load_clean, load_views
from viario.sources import files

BROKEN = "�"


def write(folder, name, text, encoding="utf-8"):
    (folder / name).write_bytes(text.encode(encoding))


@pytest.fixture(scope="module")
def raw(tmp_path_factory):
    folder = tmp_path_factory.mktemp("raw")
    names = default_config()["files"]
    lines = ["Fecha_Trafico,hora,corredor,nombre_comuna,codigo_comuna,velocidad_km_h,intensidad,ocupacion,dia_num,mes_num,longitud"]
    for day in range(1, 15):
        for hour in range(24):
            for c, commune in enumerate(["Laureles–Estadio", "El Poblado", "Zona Rural"]):
                speed = 5 + (day * 7 + hour * 3 + c * 11) % 60
                flow = 100 + (day * 13 + hour * 29 + c * 71) % 900
                occ = "" if hour % 11 == 0 else f"{(hour * 3 + day) % 50}"
                lines.append(f"2020-07-{day:02d} {hour:02d}:00:00,{hour:02d}:00:00, V{BROKEN}a {c},{commune},{c + 1},{speed},{flow},{occ},"
                             f"{(day - 1) % 7 + 1},7,\"-75,{c}\"")
    lines += [lines[1], "2020-07-01 00:00:00,3,X,El Poblado,2,500,10,1,1,7,", "bad,3,,El Poblado,2,50,10,1,1,7,",
              "one,too,many,fields,in,this,line,a,b,c,d,e,f"]
    write(folder, names["velocidad"], "\n".join(lines) + "\n")
    write(folder, names["aforos"], "FECHA,NOMBRE_COMUNA,COORDENADAX,COORDENADAY,VOLUMEN_TOTAL_HORA,MOVIMIENTO\n"
          "10718,LAURELES-ESTADIO,-75.5,6.2,100,\"\"\"\"\n10769,Laureles–Estadio,-75.5,6.2,300,giro\n311299,El Poblado,x,6.2,,  \n")
    write(folder, names["simm"], "CORREDOR,FECHAHORA,LOCATION,VELOCIDAD,INTENSIDAD\n"
          "Vía 0,2020-07-01T05:00:00Z,\"{'lon': '-75.56', 'lat': '6.21'}\",30,200\n"
          "Vía 0,2020-07-01T06:00:00Z,\"{'lon': '-75.58', 'lat': '6.23'}\",50,400\n")
    write(folder, names["pasajeros"], "AÑO,NUM_MES,LÍNEA_O,PAX_MOV_A,PAX_MOV_B\n2019,6,A,1.200,\"492,5\"\n2020,13,A,5,\n2020,,A,,\n2021,1,A,-10,\n",
          "utf-8-sig")
    write(folder, names["poblacion"], "codigo,grupo_edad,total_2019,hombres_2019\nLaureles Estadio,Total,1000,1\nPoblado, total ,2000,1\n"
          "Poblado,0-4,7,1\nTotal Medellín,Total,9999,1\nEl Poblado Norte,Total,3000,1\nNada,Total,,1\n")
    write(folder, names["ciclorrutas"], "nombre,estado\nRuta 1, Existente \nÑame,Proyectado\nRuta 3,Existente\n", "latin-1")
    return folder


@pytest.fixture(scope="module")
def config(raw, tmp_path_factory):
    cfg = default_config()
    cfg["paths"] = {"raw": str(raw), "processed": str(tmp_path_factory.mktemp("processed"))}
    return cfg


@pytest.fixture(scope="module")
def tables(spark, config):
    return load_clean(spark, config)


@pytest.fixture(scope="module")
def result(spark, config):
    return run(spark, config)


def test_speed_rows(tables):
    rows = tables["velocidad"]
    assert rows.count() == 14 * 24 * 3
    first = rows.where("hora = 5 and corredor = 'Vía 1'").orderBy("fecha_trafico").first()
    assert first["fecha_trafico"] == dt.datetime(2020, 7, 1, 5) and first["longitud"] == -75.1


def test_other_datasets(tables):
    counts = {r["fecha"].year: r for r in tables["aforos"].collect()}
    assert set(counts) == {2018, 1969, 1999} and counts[1999]["lon"] is None and counts[1999]["movimiento"] is None
    assert counts[2018]["movimiento"] is None and counts[1969]["movimiento"] == "giro"
    assert tables["simm"].select("lon", "lat").first() == (-75.56, 6.21)
    assert tables["simm"].first()["fechahora"] == dt.datetime(2020, 7, 1, 5)
    pax = tables["pasajeros"].orderBy("ano", F.desc("num_mes")).collect()
    assert [(r["ano"], r["total_pax"], r["fecha_periodo"]) for r in pax] == [
        (2019, 1692.5, dt.datetime(2019, 6, 1)), (2020, 5.0, None), (2020, None, dt.datetime(2020, 1, 1))]
    assert sorted(r["nombre_area"] for r in tables["poblacion"].collect()) == ["El Poblado Norte", "Laureles Estadio", "Poblado"]
    assert [r["nombre"] for r in tables["ciclorrutas"].collect()] == ["Ruta 1", "Ñame", "Ruta 3"]


def test_run(result, config, spark):
    master = result["master"]
    assert master.count() == 14 * 24 * 3 and master.where("icv < 0 or icv > 100 or icv is null").count() == 0
    people = {r[0]: r[1] for r in master.select("nombre_comuna", "poblacion_2019").distinct().collect()}
    # an equal key first; else the first area in the file that contains the name or lies in it
    assert people == {"Laureles–Estadio": 1000.0, "El Poblado": 2000.0, "Zona Rural": None}
    means = {r[0]: r[1] for r in master.select("nombre_comuna", "aforo_medio").distinct().collect()}
    assert means == {"Laureles–Estadio": 200.0, "El Poblado": None, "Zona Rural": None}
    sensors = {r[0]: tuple(r)[1:] for r in master.select(
        "corredor", "simm_vel_media", F.round("simm_lat", 4), F.round("simm_lon", 4)).distinct().collect()}
    assert sensors == {"Vía 0": (40.0, 6.22, -75.57), "Vía 1": (None, None, None), "Vía 2": (None, None, None)}
    assert [r["rank"] for r in result["corredores"].collect()] == [1, 2, 3]
    assert result["corredores_ivc"].first()["corredor"].startswith("VIA")
    assert result["comunas"].count() == 3
    assert 0 < result["hotspots"].count() < 400
    assert result["anomalias"]["summary_stats"].first()["total_registros"] == 14 * 24 * 3
    views = load_views(spark, config)
    assert views["master"].count() == master.count() and views["pasajeros"].count() == 3
    assert dict(views["master"].dtypes)["es_fin_semana"] == "boolean"


def test_run_without_files(spark, tmp_path):
    cfg = default_config()
    cfg["paths"] = {"raw": str(tmp_path / "none"), "processed": str(tmp_path / "out")}
    out = run(spark, cfg)
    assert out["master"].count() == 0 and out["corredores"].count() == 0 and out["pasajeros"] is None
    assert out["anomalias"]["summary_stats"].first()["total_registros"] == 0


def test_cleaner(spark, raw, tmp_path):
    cleaner = CsvCleaner(spark, raw, tmp_path / "clean", tmp_path / "log")
    out = cleaner.clean_all(["velocidad", "poblacion", "nada"])
    assert "error" in out["nada"]
    assert out["velocidad"]["filas_procesadas"] == 14 * 24 * 3 + 3 and out["velocidad"]["columnas_limpias"] == ["corredor"]
    log = files.read_csv(spark, str(tmp_path / "log"))
    assert log.count() == out["velocidad"]["celdas_modificadas"] + out["poblacion"]["celdas_modificadas"]
    clean = files.read_csv(spark, str(tmp_path / "clean" / cleaner.files["velocidad"]["filename"]))
    assert clean.where("corredor = 'Vía 0'").count() > 300
    totals = {r["archivo"]: r["filas_procesadas"] for r in cleaner.summary(out).collect()}
    assert totals["TOTAL"] == sum(v for k, v in totals.items() if k != "TOTAL")
    dry = CsvCleaner(spark, raw, tmp_path / "dry", tmp_path / "drylog", dry_run=True)
    assert dry.clean_file("ciclorrutas")["filas_procesadas"] == 3
    assert not (tmp_path / "dry").exists()
    with pytest.raises(ValueError):
        dry.clean_file("nada")
    away = CsvCleaner(spark, tmp_path / "away", tmp_path / "x", tmp_path / "y")
    assert away.clean_file("simm") == {
        "filas_procesadas": 0, "celdas_modificadas": 0, "columnas_limpias": [], "registros_rechazados": 0}


def test_line_numbers_over_many_splits(spark, tmp_path):
    text = "clave,valor\n" + "".join(f"{i},{'x' * (i % 50)}\n" for i in range(5000))
    write(tmp_path, "a.csv", text)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 10_000)
    try:
        rows = files.read_csv(spark, str(tmp_path / "a.csv"), row_numbers=True)
        assert rows.rdd.getNumPartitions() > 5
        assert rows.where(F.col(files.ROW_NUMBER) != F.col("clave").cast("bigint")).count() == 0
        assert rows.count() == 5000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_records_over_several_lines(spark, tmp_path):
    """Quoted line breaks, over file blocks of a few bytes."""
    rows = [("1", "plain", "x"), ("2", "two\nlines", "y"), ("3", 'with ""quotes"" and\n\nblank', "z"), ("4", "a,b\n", "w"),
            ("5", "last\n\n\n\nlines", None)] * 40
    text = "k,t,u\n" + "".join(f'{k},"{t}",{u or ""}\n' for k, t, u in rows) + '6,too,many,fields\n7,short\n'
    (tmp_path / "torn.csv").write_text(text, encoding="utf-8")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    try:
        df = files.read_csv(spark, str(tmp_path / "torn.csv"), row_numbers=True)
        got = [(r.k, r.t, r.u) for r in df.orderBy(files.ROW_NUMBER).collect()]
        numbers = sorted(r[files.ROW_NUMBER] for r in df.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == [(k, t.replace('""', '"'), u) for k, t, u in rows] + [("7", "short", None)]
    assert numbers == [*range(len(rows)), len(rows) + 1]


def test_encoding(spark, tmp_path):
    write(tmp_path, "l.csv", "a\nMedellín\n", "latin-1")
    write(tmp_path, "u.csv", "a\nMedellín\n", "utf-8-sig")
    assert files.detect_encoding(spark, str(tmp_path / "l.csv")) == "ISO-8859-1"
    for name in ("l.csv", "u.csv"):
        table = files.read_csv(spark, str(tmp_path / name))
        assert table.columns == ["a"] and table.first()[0] == "Medellín"


def test_year_column():
    assert datasets.find_year_column(["orden", "mes", "a_o"]) == "a_o"
    assert datasets.find_year_column(["orden", "mes"]) is None
    assert datasets.passenger_columns(["pax_mov_1", "x", "t_pax_mov"]) == ["pax_mov_1", "t_pax_mov"]


def test_population_edge_cases(spark):
    areas = spark.createDataFrame(
        [("Uno", 1.0, 0), ("uno dos", 2.0, 1), ("UNO", 3.0, 2), ("", 9.0, 3), ("tres", None, 4), ("tres x", 5.0, 5)],
        "nombre_area string, total_2019 double, posicion long")
    names = spark.createDataFrame(
        [(0, "uno"), (1, "dos"), (2, None), (3, "tres"), (4, "cuatro"), (5, "el uno dos"), (6, "")], "i int, nombre_comuna string")
    got = {r["i"]: r["poblacion_2019"] for r in joins.join_population(names, areas).collect()}
    assert got == {0: 3.0, 1: 2.0, 2: None, 3: None, 4: None, 5: 3.0, 6: None}
    assert joins.join_population(names, None).first()["poblacion_2019"] is None


def test_joins_without_tables(spark):
    df = spark.createDataFrame([("a", "b")], "corredor string, nombre_comuna string")
    out = joins.join_sensors(joins.join_counts(df, None), None)
    assert set(out.columns) == {"corredor", "nombre_comuna", "aforo_medio", "simm_vel_media", "simm_int_media", "simm_lat", "simm_lon"}


def test_features_and_filters(spark):
    cfg = default_config()
    df = spark.createDataFrame([(5, 6.0, "a"), (None, None, "a"), (23, 5.0, None), (30, 7.0, "b")], "hora int, dia_num double, corredor string")
    rows = add_time_features(df, cfg).collect()
    assert [(r["franja_horaria"], r["es_hora_pico"], r["es_fin_semana"], r["dia_num"]) for r in rows] == [
        ("manana", False, True, 6), ("desconocida", False, False, 0), ("noche", False, False, 5), ("desconocida", False, True, 7)]
    assert apply_filters(df, ["zzz"], ["a"], "Todas", "Todos").count() == 2
    assert apply_filters(df, None, None, None, "Sabado").count() == 1


def test_ties_and_nulls_in_rankings(spark):
    cfg = default_config()
    cfg["rankings"]["top_corredores"] = 3
    rows = [("b", 10.0, False), ("a", 10.0, False), ("c", None, False), ("d", 5.0, False), ("e", 99.0, True), (None, 80.0, False)]
    df = spark.createDataFrame(rows, "corredor string, icv double, es_fin_semana boolean")
    assert [(r["rank"], r["corredor"]) for r in ranking.rank_corridors(df, cfg).collect()] == [(1, "a"), (2, "b"), (3, "d")]
    cfg["rankings"]["solo_dias_habiles"] = False
    assert ranking.rank_corridors(df, cfg).first()["corredor"] == "e"


def test_levels(spark):
    df = spark.createDataFrame([(0.39,), (0.4,), (0.7,), (0.9,), (None,)], "v double")
    assert [r[0] for r in df.select(service_level(F.col("v"))).collect()] == [
        "Fluido (A/B)", "Moderado (C/D)", "Congestionado (E)", "Saturado (F)", "Saturado (F)"]
    names = spark.createDataFrame([("Av 80",), ("regional x",), (None,)], "v string")
    assert [r[0] for r in names.select(estimated_capacity(F.col("v"))).collect()] == [3600, 5400, 1800]


def test_commune_map_without_columns(spark):
    out = reports.commune_map(spark.createDataFrame([(1.0,)], "icv double"))
    assert out.count() == 0 and out.columns[0] == "codigo_geo"


GEOJSON = """{"type": "FeatureCollection", "features": [
 {"type": "Feature", "properties": {"codigo": "1", "nombre": " Uno "}, "geometry": {"type": "Polygon",
  "coordinates": [[[0,0],[4,0],[4,4],[2,1],[0,4],[0,0]], [[1,1],[1.1,1],[1,1.1],[1,1]]]}},
 {"type": "Feature", "properties": {"codigo": 2, "nombre": "Dos"}, "geometry": {"type": "MultiPolygon",
  "coordinates": [[[[10,10],[11,10],[11,11]]], [[[10,0],[14,0],[14,2],[10,2]]]]}},
 {"type": "Feature", "properties": {"codigo": "x"}, "geometry": {"type": "Polygon", "coordinates": [[[0,0],[1,1],[2,2]]]}},
 {"type": "Feature", "properties": {"codigo": "4", "nombre": "Recta"}, "geometry": {"type": "Polygon", "coordinates": [[[0,0],[1,1],[2,2]]]}},
 {"type": "Feature", "properties": {"corredor_dataset": "C1"}, "geometry": {"type": "LineString",
  "coordinates": [[1,0.5],[2,0.5],[2,9],[3,0.5],[11,1],[12,1],[13,1],[13,9],[1,0.2]]}}]}"""


def test_geo(spark, tmp_path):
    (tmp_path / "g.geojson").write_text(GEOJSON)
    features = files.read_features(spark, str(tmp_path / "g.geojson"))
    labels = {r["codigo_geo"]: r for r in geo.commune_labels(features).collect()}
    assert set(labels) == {"01", "02", "04"} and labels["01"]["nombre_comuna"] == "Uno"
    assert (labels["02"]["lon_label"], labels["02"]["lat_label"]) == (12.0, 1.0)
    assert (labels["04"]["lon_label"], labels["04"]["lat_label"]) == (1.0, 1.0)
    rings = geo.urban_rings(features)
    assert rings.count() == 5
    points = spark.createDataFrame([(1.0, 1.0), (2.0, 2.0), (2.0, 0.9), (12.0, 1.0), (10.9, 10.5), (50.0, 50.0)], "lon double, lat double")
    assert {tuple(r) for r in geo.points_in_area(points, rings).collect()} == {(1.0, 1.0), (2.0, 0.9), (12.0, 1.0), (10.9, 10.5)}
    runs = geo.clip_lines(geo.line_points(features), rings)
    lengths = sorted(r["n_points"] for r in runs.where("position = 0").collect())
    assert lengths == [2, 4]
    label = geo.corridor_labels(runs).first()
    assert (label["corredor"], label["lon"], label["lat"]) == ("C1", 7.0, 0.75)
    thin = geo.thin_lines(runs, 2)
    assert sorted(r["position"] for r in thin.where("n_points = 4").collect()) == [0, 3]
    assert files.read_features(spark, str(tmp_path / "none.geojson")).count() == 0
