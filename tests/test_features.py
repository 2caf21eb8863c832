"""GeoJSON collections read in blocks, against the json module."""

import json
import random

import pytest

from viario.sources import features, files


@pytest.fixture
def blocks(spark):
    """Files are cut into blocks of the wanted number of bytes."""
    names = ["spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"]
    before = {n: spark.conf.get(n) for n in names}

    def cut(size):
        for n in names:
            spark.conf.set(n, str(size))

    yield cut
    for n, v in before.items():
        spark.conf.set(n, v)


def _value(draw, deep=0):
    kind = draw.randrange(7 if deep < 3 else 4)
    if kind == 0:
        return draw.choice(["", "}", "{", '"', '\\', '\\"}', '"features":[{', "a,b]", "ñandú 雪}", "\n\t", '{"type":"Feature"}'])
    if kind in (1, 2):
        return draw.choice([0, -1.5, 12, True, None])
    if kind == 3:
        return "x" * draw.randrange(40)
    if kind == 4:
        return [_value(draw, deep + 1) for _ in range(draw.randrange(4))]
    return {draw.choice(["a", "features", "type", "}", 'q"', "ü"]): _value(draw, deep + 1) for _ in range(draw.randrange(4))}


def _collection(draw, n):
    made = [{"type": "Feature", "n": i, "properties": {"v": _value(draw)}, "geometry": {"type": "Point", "coordinates": [i, 1]}}
            for i in range(n)]
    before = [("type", "FeatureCollection"), ("name", _value(draw)), ("others", [{"no": 1}, {"features": [{"no": 2}]}]),
              ("crs", {"features": [{"no": 3}], "b": "features"})]
    entries = [*before, ("features", made), ("after", [{"no": 4}, _value(draw)])]
    return dict(entries if draw.random() < 0.5 else entries[::-1]), made


@pytest.mark.parametrize("size", [37, 150, 1000, 1 << 20])
def test_collections_in_blocks(spark, tmp_path, blocks, monkeypatch, size):
    draw, wanted = random.Random(size), {}
    monkeypatch.setattr(features, "CHUNK_BYTES", 200)
    for k, n in enumerate([0, 1, 7, 25]):
        whole, made = _collection(draw, n)
        text = json.dumps(whole, indent=draw.choice([None, 1]), ensure_ascii=draw.random() < 0.5)
        (tmp_path / f"{k}.geojson").write_text(text + draw.choice(["", "\n"]))
        wanted[f"{k}.geojson"] = made
    (tmp_path / "empty.geojson").write_text("")
    blocks(size)
    found = {name: [] for name in wanted}
    rows = features.read_collections(spark, str(tmp_path), broadcast_blocks=0 if size == 150 else 1000).collect()
    for r in sorted(rows, key=lambda r: (r["__file"], r["__block"], r["__index"])):
        found[r["__file"].rsplit("/", 1)[1]].append(json.loads(r["text"]))
    assert found == wanted


def test_one_long_feature_over_blocks(spark, tmp_path, blocks):
    rings = [[[i, {"x": i}] for i in range(300)]]
    made = [{"type": "Feature", "geometry": {"type": "Odd", "coordinates": rings}}, {"type": "Feature"}]
    path = tmp_path / "long.geojson"
    path.write_text(json.dumps({"features": made}))
    blocks(100)
    rows = features.read_collections(spark, str(path)).orderBy("__block", "__index").collect()
    assert [json.loads(r["text"]) for r in rows] == made


def test_cut_file_gives_closed_features(spark, tmp_path, blocks):
    text = json.dumps({"features": [{"type": "Feature", "properties": {"n": i}} for i in range(20)]})
    path = tmp_path / "cut.geojson"
    path.write_text(text[:text.index('"n": 15') + 3])
    blocks(100)
    rows = files.read_features(spark, str(path)).orderBy("feature_id").collect()
    assert [r["properties"]["n"] for r in rows] == [str(i) for i in range(15)]


def test_features_have_the_types_of_spark(spark, tmp_path, blocks):
    made = [{"type": "Feature", "properties": {"codigo": i, "otro": {"a": [1, 2]}, "no": None},
             "geometry": {"type": "Point", "coordinates": [i, 0.5]}} for i in range(50)]
    made[7]["geometry"], made[8]["properties"] = None, None
    path = tmp_path / "c.geojson"
    path.write_text(json.dumps({"type": "FeatureCollection", "features": made}))
    blocks(300)
    rows = files.read_features(spark, str(path))
    whole = spark.read.schema("features array<struct<type:string,properties:map<string,string>,geometry:struct<type:string,coordinates:string>>>").json(
        str(path), multiLine=True).selectExpr("inline(features)")

    def parsed(r):
        """Texts of nested values may differ in white space."""
        nested = r.properties and {k: json.loads(v) if k == "otro" else v for k, v in r.properties.items()}
        return r.type, nested, r.geometry and (r.geometry.type, json.loads(r.geometry.coordinates))

    assert [parsed(r) for r in rows.orderBy("feature_id").collect()] == [parsed(r) for r in whole.collect()]
