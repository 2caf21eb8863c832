"""Files written in parts by several tasks, and numbers that go on from file to file."""

from pyspark.sql import functions as F

import registry.files as queries
from viario.sources import files


def test_order_over_parts(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 500).alias("k"), F.col("id").alias("i"))
    df = df.union(spark.createDataFrame([(None, 1000), (None, 1001)], "k long, i long"))
    parts = queries._in_order(df, "k", 100).withColumn("p", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id())
    rows = parts.orderBy("at").collect()
    assert len({r.p for r in rows}) > 5 and len(rows) == 1002
    assert [r.k or -1 for r in rows] == sorted(r.k or -1 for r in rows)


def test_numbers_go_on_over_files(spark, tmp_path):
    for folder, a, b in (("plain", "a0", "b0"), ("quoted", '"a\n0"', '"b ""0"""')):
        place = tmp_path / folder
        place.mkdir()
        (place / "p1.csv").write_text(f"k,v\n{a},1\nx,2,3\n\n")
        (place / "p2.csv").write_text("k,v\n")
        (place / "p3.csv").write_text("")
        (place / "p4.csv").write_text(f"k,v\n{b},4\nlast,5\n")
        rows = files.read_csv(spark, str(place), encoding="utf-8", row_numbers=True, over_files=True)
        assert {r.v: r[files.ROW_NUMBER] for r in rows.collect()} == {"1": 0, "4": 2, "5": 3}
        rows = files.read_csv(spark, str(place), encoding="utf-8", row_numbers=True)
        assert {r.v: r[files.ROW_NUMBER] for r in rows.collect()} == {"1": 0, "4": 0, "5": 1}


def test_collections_of_many_features(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(queries, "PART_ROWS", 60)
    schema = "l_orderkey long, l_linenumber int, l_returnflag string, l_quantity double"
    made = [(i % 150, i % 3, "ANR"[i % 3], float(i % 50)) for i in range(300)] * 2 + [(None, 1, "A", 1.0)]
    for name, data in (("some", made), ("none", [])):
        monkeypatch.setattr(queries, "_target", lambda spark, label, name=name: str(tmp_path / name / "out"))
        spark.createDataFrame(data, schema).write.parquet(str(tmp_path / name / "lineitem.parquet"))
        found = queries.geojson_collection(spark, str(tmp_path / name)).collect()
        want = [(k, n, '} "features":[{ ' + f + " \\", q, k * 0.5 if k is not None else None) for k, n, f, q in data]
        assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, want))
    assert len(list((tmp_path / "some" / "out").glob("part=*/*.txt"))) > 5
