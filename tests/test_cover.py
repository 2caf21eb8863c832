"""Rings cut into cells against the ray through the whole ring."""

import json
import math
import random

from pyspark.sql import functions as F

from viario.operators import cover, geo
from viario.storage import materialise


def ray(x, y, ring):
    inside = False
    for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]):
        if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
            inside = not inside
    return inside


def star(n, seed, x=0.0, y=0.0):
    draw = random.Random(seed)
    return [(x + math.cos(i * math.tau / n) * r, y + math.sin(i * math.tau / n) * r)
            for i in range(n) for r in [draw.uniform(2, 10)]]


def comb(n):
    """Teeth side by side, many edges over the whole height."""
    teeth = [p for i in range(n) for p in ((i, 10.0 + i % 3), (i + 0.5, 10.0 + i % 3), (i + 0.5, 0.5), (i + 1.0, 0.5))]
    return [*[(float(a), b) for a, b in teeth], (float(n), 0.0), (0.0, 0.0)]


def uneven(n):
    """A large triangle with most of its edges in one small place."""
    return [(0.0, 0.0), (100.0, 0.0), *[(100.0 - i / n * 0.02 - i % 2 * 0.01, 50.0 + i / n * 0.1 + i % 3 * 0.05) for i in range(n)], (0.0, 100.0)]


def crossing(n, seed):
    """A ring that crosses itself, with repeated, level and upright pieces, on few different coordinates."""
    draw = random.Random(seed)
    return [(float(draw.randint(0, 12)), float(draw.randint(0, 12))) for _ in range(n)]


RINGS = {"star": star(400, 1), "comb": comb(60), "uneven": uneven(900), "crossing": crossing(150, 3),
         "small": [(0.0, 0.0), (3.0, 0.0), (0.0, 3.0)], "flat": [(float(i), 1.0) for i in range(100)]}


def features(spark, rings):
    rows = [(json.dumps([[list(p) for p in r]]), i) for i, r in enumerate(rings)]
    return spark.createDataFrame(rows, "c string, feature_id long").select(
        F.struct(F.lit("Polygon").alias("type"), F.col("c").alias("coordinates")).alias("geometry"), "feature_id")


def places(ring, n, seed):
    """Points around the ring: anywhere in its box, on its corners, level with them, on the middles of edges."""
    draw = random.Random(seed)
    xs, ys = [p[0] for p in ring], [p[1] for p in ring]
    near = [(draw.uniform(min(xs) - 1, max(xs) + 1), draw.uniform(min(ys) - 1, max(ys) + 1)) for _ in range(n)]
    ends = draw.sample(ring, min(len(ring), 40))
    level = [(draw.uniform(min(xs), max(xs)), p[1]) for p in ends] + [(p[0], draw.uniform(min(ys), max(ys))) for p in ends]
    middles = [((a[0] + b[0]) / 2, (a[1] + b[1]) / 2) for a, b in zip(ring, ring[1:])][:40]
    return sorted({*near, *ends, *level, *middles})


def test_cells_against_the_whole_ring(spark):
    """All shapes side by side, far enough apart that none covers another's points."""
    rings = [[(x + 1000.0 * i, y) for x, y in ring] for i, ring in enumerate(RINGS.values())]
    points = [p for ring in rings for p in places(ring, 400, 7)]
    found = geo.points_in_area(spark.createDataFrame(points, "lon double, lat double"), geo.urban_rings(features(spark, rings)))
    assert {tuple(r) for r in found.collect()} == {p for p in points if any(ray(*p, r) for r in rings)}


def test_several_rings_repeated_rows_and_nulls(spark):
    rings = [star(300, 1), star(300, 1), star(200, 5, 8.0, 3.0), [(0.0, 0.0), (30.0, 0.0), (0.0, 1.0)]]
    points = places(rings[0] + rings[2], 300, 9)
    rows = [*points, *points[:50], (None, 1.0), (1.0, None), (float("nan"), 1.0)]
    found = geo.points_in_area(spark.createDataFrame(rows, "lon double, lat double"), geo.urban_rings(features(spark, rings)))
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == {p for p in points if any(ray(*p, r) for r in rings)}
    none = spark.createDataFrame([], "lon double, lat double")
    assert geo.points_in_area(none, geo.urban_rings(features(spark, rings))).count() == 0


def test_points_meet_few_edges(spark):
    """A circle of many edges: no cell holds more than some; a crowded place is cut again."""
    n = 20_000
    ring = [(math.cos(i * math.tau / n) * 10, math.sin(i * math.tau / n) * 10) for i in range(n)]
    shapes = geo.urban_rings(features(spark, [ring])).select(F.lit("r").alias("node"), "edges")
    levels = cover.cover(materialise(shapes, "shapes"))
    sizes = levels[-1][1].agg(F.max(F.size("edges")), F.sum(F.size("edges"))).first()
    assert sizes[0] <= cover.CELL_EDGES * 2 and sum(c.select(F.sum(F.size("edges"))).first()[0] for _, c in levels) < 3 * n
    crowded = geo.urban_rings(features(spark, [RINGS["uneven"]])).select(F.lit("r").alias("node"), "edges")
    assert len(cover.cover(materialise(crowded, "crowded"))) > 1
