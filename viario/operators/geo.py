"""Polygons and lines: features, centroids, point-in-polygon, clipping, thinning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from viario.functions.text import commune_code, strip
from viario.operators import cover
from viario.storage import materialise

RINGS = "array<array<array<double>>>"
POLYGONS = "array<array<array<array<double>>>>"
POINTS = "array<array<double>>"


def commune_features(features: DataFrame) -> DataFrame:
    """Features whose code is a number, with the padded code and the name."""
    code = F.trim(F.coalesce(F.col("properties")["codigo"], F.lit("")))
    return features.where(code.rlike(r"\A\d+\z")).withColumns({
        "codigo_geo": commune_code(code),
        "nombre_comuna": F.trim(F.coalesce(F.col("properties")["nombre"], F.lit(""))),
    })


def all_rings(kind: Column, coordinates: Column) -> Column:
    """Every ring of a polygon or multi-polygon given as coordinate text."""
    return F.when(kind == "Polygon", F.from_json(coordinates, RINGS)).when(
        kind == "MultiPolygon", F.flatten(F.from_json(coordinates, POLYGONS))
    )


def outer_rings(kind: Column, coordinates: Column) -> Column:
    """The exterior ring of each polygon, those with at least three points."""
    polygons = F.when(kind == "Polygon", F.array(F.from_json(coordinates, RINGS))).when(
        kind == "MultiPolygon", F.from_json(coordinates, POLYGONS)
    )
    rings = F.transform(F.filter(polygons, lambda p: F.size(p) > 0), lambda p: p[0])
    return F.filter(rings, lambda r: F.size(r) >= 3)


def line_parts(kind: Column, coordinates: Column) -> Column:
    """The parts of a line or multi-line."""
    return F.when(kind == "LineString", F.array(F.from_json(coordinates, POINTS))).when(
        kind == "MultiLineString", F.from_json(coordinates, RINGS)
    )


def _axis(ring: Column, i: int) -> Column:
    return F.transform(ring, lambda point: point[i])


def ring_box(ring: Column) -> Column:
    x, y = _axis(ring, 0), _axis(ring, 1)
    return F.struct(
        F.array_min(x).alias("x0"), F.array_min(y).alias("y0"),
        F.array_max(x).alias("x1"), F.array_max(y).alias("y1"),
    )


def largest_ring(rings: Column) -> Column:
    """The ring with the largest bounding box, the first one on ties."""
    def sized(ring: Column, i: Column) -> Column:
        box = ring_box(ring)
        area = (box["x1"] - box["x0"]) * (box["y1"] - box["y0"])
        return F.struct(area.alias("area"), (-i).alias("first"), ring.alias("ring"))

    candidates = F.filter(rings, lambda r: F.size(r) >= 3)
    return F.array_max(F.transform(candidates, sized))["ring"]


def ring_edges(ring: Column) -> Column:
    """Consecutive point pairs, the last point joined to the first."""
    shifted = F.concat(F.slice(ring, 2, F.size(ring) - 1), F.slice(ring, 1, 1))
    return F.zip_with(ring, shifted, lambda a, b: F.struct(
        a[0].alias("ax"), a[1].alias("ay"), b[0].alias("bx"), b[1].alias("by")
    ))


def ring_centroid(ring: Column) -> Column:
    """struct(lon, lat) of the centre of area; the mean of the points where there is no area."""
    zero = F.struct(*[F.lit(0.0).alias(n) for n in ("area", "x", "y")])

    def add(acc: Column, e: Column) -> Column:
        cross = e["ax"] * e["by"] - e["bx"] * e["ay"]
        return F.struct(
            (acc["area"] + cross).alias("area"),
            (acc["x"] + (e["ax"] + e["bx"]) * cross).alias("x"),
            (acc["y"] + (e["ay"] + e["by"]) * cross).alias("y"),
        )

    def mean(i: int) -> Column:
        return F.aggregate(_axis(ring, i), F.lit(0.0), lambda a, v: a + v) / F.size(ring)

    sums = F.aggregate(ring_edges(ring), zero, add)
    flat = F.abs(sums["area"] * 0.5) < 1e-12
    scale = F.nullif(3.0 * sums["area"], F.lit(0.0))
    centre = F.struct(
        F.when(flat, mean(0)).otherwise(sums["x"] / scale).alias("lon"),
        F.when(flat, mean(1)).otherwise(sums["y"] / scale).alias("lat"),
    )
    return F.when(F.size(ring) >= 3, centre)


def commune_labels(features: DataFrame) -> DataFrame:
    """Code, name and label position of each commune polygon."""
    ring = largest_ring(all_rings(F.col("geometry.type"), F.col("geometry.coordinates")))
    centre = ring_centroid(F.col("__ring"))
    return commune_features(features).withColumn("__ring", ring).select(
        "codigo_geo", "nombre_comuna", centre["lon"].alias("lon_label"),
        centre["lat"].alias("lat_label"),
    )


def in_ring(x: Column, y: Column, edges: Column) -> Column:
    """Whether a ray from the point crosses the ring an odd number of times."""
    def cross(inside: Column, e: Column) -> Column:
        spans = (e["ay"] > y) != (e["by"] > y)
        at = (e["bx"] - e["ax"]) * (y - e["ay"]) / F.nullif(e["by"] - e["ay"], F.lit(0.0)) + e["ax"]
        return inside != F.coalesce(spans & (x < at), F.lit(False))

    return F.aggregate(edges, F.lit(False), cross)


def urban_rings(features: DataFrame) -> DataFrame:
    """One row per exterior ring, with its box, edges and the grid it is filed under.

    The grid of a ring has cells at least as wide as its box, so that a ring lies in at
    most four cells whatever its size.
    """
    ring = F.explode(outer_rings(F.col("geometry.type"), F.col("geometry.coordinates")))
    boxed = features.select(ring.alias("ring")).withColumn("box", ring_box(F.col("ring")))
    width = F.greatest(F.col("box.x1") - F.col("box.x0"), F.col("box.y1") - F.col("box.y0"))
    return boxed.select(
        "box", ring_edges(F.col("ring")).alias("edges"),
        F.ceil(F.log2(F.greatest(width, F.lit(1e-9)))).cast("int").alias("level"),
    )


def _cell(value: Column, level: Column) -> Column:
    return F.floor(value / F.pow(F.lit(2.0), level)).cast("bigint")


def points_in_area(points: DataFrame, rings: DataFrame, x: str = "lon", y: str = "lat",
                   ray_edges: int = cover.CELL_EDGES) -> DataFrame:
    """The distinct points that lie in any ring: equality join on grid cells, then box,
    then ray. A point is filed once per grid in use.

    Rings of more than `ray_edges` edges are cut into cells, and the ray goes through the edges
    of the point's cell only; the result is the same.
    """
    box, large = F.col("box"), F.size("edges") > ray_edges
    most, used = rings.agg(F.max(F.size("edges")), F.collect_set("level")).first()
    cut = (most or 0) > ray_edges
    if cut:  # equal rings are one node, whatever the order in which the features are read
        rings = materialise(rings.withColumn("node", F.sha2(F.to_json("edges"), 256)).dropDuplicates(["node"]), "rings")
    filed = rings.withColumn("cx", F.explode(F.sequence(
        _cell(box["x0"], F.col("level")), _cell(box["x1"], F.col("level"))
    ))).withColumn("cy", F.explode(F.sequence(
        _cell(box["y0"], F.col("level")), _cell(box["y1"], F.col("level"))
    )))
    levels = F.array(*map(F.lit, used)).cast("array<int>")
    asked = (
        points.select(x, y).distinct().withColumn("level", F.explode(levels))
        .withColumns({"cx": _cell(F.col(x), F.col("level")), "cy": _cell(F.col(y), F.col("level"))})
    )
    in_box = F.col(x).between(box["x0"], box["x1"]) & F.col(y).between(box["y0"], box["y1"])
    near = ["level", "cx", "cy"]
    ray = asked.join(filed.where(~large) if cut else filed, near).where(
        in_box & in_ring(F.col(x), F.col(y), F.col("edges"))).select(x, y)
    if not cut:
        return ray.distinct()
    boxes = filed.where(large).select(*near, "box", "node")
    maybe = asked.join(boxes, near).where(in_box).select("node", F.col(x).alias("x"), F.col(y).alias("y"))
    inside = cover.in_cover(maybe, cover.cover(rings.where(large)), in_ring)
    return ray.union(inside.select(F.col("x").alias(x), F.col("y").alias(y))).distinct()


def line_points(features: DataFrame, name: str = "corredor") -> DataFrame:
    """One row per vertex: corridor, feature, part, position, lon, lat."""
    label = strip(F.coalesce(F.col("properties")["corredor_dataset"], F.lit("")))
    parts = line_parts(F.col("geometry.type"), F.col("geometry.coordinates"))
    return (
        features.select(label.alias(name), "feature_id", F.posexplode(parts).alias("part", "points"))
        .where(F.col(name) != "")
        .select(name, "feature_id", "part", F.posexplode("points").alias("seq", "p"))
        .select(name, "feature_id", "part", "seq", F.col("p")[0].alias("lon"), F.col("p")[1].alias("lat"))
    )


def clip_lines(points: DataFrame, rings: DataFrame, name: str = "corredor") -> DataFrame:
    """Runs of at least two consecutive vertices inside the area, numbered per part.

    A part was one value of one row, so a window over a part is bounded by that row."""
    part = [name, "feature_id", "part"]
    inside = points.join(points_in_area(points, rings), ["lon", "lat"], "left_semi")
    run = F.col("seq") - F.row_number().over(Window.partitionBy(*part).orderBy("seq"))
    in_run = Window.partitionBy(*part, "run")
    return (
        inside.withColumn("run", run).withColumn("n_points", F.count(F.lit(1)).over(in_run))
        .where(F.col("n_points") >= 2)
        .withColumn("position", F.row_number().over(in_run.orderBy("seq")) - 1)
        .select(*part, "run", "position", "n_points", "lon", "lat")
    )


def corridor_labels(segments: DataFrame, name: str = "corredor") -> DataFrame:
    """Label position of a corridor: mean of the middle vertices of its runs."""
    middle = segments.where(F.col("position") == F.floor(F.col("n_points") / 2))
    return middle.groupBy(name).agg(F.avg("lon").alias("lon"), F.avg("lat").alias("lat"))


def thin_lines(segments: DataFrame, max_points: int, name: str = "corredor") -> DataFrame:
    """Keep every n-th vertex and the last of each run so that about max_points remain."""
    total = segments.agg(F.count(F.lit(1))).scalar()
    step = F.greatest(F.lit(1).cast("bigint"), F.ceil(total / F.lit(max_points)))
    run = Window.partitionBy(name, "feature_id", "part", "run")
    regular = F.col("position") % F.col("__step") == 0
    place = F.struct("lon", "lat")
    last_regular = F.max_by(place, F.when(regular, F.col("position"))).over(run)
    last = (F.col("position") == F.col("n_points") - 1) & (place != last_regular)
    return (
        segments.withColumn("__step", step).withColumn("__keep", regular | last)
        .where("__keep").drop("__step", "__keep")
    )
