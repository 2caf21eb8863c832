"""Spatio-temporal noise: rows that density clustering would leave without a cluster.

A point is noise when no core point lies within eps, and a point is core when at least
`min_points` rows do. Only that is needed here, not the clusters, so no graph is walked.
Points are cut into cells whose diagonal is eps: in a cell with enough rows every point
is core. Only the few points of the other cells have to look at their neighbours.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from viario.config import NOISE_EPS, NOISE_MIN_POINTS
from viario.operators.stats import standardised
from viario.storage import materialise

COORDINATES = ("simm_lat", "simm_lon")
CELL_POINTS = 1_000_000  # points of one cell that are compared in one task


def _names(n: int, prefix: str) -> list[str]:
    return [f"{prefix}{i}" for i in range(n)]


def _near_cells(df: DataFrame, axes: int) -> DataFrame:
    """One row per cell that can hold points within eps."""
    reach = math.ceil(math.sqrt(axes))
    for c in _names(axes, "c"):
        df = df.withColumn(c, F.explode(F.sequence(F.col(c) - reach, F.col(c) + reach)))
    return df


def _within(axes: int, eps: float, left: str, right: str) -> Column:
    squares = [(F.col(f"{left}{i}") - F.col(f"{right}{i}")) ** 2 for i in range(axes)]
    return reduce(lambda a, b: a + b, squares) <= eps * eps


def noise_points(
    points: DataFrame, columns: list[str], weight: str, eps: float, min_points: int,
    cell_points: int = CELL_POINTS,
) -> DataFrame:
    """Noise among distinct points `columns` (already scaled as z0, z1, ..) with row counts."""
    axes = len(columns)
    side = eps / math.sqrt(axes) * (1 - 1e-9)
    z, c = _names(axes, "z"), _names(axes, "c")
    placed = points.withColumns({
        cell: F.floor(F.col(axis) / side).cast("bigint") for cell, axis in zip(c, z)
    })
    cells = placed.groupBy(*c).agg(
        (F.sum(weight) >= min_points).alias("dense"),
        F.ceil(F.count(F.lit(1)) / cell_points).alias("salts"),
    )
    placed = materialise(
        placed.join(cells, c).withColumn("salt", F.pmod(F.xxhash64(*columns), "salts")), "points"
    )
    cells = placed.select(*c, "dense", "salts").distinct()

    other = placed.select(
        *c, "salt", F.col(weight).alias("w"), *[F.col(a).alias(f"o{a}") for a in z]
    )
    sparse = placed.where(~F.col("dense")).select(*columns, *z, *c)
    asked = (
        _near_cells(sparse, axes).join(cells, c)
        .withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("salts") - 1)))
    )
    around = (
        asked.join(other, [*c, "salt"]).where(_within(axes, eps, "z", "oz"))
        .groupBy(*columns).agg(F.sum("w").alias("near"), F.max("dense").alias("by_dense"))
    )
    judged = sparse.join(around, columns)
    is_core = F.col("near") >= min_points
    undecided = judged.where(~is_core & ~F.col("by_dense")).select(*columns, *z, *c)
    cores = judged.where(is_core).select(*c, *[F.col(a).alias(f"o{a}") for a in z])
    reached = (
        _near_cells(undecided, axes).join(cores, c).where(_within(axes, eps, "z", "oz"))
        .select(*columns).distinct()
    )
    return undecided.select(*columns).join(reached, columns, "left_anti")


def detect_noise(
    df: DataFrame, coordinates: tuple[str, ...] = COORDINATES, hour: str = "hora",
    eps: float = NOISE_EPS, min_points: int = NOISE_MIN_POINTS,
    cell_points: int = CELL_POINTS, places: DataFrame | None = None,
) -> DataFrame:
    """Add dbscan_anomaly; false everywhere when too few rows have coordinates.

    `places` is a written table with the same rows, where looking at them several times
    is cheap."""
    plain = df.withColumn("dbscan_anomaly", F.lit(False))
    if any(c not in df.columns for c in (*coordinates, hour)):
        return plain
    keys = {f"__p{i}": F.col(c).cast("double") for i, c in enumerate(coordinates)}
    keys[f"__p{len(coordinates)}"] = F.coalesce(F.col(hour).cast("double"), F.lit(0.0))
    keyed, source = df.withColumns(keys), (df if places is None else places).withColumns(keys)
    columns = list(keys)
    valid = reduce(lambda a, b: a & b, [F.col(c).isNotNull() & ~F.isnan(c) for c in columns])
    n, n_valid = source.agg(F.count(F.lit(1)), F.count_if(valid)).first()
    if n_valid < max(10, int(0.10 * n)):
        return plain
    rows = source.where(valid)
    points = rows.groupBy(*columns).agg(F.count(F.lit(1)).alias("__w")).withColumns(
        {f"z{i}": z for i, z in enumerate(standardised(rows, columns).values())}
    )
    noise = noise_points(points, columns, "__w", eps, min_points, cell_points)
    return (
        keyed.join(noise.withColumn("__noise", F.lit(True)), columns, "left")
        .withColumn("dbscan_anomaly", F.coalesce("__noise", F.lit(False)))
        .select(*df.columns, "dbscan_anomaly")
    )
