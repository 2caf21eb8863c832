"""The master table: measurements with features, population, counts, sensors and index."""

from __future__ import annotations

from pyspark.sql import DataFrame

from viario.operators.features import add_time_features
from viario.operators.index import add_icv
from viario.operators.joins import join_counts, join_population, join_sensors
from viario.plans.datasets import POSITION
from viario.storage import materialise


def build_master(
    speed: DataFrame, counts: DataFrame | None, sensors: DataFrame | None,
    population: DataFrame | None, config: dict,
) -> DataFrame:
    master = add_time_features(speed, config)
    if population is not None and POSITION not in population.columns:
        raise ValueError(f"the population table needs its row order in a column {POSITION}")
    master = join_population(master, population, position=POSITION)
    master = join_counts(master, counts)
    return join_sensors(master, sensors)


def build_indexed_master(
    speed: DataFrame, counts: DataFrame | None, sensors: DataFrame | None,
    population: DataFrame | None, config: dict,
) -> DataFrame:
    """The index reads the table several times, so the joined table is written first."""
    joined = materialise(build_master(speed, counts, sensors, population, config), "joined")
    return add_icv(joined, config)
