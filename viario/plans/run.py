"""Raw files to all result tables."""

from __future__ import annotations

import posixpath
import warnings

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import SparkSession

from viario.config import MASTER_COLUMNS, PASSENGER_COLUMNS
from viario.operators.ranking import (
    hotspots, rank_communes, rank_corridors, rank_corridors_by_load,
)
from viario.plans import datasets
from viario.plans.detection import AnomalyDetector
from viario.plans.master import build_indexed_master
from viario.schema import typed
from viario.sources.files import (
    FILE, ROW_NUMBER, load_dataset, read_columns, read_or_compute, write_table,
)
from viario.storage import path_exists

CLEANERS = {
    "velocidad": datasets.clean_speed, "aforos": datasets.clean_counts,
    "simm": datasets.clean_sensors, "pasajeros": datasets.clean_passengers,
    "poblacion": datasets.clean_population, "ciclorrutas": datasets.clean_bike_lanes,
}


def load_clean(spark: SparkSession, config: dict) -> dict:
    """Each dataset cleaned, or nothing for an absent file."""
    tables = {}
    for key, cleaner in CLEANERS.items():
        numbered = key == "poblacion"
        raw = load_dataset(spark, config, key, row_numbers=numbered)
        if raw is not None and numbered:
            raw = raw.drop(FILE).withColumnRenamed(ROW_NUMBER, datasets.POSITION)
        tables[key] = None if raw is None else cleaner(raw)
    return tables


def _master_of(spark: SparkSession, config: dict, tables: dict):
    speed = tables["velocidad"]
    if speed is None:
        return typed(spark.range(0), MASTER_COLUMNS)
    return build_indexed_master(
        speed, tables["aforos"], tables["simm"], tables["poblacion"], config
    )


def run(spark: SparkSession, config: dict, detect: bool = True) -> dict:
    """Load, clean, join, index, rank and detect; returns the tables by name."""
    tables = load_clean(spark, config)
    processed = str(config["paths"]["processed"])
    master = write_table(_master_of(spark, config, tables), posixpath.join(processed, "master"))
    passengers = tables["pasajeros"]
    if passengers is not None:
        passengers = write_table(passengers, posixpath.join(processed, "pasajeros_clean"))
    return {
        "master": master,
        "corredores": rank_corridors(master, config),
        "corredores_ivc": rank_corridors_by_load(master, config),
        "comunas": rank_communes(master, config),
        "hotspots": hotspots(master, config),
        "pasajeros": passengers,
        "ciclorrutas": tables["ciclorrutas"],
        "anomalias": _detect(master, config) if detect else {},
    }


def _detect(master, config: dict) -> dict:
    """The detectors' tables; when they fail, the error, and the other tables stay."""
    try:
        return AnomalyDetector(config).run(master)
    except (ValueError, PySparkException, Py4JJavaError) as error:
        warnings.warn(f"no anomalies: {error}", stacklevel=2)
        return {"error": str(error)}


def load_views(spark: SparkSession, config: dict) -> dict:
    """The written master and its companions; all steps run first when it is not there."""
    processed = str(config["paths"]["processed"])
    master_path = posixpath.join(processed, "master")
    passengers_path = posixpath.join(processed, "pasajeros_clean")

    def compute():
        return _master_of(spark, config, load_clean(spark, config))

    read_or_compute(spark, master_path, compute)
    lanes = load_dataset(spark, config, "ciclorrutas")
    period = {"fecha_periodo": "timestamp_ntz"}
    return {
        "master": read_columns(
            spark, master_path, MASTER_COLUMNS, ["es_fin_semana", "es_hora_pico"]),
        "pasajeros": read_columns(spark, passengers_path, PASSENGER_COLUMNS | period)
        if path_exists(spark, passengers_path) else None,
        "ciclorrutas": None if lanes is None else datasets.clean_bike_lanes(lanes),
        "config": config,
    }
