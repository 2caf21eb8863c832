"""The road-criticality index."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from viario.config import DOCUMENTED_ICV
from viario.operators.features import weekdays
from viario.operators.stats import column_facts, filled_scaled_column, scaled_column


MEASURES = ["velocidad_km_h", "intensidad", "ocupacion", "poblacion_2019"]


def add_icv(df: DataFrame, config: dict) -> DataFrame:
    """Index 0..100: slow, busy, occupied, and more so where more people live.

    The table is read once for the ends of all columns, once for each column with gaps to
    find its median, and once for the index. Give it a written table, not a long plan."""
    w, facts = config["icv"], column_facts(df, MEASURES)
    base = (
        w["peso_velocidad"] * (1 - scaled_column("velocidad_km_h", facts["velocidad_km_h"]))
        + w["peso_intensidad"] * scaled_column("intensidad", facts["intensidad"])
        + w["peso_ocupacion"] * filled_scaled_column(df, "ocupacion", facts.get("ocupacion"))
    )
    people = filled_scaled_column(df, "poblacion_2019", facts.get("poblacion_2019"))
    raised = w["escala"] * base * (1 + w["peso_poblacion"] * people)
    limited = F.greatest(F.lit(0.0), F.least(F.lit(float(w["escala"])), raised))
    return df.withColumn("icv", F.when(raised.isNotNull(), F.bround(limited, 2)))


def documented_icv(df: DataFrame, weights: dict | None = None) -> DataFrame:
    """The documented variant: three weighted terms, on weekdays in wide peak hours."""
    w = DOCUMENTED_ICV if weights is None else weights
    rows = weekdays(df).where(F.col("hora").isin(w["horas_pico"]))
    facts = column_facts(rows, MEASURES)
    terms = [
        w["peso_velocidad"] * (1 - scaled_column("velocidad_km_h", facts["velocidad_km_h"])),
        w["peso_intensidad"] * scaled_column("intensidad", facts["intensidad"]),
        w["peso_poblacion"] * filled_scaled_column(rows, "poblacion_2019", facts.get("poblacion_2019")),
    ]
    return rows.withColumn("icv", F.bround(w["escala"] * reduce(lambda a, b: a + b, terms), 2))
