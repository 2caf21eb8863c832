"""Joins that bring the small tables to the measurements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from viario.functions.text import area_key
from viario.operators.small import join_groups
from viario.schema import has
from viario.storage import materialise


GRAM = 3  # characters of the pieces by which names meet


def _grams(text: str, size: Column) -> Column:
    """The different pieces of `size` characters of a text, as many as its length at most."""
    at = F.when(F.length(text) >= size, F.sequence(F.lit(1), F.length(text) - size + 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(at, lambda i: F.substr(F.col(text), i, size)))


def containing(short: DataFrame, long: DataFrame, inner: str, outer: str, gram: int = GRAM) -> DataFrame:
    """Rows of both tables for which the text `inner` lies inside the text `outer`; neither table repeats its text.

    All pieces of an inner text occur in an outer one, so its rarest piece alone is looked up
    and the texts are compared then. An inner text shorter than `gram` is its own piece. The
    rows built are linear in the length of the texts, no pair without a common piece is built,
    and empty or missing texts are in none."""
    pieces = long.withColumn("gram", F.explode(F.concat(*[_grams(outer, F.lit(n)) for n in range(1, gram + 1)])))
    often = pieces.groupBy("gram").agg(F.count("*").alias("n"))
    own = short.where(F.length(inner) > 0).withColumn("gram", F.explode(_grams(inner, F.least(F.length(inner), F.lit(gram)))))
    # A piece that no outer text has rules the inner text out.
    counted = own.join(often, "gram", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    rarest = counted.groupBy(*short.columns).agg(F.min(F.struct("n", "gram")).alias("least")).where("least.n > 0")
    probes = rarest.select(*short.columns, F.col("least.gram").alias("gram"))
    return probes.join(pieces, "gram").where(F.contains(F.col(outer), F.col(inner))).drop("gram")


def match_names(
    names: DataFrame, areas: DataFrame, area_name: str, value: str, position: str
) -> DataFrame:
    """(key, value) for the distinct area keys in `names.key`.

    An equal key wins. Else the first area whose key contains the name's key or lies
    inside it. Containment is an equality join on the rarest piece of the shorter text, so
    no pair of unrelated names is ever built. Of equal area keys the first gives the
    position and the last gives the value.
    """
    table = areas.select(
        area_key(F.col(area_name)).alias("area"), F.col(value).alias("v"),
        F.col(position).alias("pos"),
    ).groupBy("area").agg(F.min("pos").alias("pos"), F.max_by("v", "pos").alias("v"))
    table = materialise(table, "areas")
    keys = names.select("key").dropna().distinct()
    exact = keys.join(table, F.col("key") == F.col("area")).select("key", "v")
    open_keys = keys.join(table, F.col("key") == F.col("area"), "left_anti").where("key <> ''")
    named = table.where("area <> ''")
    found = (
        containing(named, open_keys, "area", "key").select("key", "pos", "v")
        .unionByName(containing(open_keys, named, "key", "area").select("key", "pos", "v"))
    )
    partial = found.groupBy("key").agg(F.min(F.struct("pos", "v")).alias("best"))
    return exact.unionByName(partial.select("key", F.col("best.v").alias("v"))).withColumnRenamed(
        "v", value
    )


def join_population(
    df: DataFrame, areas: DataFrame | None, *, name: str = "nombre_comuna",
    area_name: str = "nombre_area", value: str = "total_2019", position: str = "posicion",
    result: str = "poblacion_2019",
) -> DataFrame:
    """Value of the area whose name matches; only distinct names are looked up."""
    if areas is None or not has(areas, area_name, value) or not has(df, name):
        return df.withColumn(result, F.lit(None).cast("double"))
    names = _name_keys(df, name)
    matched = match_names(names, areas, area_name, value, position).select(
        "key", F.col(value).cast("double").alias(result)
    )
    return _by_name(df, name, names.join(matched, "key", "left").drop("key"))


def _name_keys(df: DataFrame, name: str) -> DataFrame:
    """(__name, key) of the distinct names, written once: the key is made per name, and the facts are read once.

    The empty key of a missing or unreadable name is null, which matches nothing."""
    distinct = df.select(F.coalesce(name, F.lit("")).alias("__name")).distinct()
    return materialise(distinct.withColumn("key", F.nullif(area_key(F.col("__name")), F.lit(""))), "names")


def _by_name(df: DataFrame, name: str, figures: DataFrame) -> DataFrame:
    named = df.withColumn("__name", F.coalesce(name, F.lit("")))
    return join_groups(named, figures, ["__name"]).drop("__name")


def join_counts(
    df: DataFrame, counts: DataFrame | None, *, name: str = "nombre_comuna",
    value: str = "volumen_total_hora", result: str = "aforo_medio",
) -> DataFrame:
    """Mean count of the area; spellings of one name share one mean, so no row is doubled."""
    if counts is None or not has(counts, name, value) or not has(df, name):
        return df.withColumn(result, F.lit(None).cast("double"))
    by_spelling = counts.dropna(subset=[name]).groupBy(name).agg(
        F.sum(value).alias("s"), F.count(value).alias("n")
    )
    means = by_spelling.groupBy(area_key(F.col(name)).alias("key")).agg(
        F.try_divide(F.sum("s"), F.sum("n")).alias(result)
    ).where("key <> ''")
    return _by_name(df, name, _name_keys(df, name).join(means, "key", "left").drop("key"))


SENSOR_MEANS = {
    "velocidad": "simm_vel_media", "intensidad": "simm_int_media",
    "lat": "simm_lat", "lon": "simm_lon",
}


def join_sensors(df: DataFrame, sensors: DataFrame | None, *, key: str = "corredor") -> DataFrame:
    """Sensor means per corridor: speed, flow and place."""
    used = {}
    if sensors is not None and has(sensors, key):
        used = {s: d for s, d in SENSOR_MEANS.items() if has(sensors, s)}
        placed = has(sensors, "lat", "lon")
        measured = has(sensors, "velocidad") or has(sensors, "intensidad")
        used = {s: d for s, d in used.items()
                if measured and (placed or s not in ("lat", "lon"))}
    missing = {d: F.lit(None).cast("double") for s, d in SENSOR_MEANS.items() if s not in used}
    if used:
        means = sensors.dropna(subset=[key]).groupBy(key).agg(
            *[F.avg(s).alias(d) for s, d in used.items()]
        )
        df = join_groups(df, means, [key])
    return df.withColumns(missing) if missing else df


def flag_members(df: DataFrame, members: DataFrame, key: str, name: str) -> DataFrame:
    """Whether the key occurs in another table."""
    marks = members.select(key).dropna().distinct().withColumn(name, F.lit(True))
    return join_groups(df, marks, [key]).withColumn(name, F.coalesce(name, F.lit(False)))


def available(selected: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """The selected keys that exist."""
    return selected.join(existing.select(key), key, "left_semi")
