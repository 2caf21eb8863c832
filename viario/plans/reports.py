"""The report tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from viario import config as fixed
from viario.functions.dates import day_label, with_hour
from viario.functions.numbers import flag, no_nan
from viario.functions.text import commune_code
from viario.operators import features, ranking, stats
from viario.operators.pivots import count_pivot
from viario.operators.quantiles import quantile, quantiles, quantiles_at_once
from viario.operators.ranking import extreme_group, ranked_all, ranked_top, top_rows
from viario.schema import has, typed
from viario.storage import materialise


def mean(name: str, alias: str) -> Column:
    return F.avg(no_nan(F.col(name))).alias(alias)


def speed() -> Column:
    return mean("velocidad_km_h", "velocidad_media")


def flow() -> Column:
    return mean("intensidad", "intensidad_media")


def icv() -> Column:
    return mean("icv", "icv_medio")


def indexed_rows() -> Column:
    return F.count("icv").alias("n_registros")


def peak_share(df: DataFrame, alias: str = "pct_hora_pico") -> Column:
    return (F.avg(flag(df, "es_hora_pico").cast("int")) * 100).alias(alias)


def group_means(df: DataFrame, key: str, *aggregates: Column) -> DataFrame:
    return df.dropna(subset=[key]).groupBy(key).agg(*aggregates)


def overview(df: DataFrame) -> DataFrame:
    """One row: rows, date range, distinct corridors and communes, weekday and peak shares."""
    weekend, peak = flag(df, "es_fin_semana"), flag(df, "es_hora_pico")
    total = F.count(F.lit(1))
    return df.agg(
        total.alias("n_total"), F.min("fecha_trafico").alias("fecha_min"),
        F.max("fecha_trafico").alias("fecha_max"),
        F.countDistinct("corredor").alias("n_corredores"),
        F.countDistinct("nombre_comuna").alias("n_comunas"),
        F.count_if(~weekend).alias("n_semana"), F.count_if(weekend).alias("n_fin_semana"),
        F.count_if(peak).alias("n_hora_pico"),
        (100.0 * F.count_if(~weekend) / total).alias("pct_semana"),
        (100.0 * F.count_if(peak) / total).alias("pct_hora_pico"),
    )


def overview_measures(df: DataFrame) -> DataFrame:
    return stats.describe(df, ["icv", "velocidad_km_h"])


def speed_by_slot(df: DataFrame) -> DataFrame:
    return group_means(
        df, "franja_horaria", speed(), F.stddev_samp("velocidad_km_h").alias("velocidad_std"),
        F.count("velocidad_km_h").alias("n_registros"), icv(),
    ).orderBy("velocidad_media")


def icv_by_day(df: DataFrame) -> DataFrame:
    by_day = group_means(df, "dia_num", icv(), F.stddev_samp("icv").alias("icv_std"), speed(), indexed_rows())
    label = F.nullif(day_label(F.col("dia_num"), unknown=""), F.lit(""))
    return by_day.select(
        "dia_num", label.alias("dia"), "icv_medio", "icv_std", "velocidad_media", "n_registros"
    ).orderBy("dia_num")


def worst_hours(df: DataFrame, n: int = 5) -> DataFrame:
    return top_rows(group_means(df, "hora", icv(), indexed_rows(), speed(), flow()), n, "icv_medio", "hora")


def corridor_profile(df: DataFrame, *more: Column) -> DataFrame:
    """Weekday measures per corridor."""
    return group_means(
        features.weekdays(df), "corredor", icv(), F.max("icv").alias("icv_maximo"), speed(), flow(),
        mean("ocupacion", "ocupacion_media"), indexed_rows(), peak_share(df), *more,
    )


def critical_corridors(df: DataFrame, n: int = 10) -> DataFrame:
    return ranked_top(corridor_profile(df), n, "icv_medio", "corredor")


def commune_pressure(df: DataFrame) -> DataFrame:
    """All communes in peak hours, with vehicles per thousand inhabitants."""
    table = group_means(
        features.peak_hours(df), "nombre_comuna", icv(), F.max("icv").alias("icv_maximo"), speed(),
        flow(), indexed_rows(), F.max("poblacion_2019").alias("poblacion_2019"),
    )
    per_thousand = F.when(
        F.col("poblacion_2019") > 0, F.col("intensidad_media") / F.col("poblacion_2019") * 1000
    )
    return ranked_all(
        table.withColumn("vehiculos_por_1000hab", per_thousand), "icv_medio", "nombre_comuna"
    )


def first_value(df: DataFrame, key: str, value: str, order: list[str], name: str) -> DataFrame:
    """First present value per group in the given order."""
    present = df.dropna(subset=[key, value])
    return present.groupBy(key).agg(F.min_by(value, F.struct(*order)).alias(name))


def hotspot_places(df: DataFrame, config: dict, n: int = 20) -> DataFrame:
    """(corridor, commune) pairs with the most hotspot rows."""
    pairs = ranking.hotspots(df, config).dropna(subset=["corredor", "nombre_comuna"]).groupBy(
        "corredor", "nombre_comuna"
    ).agg(F.count("icv").alias("n_eventos"), speed(), flow(), icv(), peak_share(df, "hora_pico_pct"))
    return ranked_top(pairs, n, "n_eventos", "corredor", "nombre_comuna")


def hotspot_slots(df: DataFrame, config: dict) -> DataFrame:
    slots = group_means(
        ranking.hotspots(df, config), "franja_horaria", F.count("icv").alias("n_eventos"),
        speed(), flow(), icv(),
    )
    return stats.share_of_total(slots, "n_eventos", "pct_del_total").orderBy(
        F.desc("n_eventos"), "franja_horaria"
    )


def intervention_cells(df: DataFrame, config: dict) -> DataFrame:
    """One row per (corridor, commune): sums over weekday rows and the number of hotspot rows.

    Two reads give the quantiles, a third one the cells, which are written; nothing else reads `df`."""
    day = ~flag(df, "es_fin_semana") if has(df, "es_fin_semana") else F.lit(True)
    limits = quantiles_at_once(df, {
        **{c: (F.col(c), p) for c, p in ranking.hotspot_shares(config).items()},
        "busy": (F.when(day, F.col("intensidad")), 0.80)})
    added = {m: F.when(day, no_nan(F.col(m))) for m in (
        "icv", "velocidad_km_h", "intensidad", "ocupacion", "poblacion_2019")}
    added["pico"] = F.when(day, flag(df, "es_hora_pico").cast("int"))
    sums = [c for m, v in added.items() for c in (F.sum(v).alias(f"{m}__sum"), F.count(v).alias(f"{m}__n"))]
    cells = df.dropna(subset=["corredor"]).groupBy("corredor", "nombre_comuna").agg(
        *sums, F.max(F.when(day, F.col("icv"))).alias("icv_maximo"), F.count(F.when(day, F.col("icv"))).alias("n_registros"),
        F.count_if(day).alias("n_dias"), F.count_if(ranking.is_hotspot(limits)).alias("n_eventos"))
    return materialise(cells.withColumn("busy", limits["busy"]), "intervention-cells")


def interventions(df: DataFrame, config: dict) -> DataFrame:
    """Weekday corridor profiles with the kind of intervention they call for."""
    cells = intervention_cells(df, config)

    def average(m: str) -> Column:
        return F.try_divide(F.sum(f"{m}__sum"), F.sum(f"{m}__n"))

    profile = cells.groupBy("corredor").agg(
        average("icv").alias("icv_medio"), F.max("icv_maximo").alias("icv_maximo"),
        average("velocidad_km_h").alias("velocidad_media"), average("intensidad").alias("intensidad_media"),
        average("ocupacion").alias("ocupacion_media"), F.sum("n_registros").alias("n_registros"),
        (average("pico") * 100).alias("pct_hora_pico"), average("poblacion_2019").alias("poblacion_2019"),
        F.min(F.when((F.col("n_dias") > 0) & F.col("nombre_comuna").isNotNull(), F.struct(
            (-F.col("n_dias")).alias("rarity"), "nombre_comuna")))["nombre_comuna"].alias("nombre_comuna"),
        F.max((F.col("n_eventos") > 0) & F.col("nombre_comuna").isNotNull()).alias("__spot"),
        F.first("busy").alias("__busy"), F.sum("n_dias").alias("__days"),
    ).where(F.col("__days") > 0)
    populous = quantile(profile, "poblacion_2019", 0.67)
    yes = {
        "signals": (F.col("icv_medio") >= 50) & (F.col("velocidad_media") < 25),
        "routes": (F.col("intensidad_media") >= F.col("__busy")) & (F.col("icv_medio") >= 45),
        "transit": F.col("__spot") & (F.col("poblacion_2019") >= populous),
    }
    yes = {k: F.coalesce(c, F.lit(False)) for k, c in yes.items()}
    names = fixed.INTERVENTIONS
    several = sum((c.cast("int") for c in yes.values()), F.lit(0)) >= 2
    kind = F.when(several, names["several"])
    for k, c in yes.items():
        kind = kind.when(c, names[k])
    return profile.withColumn("intervencion", kind.otherwise(names["none"])).drop("__spot", "__busy", "__days")


def intervention_counts(df: DataFrame, config: dict) -> DataFrame:
    counts = stats.value_counts(interventions(df, config), "intervencion", "n_corredores")
    return stats.share_of_total(counts, "n_corredores", "pct").orderBy(
        F.desc("n_corredores"), "intervencion"
    )


def severity_counts(anomalies: DataFrame) -> DataFrame:
    counts = stats.value_counts(anomalies, "severity_level")
    return stats.share_of_total(counts, "n", "pct").orderBy(F.desc("n"), "severity_level")


def anomalous_corridors(anomalies: DataFrame, n: int = 20) -> DataFrame:
    """Corridors with the most anomalies, with one column per severity level."""
    top = top_rows(group_means(
        anomalies, "corredor", F.count(F.lit(1)).alias("n_anomalias"), icv(), speed(), flow(),
        mean("anomaly_score", "anomaly_score_med"),
    ), n, "n_anomalias", "corredor")
    levels = count_pivot(anomalies, "corredor", "severity_level", fixed.SEVERITY_LEVELS[1:])
    return top.join(levels, "corredor", "left").orderBy(F.desc("n_anomalias"), "corredor")


def anomalous_communes(anomalies: DataFrame) -> DataFrame:
    return group_means(
        anomalies, "nombre_comuna", F.count(F.lit(1)).alias("n_anomalias"), icv(), speed()
    ).orderBy(F.desc("n_anomalias"), "nombre_comuna")


def anomalous_slots(anomalies: DataFrame) -> DataFrame:
    return group_means(
        anomalies, "franja_horaria", F.count("corredor").alias("n_anomalias"), icv()
    ).orderBy(F.desc("n_anomalias"), "franja_horaria")


def icv_by_hour(df: DataFrame) -> DataFrame:
    return group_means(df, "hora", icv()).orderBy("hora")


def passenger_trend(passengers: DataFrame) -> DataFrame:
    """Passengers per period; periods from the start of the pandemic are marked."""
    if has(passengers, "fecha_periodo"):
        period, start = F.col("fecha_periodo"), F.lit(fixed.PANDEMIC_START).cast("timestamp_ntz")
    else:
        period, start = F.col("ano").cast("int"), F.lit(int(fixed.PANDEMIC_START[:4]))
    rows = passengers.select(period.alias("fecha_periodo"), "total_pax").dropna()
    return rows.groupBy("fecha_periodo").agg(F.sum("total_pax").alias("total_pax")).withColumn(
        "pandemia", F.col("fecha_periodo") >= start
    ).orderBy("fecha_periodo")


def passenger_peak(passengers: DataFrame) -> DataFrame:
    """The period with the most passengers."""
    return top_rows(
        passenger_trend(passengers).select("fecha_periodo", "total_pax"), 1, "total_pax",
        "fecha_periodo",
    )


def commune_map(df: DataFrame) -> DataFrame:
    """Figures per commune code and name for a map."""
    if not has(df, "codigo_comuna", "nombre_comuna", "icv"):
        return typed(df.sparkSession.range(0), fixed.COMMUNE_MAP_COLUMNS)
    rows = df.dropna(subset=["nombre_comuna", "icv"]).withColumn(
        "codigo_geo", commune_code(F.trim(F.col("codigo_comuna").cast("string")))
    ).dropna(subset=["codigo_geo"])
    optional = {"velocidad_km_h": speed(), "intensidad": flow(),
                "corredor": F.countDistinct("corredor").alias("corredores_activos")}
    table = rows.groupBy("codigo_geo", "nombre_comuna").agg(
        icv(), F.count(F.lit(1)).alias("registros"),
        *[c for name, c in optional.items() if has(df, name)],
    )
    label = F.concat_ws(" - ", "codigo_geo", "nombre_comuna")
    return typed(table.withColumn("comuna_mapa", label), fixed.COMMUNE_MAP_COLUMNS).orderBy("codigo_geo")


def official_communes(labels: DataFrame, df: DataFrame) -> DataFrame:
    """Every official commune with its label position, and figures where there are any."""
    figures = commune_map(df).drop("comuna_mapa")
    joined = labels.join(figures, ["codigo_geo", "nombre_comuna"], "left").withColumn(
        "comuna_mapa", F.concat_ws(" - ", "codigo_geo", "nombre_comuna")
    )
    return typed(joined, fixed.OFFICIAL_COMMUNE_COLUMNS).orderBy("codigo_geo")


def headline(df: DataFrame, config: dict) -> DataFrame:
    """One row: mean index, worst corridor and hour, number of hotspots."""
    one = {**config, "rankings": {**config["rankings"], "top_corredores": 1}}
    corridor = ranking.rank_corridors(df, one).select("corredor").scalar()
    hour = extreme_group(df, "hora", "icv").select("hora").scalar()
    spots = ranking.hotspots(df, config).agg(F.count(F.lit(1))).scalar()
    return df.agg(F.bround(F.avg("icv"), 1).alias("icv_promedio")).select(
        "icv_promedio", corridor.alias("corredor_critico"), hour.alias("hora_critica"),
        spots.alias("n_hotspots"),
    )


def anomaly_headline(anomalies: DataFrame) -> DataFrame:
    """One row: anomalies, critical ones and their share, worst corridor and hour.

    Without critical rows the corridor with the highest mean score is the worst."""
    critical = F.col("severity_level") == fixed.SEVERITY_LEVELS[3]
    counts = group_means(
        anomalies, "corredor", F.count_if(critical).alias("n"),
        mean("anomaly_score", "score"),
    )
    worst = counts.orderBy(F.desc("n"), F.when(F.col("n") == 0, F.col("score")).desc(), "corredor")
    hour = extreme_group(anomalies, "hora", "anomaly_score").select("hora").scalar()
    total = F.count(F.lit(1))
    return anomalies.agg(
        total.alias("n_anomalias"), F.count_if(critical).alias("n_criticos"),
        F.bround(100.0 * F.count_if(critical) / F.greatest(total, F.lit(1)), 1).alias("pct_criticos"),
    ).withColumns({
        "corredor_critico": worst.limit(1).select("corredor").scalar(), "hora_critica": hour,
    })


def flow_stats(df: DataFrame) -> DataFrame:
    """One row: means, and how many rows are slow and busy at once."""
    both = F.col("criticidad") == fixed.FLOW_CLASSES["both"]
    return features.flow_class(df).agg(
        speed(), flow(), icv(), F.count_if(both).alias("n_criticos"),
        (100.0 * F.count_if(both) / F.count(F.lit(1))).alias("pct_criticos"),
    )


def filtered_views(
    df: DataFrame, config: dict, communes: list[str] | None = None,
    corridors: list[str] | None = None, slot: str | None = None, day: str | None = None,
) -> dict[str, DataFrame]:
    """The rankings of a filtered table; a chosen day lifts the restriction to weekdays."""
    rows = features.apply_filters(df, communes, corridors, slot, day)
    cfg = config
    if day not in (None, "Todos"):
        cfg = {**config, "rankings": {**config["rankings"], "solo_dias_habiles": False}}
    return {
        "rows": rows,
        "corredores": ranking.rank_corridors(rows, cfg),
        "corredores_ivc": ranking.rank_corridors_by_load(rows, config),
        "comunas": ranking.rank_communes(rows, cfg),
        "hotspots": ranking.hotspots(rows, config),
    }


def bike_lanes_by_state(lanes: DataFrame) -> DataFrame:
    counts = stats.value_counts(lanes, "estado", "n_tramos")
    return stats.share_of_total(counts, "n_tramos", "pct").orderBy(F.desc("n_tramos"), "estado")


def top_service_levels(df: DataFrame, n: int = 15) -> DataFrame:
    return top_rows(ranking.service_levels(df), n, "ivc", "corredor")


def service_level_counts(df: DataFrame) -> DataFrame:
    return stats.value_counts(ranking.service_levels(df), "nivel_servicio", "n_corredores")


def hourly_means(df: DataFrame) -> DataFrame:
    """Speed and flow per hour; the slowest and the busiest hour are marked."""
    hours = group_means(df, "hora", speed(), flow())
    slowest = extreme_group(df, "hora", "velocidad_km_h", largest=False).select("hora").scalar()
    busiest = extreme_group(df, "hora", "intensidad").select("hora").scalar()
    return hours.withColumns({
        "mas_lenta": F.col("hora") == slowest, "mas_intensa": F.col("hora") == busiest,
    }).orderBy("hora")


def icv_by_slot(df: DataFrame) -> DataFrame:
    """Mean, deviation, median and maximum of the index per time slot."""
    basic = group_means(
        df, "franja_horaria", icv(), F.stddev_samp("icv").alias("icv_std"),
        F.max("icv").alias("icv_maximo"),
    )
    middle = quantiles(df, "icv", {"icv_mediana": 0.5}, ["franja_horaria"]).drop("n_values")
    return basic.join(middle, "franja_horaria", "left").orderBy("franja_horaria")


def hotspot_measures(df: DataFrame, config: dict) -> DataFrame:
    return stats.describe(ranking.hotspots(df, config), ["velocidad_km_h", "intensidad", "icv"])


def hotspot_corridors(df: DataFrame, config: dict, n: int = 10) -> DataFrame:
    counts = group_means(ranking.hotspots(df, config), "corredor", F.count(F.lit(1)).alias("n"))
    return top_rows(counts, n, "n", "corredor")


def describe_by(df: DataFrame, key: str) -> DataFrame:
    """Mean speed and flow and rows per corridor or commune, the slowest first."""
    return group_means(
        df, key, mean("velocidad_km_h", "vel_media"), mean("intensidad", "int_media"),
        F.count(F.lit(1)).alias("n_obs"),
    ).orderBy("vel_media", key)


def flow_per_speed(df: DataFrame, n: int = 10) -> DataFrame:
    """Corridors with the most flow per speed."""
    table = describe_by(df, "corredor").select("corredor", "vel_media", "int_media").withColumn(
        "ratio_iv", F.try_divide("int_media", "vel_media")
    )
    return top_rows(table, n, "ratio_iv", "corredor")


def latest_alerts(anomalies: DataFrame, n: int = 50, *ties: str) -> DataFrame:
    """The rows with the highest score."""
    return top_rows(anomalies, n, "anomaly_score", *ties)


def with_timestamp(df: DataFrame) -> DataFrame:
    return df.withColumn("timestamp", with_hour(F.col("fecha_trafico"), F.col("hora")))
