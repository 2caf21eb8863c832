"""Parameters and fixed values shared by the operators."""

from __future__ import annotations

import copy

# Results depend on them, so they must not be changed.
# ---------------------------------------------------------------------------
PARAMETERS = {
    "paths": {
        "raw": "data/raw",
        "processed": "data/processed",
    },
    "files": {
        "velocidad": "velocidad_e_intensidad_vehicular_en_medellin.csv",
        "aforos": "Aforos_Vehiculares.csv",
        "simm": "simmtrafficdata.csv",
        "pasajeros": "Pasajeros_movilizados.csv",
        "poblacion": "proyecciones_de_poblacion_medellin_2019.csv",
        "ciclorrutas": "Ciclorrutas.csv",
    },
    "eta": {
        "hora_pico_manana": [7, 8],
        "hora_pico_tarde": [17, 18],
        "franjas": {
            "madrugada": [0, 1, 2, 3, 4],
            "manana": [5, 6, 7, 8, 9, 10],
            "mediodia": [11, 12, 13],
            "tarde": [14, 15, 16, 17, 18],
            "noche": [19, 20, 21, 22, 23],
        },
    },
    "icv": {
        "peso_velocidad": 0.40,
        "peso_intensidad": 0.35,
        "peso_ocupacion": 0.25,
        "peso_poblacion": 0.15,
        "escala": 100,
    },
    "ivc": {"top_corredores": 15, "capacidad_base": 2500, "velocidad_libre": 60},
    "rankings": {
        "top_corredores": 10,
        "top_comunas": 5,
        "hotspot_velocidad_pct": 30,
        "hotspot_intensidad_pct": 70,
        "solo_dias_habiles": True,
    },
}

# The documented variant of the index: other weights, wider peaks.
DOCUMENTED_ICV = {
    "peso_velocidad": 0.40,
    "peso_intensidad": 0.40,
    "peso_poblacion": 0.20,
    "escala": 100,
    "horas_pico": [6, 7, 8, 9, 17, 18, 19, 20],
}

SLOT_ORDER = ["madrugada", "manana", "mediodia", "tarde", "noche"]
UNKNOWN_SLOT = "desconocida"
UNKNOWN_CORRIDOR = "DESCONOCIDO"

DAY_NAMES = {
    1: "Lunes", 2: "Martes", 3: "Miercoles", 4: "Jueves",
    5: "Viernes", 6: "Sabado", 7: "Domingo",
}
DAY_SHORT = {1: "Lun", 2: "Mar", 3: "Mié", 4: "Jue", 5: "Vie", 6: "Sáb", 7: "Dom"}

TRUE_WORDS = ["true", "1", "yes", "si", "t", "y"]
FALSE_WORDS = ["false", "0", "no", "n", "f", ""]

POPULATION_TOTAL_ROWS = ["Suma Comunas", "Total Medellín", "Total", "Suma Corregimientos"]

SEVERITY_LEVELS = ["NORMAL", "MODERADO", "ALTO", "CRÍTICO"]
SEVERITY_BOUNDS = [25.0, 50.0, 75.0]
DETECTOR_WEIGHTS = {
    "z_score_anomaly": 25,
    "iqr_anomaly": 20,
    "speed_drop_anomaly": 30,
    "isolation_forest_anomaly": 25,
}
PEAK_FACTOR = 1.2
WEEKDAY_FACTOR = 1.1
DETECTOR_COLUMNS = {
    "z_score": "z_score_anomaly",
    "iqr": "iqr_anomaly",
    "speed_drop": "speed_drop_anomaly",
    "isolation_forest": "isolation_forest_anomaly",
    "dbscan": "dbscan_anomaly",
}
ANOMALY_COLUMNS = [
    "z_score_anomaly", "iqr_anomaly", "speed_drop_anomaly", "speed_drop_pct",
    "isolation_forest_anomaly", "isolation_score", "dbscan_anomaly",
    "anomaly_score", "severity_level",
]

Z_WINDOW, Z_MIN_ROWS, Z_THRESHOLD = 24, 24, 2.5
IQR_FACTOR, IQR_MIN_ROWS = 1.5, 4
SPEED_DROP_PCT = 30.0
FOREST = {"trees": 50, "subsample": 256, "contamination": 0.05, "seed": 42}
FOREST_FEATURES = ["velocidad_km_h", "intensidad", "ocupacion", "hora", "dia_num", "icv"]
NOISE_EPS, NOISE_MIN_POINTS = 0.5, 5

FLOW_CLASSES = {
    "both": "Crítico (Baja vel + Alto flujo)",
    "flow": "Alto flujo",
    "slow": "Baja velocidad",
    "none": "Normal",
}
INTERVENTIONS = {
    "several": "Multiples Intervenciones",
    "signals": "Gestion Semafórica",
    "routes": "Rutas Alternas",
    "transit": "Transporte Sostenible",
    "none": "Sin clasificar",
}
CAPACITY_BY_KEYWORD = [
    (["REGIONAL", "SURAMERICANA", "PARALELA"], 5400),
    (["ORIENTAL", "AV 80", "AV65", "SAN JUAN"], 3600),
]
DEFAULT_CAPACITY = 1800
SERVICE_LEVELS = [(0.4, "Fluido (A/B)"), (0.7, "Moderado (C/D)"), (0.9, "Congestionado (E)")]
SATURATED = "Saturado (F)"
PANDEMIC_START = "2020-03-01"

MASTER_COLUMNS = {
    "hora": "int", "dia_num": "int", "velocidad_km_h": "double", "corredor": "string",
    "intensidad": "double", "ocupacion": "double", "codigo_comuna": "string",
    "nombre_comuna": "string", "es_fin_semana": "boolean", "franja_horaria": "string",
    "es_hora_pico": "boolean", "poblacion_2019": "double", "icv": "double",
}
PASSENGER_COLUMNS = {"ano": "int", "num_mes": "int", "semestre": "int", "total_pax": "double"}
COMMUNE_MAP_COLUMNS = {
    "codigo_geo": "string", "nombre_comuna": "string", "icv_medio": "double",
    "registros": "bigint", "velocidad_media": "double", "intensidad_media": "double",
    "corredores_activos": "bigint", "comuna_mapa": "string",
}
OFFICIAL_COMMUNE_COLUMNS = {
    "codigo_geo": "string", "nombre_comuna": "string", "lon_label": "double",
    "lat_label": "double", "icv_medio": "double", "registros": "bigint",
    "velocidad_media": "double", "intensidad_media": "double",
    "corredores_activos": "bigint", "comuna_mapa": "string",
}

# Text columns that are cleaned, per dataset.
CLEANED_FILES = {
    "aforos": {
        "filename": PARAMETERS["files"]["aforos"], "encoding": "utf-8", "separator": ",",
        "text": ["VÍA_PRINCIPAL", "VÍA_SECUNDARIA", "MOVIMIENTO", "ACCESO", "MES",
                 "INTERSECCIÓN", "TIPO_DE_DIA", "COMUNA", "NOMBRE_COMUNA", "CONSULTOR",
                 "DÍA_AFORO"],
    },
    "ciclorrutas": {
        "filename": PARAMETERS["files"]["ciclorrutas"], "encoding": "utf-8", "separator": ",",
        "text": ["nombre", "estado"],
    },
    "pasajeros": {
        "filename": PARAMETERS["files"]["pasajeros"], "encoding": "utf-8-sig", "separator": ",",
        "text": ["MES", "SEM_AÑO", "LÍNEA_O", "AÑO-MES"],
    },
    "poblacion": {
        "filename": PARAMETERS["files"]["poblacion"],
        "encoding": "utf-8", "separator": ",",
        "text": ["tipo_division_geografica", "codigo", "grupo_edad"],
    },
    "simm": {
        "filename": PARAMETERS["files"]["simm"], "encoding": "utf-8", "separator": ",",
        "text": ["CORREDOR", "DISPOSITIVO", "MES", "SENTIDO", "INDRA.MENSAJE",
                 "INDRA.PARAMETRO", "INDRA.TIPO", "INDRA.VERSION"],
    },
    "velocidad": {
        "filename": PARAMETERS["files"]["velocidad"],
        "encoding": "utf-8", "separator": ",",
        "text": ["carril", "dia", "mes", "corredor", "sentido", "operacion",
                 "tipo_subsistema", "nombre_comuna"],
    },
}
# ---------------------------------------------------------------------------


def default_config() -> dict:
    """A fresh copy of the parameters, for callers to change."""
    return copy.deepcopy(PARAMETERS)
