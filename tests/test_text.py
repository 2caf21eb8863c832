"""Cell rules, labels and keys."""

import pytest
from pyspark.sql import functions as F

from viario.functions import text
from viario.operators import cleaning

BROKEN = "�"
UNCHANGED = [
    "Señal única – ½ carril", "Km 12+300, Nº 7", "Ñuñoa/Maipú", "0,75", "", "dos\ttres", "x y", "«via»", "'q'r'", '"sin fin',
    "uno\ndos", "peaje 3 € …",
]
CLEANED = [
    ("\x07puente\x1b", "puente"), (BROKEN * 2, ""), ("Москва", ""), ("شارع", ""), ("東京", ""), ("p     q", "p q"),
    ("\t La Estrella \n", "La Estrella"), ('"Ruta del Sol"', "Ruta del Sol"), ("'anillo sur'", "anillo sur"),
    (" Paso\x0e  a   nivel ", "Paso a nivel"), (f"\x03\x04{BROKEN}", ""), (f"dos T{BROKEN}neles", "dos Túneles"),
    (f"V{BROKEN}{BROKEN}a libre", "Vía libre"), (f"San Crist{BROKEN}bal", "San Cristóbal"), (f"el r{BROKEN}o", "el río"),
    (f"{BROKEN}{BROKEN}XITO sur", "ÉXITO sur"), (f"DO{BROKEN}A ANA", "DOÑA ANA"), ("''", ""), (" z　", "z"), ("tren🚆via", "trenvia"),
    ("\"'tres'\"", "'tres'"), ("\t'cuatro' ", "cuatro"),
]


def cells(spark, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    out = text.clean_text(F.col("v"))
    rows = df.select("i", out.alias("c"), text.text_changed(F.col("v"), out).alias("ch")).orderBy("i")
    return [(r["c"], r["ch"]) for r in rows.collect()]


def test_clean_texts_stay(spark):
    assert cells(spark, UNCHANGED) == [(v, False) for v in UNCHANGED]


def test_dirty_texts_are_cleaned(spark):
    assert cells(spark, [v for v, _ in CLEANED]) == [(w, True) for _, w in CLEANED]


def test_null_is_empty_and_unchanged(spark):
    assert cells(spark, [None]) == [("", False)]


def test_steps_one_by_one_give_the_same(spark):
    """The rules taken one after the other, as the cell cleaner defines them."""
    df = spark.createDataFrame([(v,) for v, _ in CLEANED] + [(v,) for v in UNCHANGED], "v string")
    steps = [
        lambda c: text.repair_words(c, leading=False, drop_rest=False), text.drop_replacement_chars,
        text.drop_control_chars, text.drop_foreign_chars, text.unwrap_quotes,
        text.collapse_spaces, text.strip,
    ]
    c = F.col("v")
    for step in steps:
        c = step(c)
    assert df.where(c != text.clean_text(F.col("v"))).count() == 0


DIRTY = [
    (0, "Ruta\x02 Norte", f"Alta{BROKEN}", 12.5, 1),
    (1, "   Anillo  ", "Centro", 33.0, 2),
    (2, "вход Sur", "\tBaja ", 7.25, 3),
    (3, None, "igual", 0.5, 4),
]
SCHEMA = "pos long, corredor string, nombre_comuna string, velocidad double, hora int"


def test_table_cleaning_and_log(spark):
    df = spark.createDataFrame(DIRTY, SCHEMA)
    names = ["corredor", "nombre_comuna", "no_existe"]
    out = cleaning.clean_columns(df, names).orderBy("pos").collect()
    assert [r["corredor"] for r in out] == ["Ruta Norte", "Anillo", "Sur", None]
    assert [r["velocidad"] for r in out] == [12.5, 33.0, 7.25, 0.5]
    log = cleaning.change_log(df, names, "f.csv", "pos", offset=100).collect()
    assert {(r["fila"], r["columna"]) for r in log} == {
        (102, "corredor"), (102, "nombre_comuna"), (103, "corredor"), (104, "corredor"), (104, "nombre_comuna")}
    assert all(r["archivo"] == "f.csv" and r["valor_limpio"] != r["valor_original"] for r in log)
    totals = {r["archivo"]: r for r in cleaning.cleaning_totals(
        cleaning.change_log(df, names, "f.csv", "pos")).collect()}
    assert totals["f.csv"]["celdas_modificadas"] == totals[None]["celdas_modificadas"] == 5
    assert totals["f.csv"]["columnas_limpias"] == ["corredor", "nombre_comuna"]


def test_log_of_clean_table_is_empty(spark):
    df = spark.createDataFrame([(0, "x")], "pos long, a string")
    assert cleaning.change_log(df, ["a"], "f", "pos").count() == 0
    assert cleaning.change_log(df, ["zzz"], "f", "pos").count() == 0


def test_text_columns(spark):
    df = spark.createDataFrame([("a", "1", None, "x"), ("b", "2", None, "3")], "t string, n string, e string, m string")
    assert cleaning.text_columns(df) == ["t", "m"]
    assert cleaning.text_columns(df, skip=["t"]) == ["m"]


@pytest.mark.parametrize("value,label", [
    (None, "DESCONOCIDO"), ("", "DESCONOCIDO"), ("123", "DESCONOCIDO"), ("Cl 41 - Los Huesos", "CL 41  LOS HUESOS"),
    ("33 Autopista Sur", "AUTOPISTA SUR"), ("Vía Ñu-ñu é", "VIA NUNU E"), ("  12  calle ", "CALLE"),
])
def test_corridor_label(spark, value, label):
    df = spark.createDataFrame([(value,)], "v string")
    assert df.select(text.corridor_label(F.col("v"))).first()[0] == label


@pytest.mark.parametrize("value,key", [
    (None, ""), ("La  América", "la america"), ("Doce–de Octubre", "doce de octubre"), (" Straße ", "strasse"),
    ("Привет, Щёлково", "privet, shchelkovo"), ("Объезд", "obezd"), ("ΨΥΧΉ Θεά", "psukhe thea"), ("漢字 Ж", "漢字 zh"),
])
def test_area_key(spark, value, key):
    df = spark.createDataFrame([(value,)], "v string")
    assert df.select(text.area_key(F.col("v"))).first()[0] == key


def test_labels(spark):
    row = spark.range(1).select(
        text.commune_code(F.lit("7")), text.commune_code(F.lit("c-123")), text.commune_code(F.lit("x")),
        text.safe_name(F.lit("Av. Ñandú 5/x")), text.blank_to_null(F.lit(' "" ')),
        text.repair_words(F.lit(f"energ{BROKEN}a {BROKEN}x")),
        text.removed_characters(F.lit("a\x01b😀"), F.lit("ab")),
    ).first()
    assert tuple(row) == ("07", "123", None, "Av_Nandu_5_x", None, "energía x", ["U+0001", "U+1F600"])


def test_snake_case():
    assert text.snake_case(" AÑO-MES ") == "ano_mes"
    assert text.snake_case("INDRA.TIPO") == "indra_tipo"
    assert text.snake_case("Привет") == "privet" and text.snake_case("Αθήνα (км/ч)") == "athena_km_ch"
    assert text.snake_case("VÍA_PRINCIPAL") == "via_principal"
