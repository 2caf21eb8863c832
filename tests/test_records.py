"""CSV records against pandas, over blocks of a few bytes."""

import io
import random

import pandas as pd
import pytest

from viario import CsvCleaner
from viario.sources import files, records
from viario.sources.records import ends_inside, split_record


@pytest.fixture
def blocks(spark):
    """Sets the bytes of a block."""
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    yield lambda n: spark.conf.set("spark.sql.files.maxPartitionBytes", str(n))
    spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def wanted(text):
    """The rows that pandas reads."""
    table = pd.read_csv(io.StringIO(text, newline=""), dtype=str, keep_default_na=False, na_values=[""], header=0,
                        index_col=False, on_bad_lines="skip", engine="c")
    return [tuple(None if pd.isna(v) else v for v in r) for r in table.itertuples(index=False)]


def read(spark, path, **options):
    rows = files.read_csv(spark, str(path), encoding="utf-8", row_numbers=True, **options).orderBy(files.FILE, files.ROW_NUMBER)
    return [tuple(r)[:-2] for r in rows.collect()]


FIELDS = ["", "1", "a b", '5" pipe', 'Juan "el" Rojas', 'x"', '"q"', '"two\nlines"', '"a,b"', '"say ""hi"""', '""', '""""',
          '"open, ""x""\n\n""y"""', '"end"tail', '"end" "tail"', ' "late"', '"\r\n"', '"a\rb"', "é漢", '"', 'a""b', '"a""', "\x00"]


def test_fuzz_against_pandas(spark, tmp_path, blocks):
    rng = random.Random(11)
    for case in range(8):
        rows = []
        for _ in range(rng.randint(0, 60)):
            width = rng.choice([2, 3, 3, 3, 3, 3, 4, 1])
            odd = rng.random() < 0.9
            rows.append(",".join(rng.choice(FIELDS[:-4] if odd else FIELDS[:-5]) for _ in range(width)))
        ends = rng.choice(["\n", "\r\n", "\n"])
        text = ends.join(["a,b,c", "0,0,0", *rows, *rng.choice([[], [""], ["", "  ", "7,8,9"]])])
        path = tmp_path / f"{case}.csv"
        path.write_text(text, encoding="utf-8", newline="")
        blocks(rng.choice([25, 60, 200, 10_000]))
        assert read(spark, path) == wanted(text), repr(text)


def test_stray_quotes_lose_nothing(spark, tmp_path, blocks):
    text = 'id,name\n1,5" pipe\n2,x\n3,y\n4,6" pipe\n5,z\n'
    (tmp_path / "a.csv").write_text(text)
    for size in (11, 1000):
        blocks(size)
        assert read(spark, tmp_path / "a.csv") == wanted(text) == [
            ("1", '5" pipe'), ("2", "x"), ("3", "y"), ("4", '6" pipe'), ("5", "z")]


def test_long_records_over_many_blocks(spark, tmp_path, blocks):
    long = "line\n" * 10_005
    text = f'k,t\n1,"{long}"\n2,short\n3,"""{long}"""\n'
    (tmp_path / "a.csv").write_text(text)
    blocks(9000)
    rows = read(spark, tmp_path / "a.csv")
    assert rows == [("1", long), ("2", "short"), ("3", f'"{long}"')]
    assert spark.read.text(str(tmp_path / "a.csv")).rdd.getNumPartitions() > 10


def test_both_ways_of_many_files(spark, tmp_path, blocks, monkeypatch):
    """Blocks that are too many to be sent to all tasks meet their lines by a join."""
    folder = tmp_path / "many"
    folder.mkdir()
    every = []
    for i in range(5):
        text = 'k,t\n' + "".join(f'{i}-{j},"two\n{"x" * j}, ""lines"""\n' for j in range(30)) + ('9,"a",b,"c\nd"\n' if i % 2 else "")
        (folder / f"{i}.csv").write_text(text)
        every += wanted(text)
    blocks(300)
    sent = read(spark, folder)
    assert sent == every
    charset, width = "UTF-8", 2
    met = records.read_records(spark, str(folder), charset, ",", width, broadcast_blocks=0)
    assert sorted(tuple(r.fields) for r in met.where("__record > 0 AND reason IS NULL").collect()) == sorted(every)
    assert met.where("reason IS NOT NULL").count() == 2


def test_rejected_records(spark, tmp_path, blocks):
    text = 'a,b\n1,2\n3,4,5\n\n6,"x\ny",7\n8,9\n10,"never closed\n11,12\n13,14\n'
    (tmp_path / "a.csv").write_text(text)
    for size in (6, 1000):
        blocks(size)
        rows, bad, counts = files.read_csv_checked(spark, str(tmp_path / "a.csv"), encoding="utf-8", row_numbers=True)
        assert sorted((r.a, r.b) for r in rows.collect()) == [("1", "2"), ("8", "9")]
        got = {r.registro: (r.motivo, r.texto) for r in bad.collect()}
        assert got[1] == ("too many fields", "3,4,5") and got[2] == ("too many fields", '6,"x\ny",7')
        assert got[4][0] == "quote not closed" and got[4][1].startswith('10,"never closed') and set(got) == {1, 2, 4}
        assert counts == {"rows": 2, "rejected": 3}
    (tmp_path / "b.csv").write_text("a,b\n1,2\n3,4,\n5\n")       # without any quote
    rows, bad, counts = files.read_csv_checked(spark, str(tmp_path / "b.csv"), encoding="utf-8")
    assert [tuple(r) for r in rows.collect()] == [("1", "2"), ("5", None)] and counts == {"rows": 2, "rejected": 1}
    assert [(r.registro, r.texto) for r in bad.collect()] == [(1, "3,4,")]


def test_cleaner_reports_rejected_records(spark, tmp_path):
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw" / "a.csv").write_text('k,t\n1,"\x01uno"\n2,dos,x\n3,5" tubo\n')
    spec = {"a": {"filename": "a.csv", "encoding": "utf-8", "separator": ",", "text": ["t", "k"]}}
    cleaner = CsvCleaner(spark, tmp_path / "raw", tmp_path / "clean", tmp_path / "log", files=spec)
    assert cleaner.clean_file("a") == {
        "filas_procesadas": 2, "celdas_modificadas": 1, "columnas_limpias": ["t"], "registros_rechazados": 1}
    assert [tuple(r) for r in cleaner.rejected().collect()] == [("a.csv", 1, "too many fields", "2,dos,x")]
    assert sorted(files.read_csv(spark, str(tmp_path / "clean" / "a.csv")).collect()) == [("1", "uno"), ("3", '5" tubo')]


def by_characters(line, inside):
    """The rule itself, one character at a time."""
    state = "quoted" if inside else "start"
    for c in line:
        if state == "quoted":
            state = "quote" if c == '"' else "quoted"
        elif state == "quote" and c == '"':
            state = "quoted"
        elif state == "start" and c == '"':
            state = "quoted"
        else:
            state = "start" if c in ",\r" else "plain"
    return state == "quoted"


def test_ends_inside():
    rng = random.Random(3)
    for _ in range(4000):
        line = "".join(rng.choice('"",a\r"') for _ in range(rng.randint(0, 9)))
        for inside in (False, True):
            assert ends_inside(line, inside, ",") == by_characters(line, inside), (line, inside)
    assert split_record('1;"a\r\n;""b""";c\r\n', ";") == ["1", 'a\r\n;"b"', "c"]


def test_maps_are_composed(spark):
    """Chains of all four maps, followed block by block."""
    rng = random.Random(4)
    rows, want = [], {}
    for file in "abcd":
        inside, before = False, 0
        for start in range(40):
            out, inn, n, m = rng.random() < 0.5, rng.random() < 0.5, rng.randrange(5), rng.randrange(5)
            rows.append((file, start, out, n, inn, m))
            ends, starts = (inn, m) if inside else (out, n)
            want[file, start] = (inside, before, ends, before + starts)
            inside, before = ends, before + starts
    blocks = spark.createDataFrame(rows, "__file string, __start long, out_ends boolean, out_starts long, in_ends boolean, in_starts long")
    got = {(r[0], r[1]): tuple(r)[2:] for r in records.compose(blocks).collect()}
    assert got == want
