"""Files as users upload them, and the readers and writers around them."""

import pytest

from colscope.operators import textjobs as TX
from colscope.sources import csvfiles, uploads as UP

FILES = {
    "good.csv": "a,b\n1,x\n2,y\n".encode(),
    "semi.csv": "a;b;c\n1;2;3\n".encode(),
    "latin.csv": "name,city\nRené,Orléans\n".encode("latin-1"),
    "bom.csv": b"\xef\xbb\xbf" + "a,b\n1,2\n".encode(),
    "utf16.csv": "a,b\n1,2\n".encode("utf-16"),
    "picture.csv": b"\x89PNG\r\n" + bytes(range(256)),
    "nuls.csv": b"a,b\n" + b"1\x002" * 50,
    "header_only.csv": b"a,b\n",
    "blank.csv": b" , \n1,2\n",
    "wide.csv": (",".join(f"c{i}" for i in range(2001)) + "\n" + ",".join("1" * 2001) + "\n").encode(),
    "notes.txt": b"a,b\n1,2\n",
}


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("uploads")
    for name, content in FILES.items():
        (folder / name).write_bytes(content)
    return folder, UP.read_uploads(spark, str(folder))


def by_file(df):
    return {r["path"].rsplit("/", 1)[1]: r for r in df.collect()}


def test_verdicts(files):
    got = by_file(UP.validate_uploads(files[1]))
    assert {n: r["error"] for n, r in got.items() if r["error"]} == {
        "picture.csv": "binary", "nuls.csv": "binary", "header_only.csv": "no_data_rows", "blank.csv": "no_header",
        "wide.csv": "too_many_columns", "notes.txt": "not_csv", "utf16.csv": "binary"}
    assert got["semi.csv"]["delimiter"] == ";"


def test_encodings(files):
    got = {n: r["encoding"] for n, r in by_file(UP.encoding_detect(files[1])).items()}
    assert (got["good.csv"], got["latin.csv"], got["bom.csv"], got["utf16.csv"]) == ("utf-8", "latin-1", "utf-8-sig", "utf-16")


def test_size_limit(files):
    got = by_file(UP.file_triage(files[1], max_mb=0))
    assert got["good.csv"]["error"] == "too_large"


def test_csv_kinds_of_one_folder(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("n,t\n1,café\n".encode())
    (tmp_path / "b.csv").write_bytes("n,t\n2,Orléans\n".encode("latin-1"))
    (tmp_path / "c.csv").write_bytes("n,t\n3,x\n4.5,ÿþ\n".encode("utf-16"))
    (tmp_path / "d.csv").write_bytes('n,t\n5,"first\nsecond, ""third"""\n6,ÿþ\n'.encode())
    df = csvfiles.csv_load(spark, str(tmp_path))
    assert dict(df.dtypes) == {"n": "double", "t": "string"}
    assert sorted(tuple(r) for r in df.collect()) == [
        (1.0, "café"), (2.0, "Orléans"), (3.0, "x"), (4.5, "ÿþ"), (5.0, 'first\nsecond, "third"'), (6.0, "ÿþ")]


def test_csv_load(spark, files):
    folder = files[0]
    good = csvfiles.csv_load(spark, str(folder / "good.csv"))
    assert good.dtypes == [("a", "int"), ("b", "string")] and good.count() == 2
    latin = csvfiles.csv_load(spark, str(folder / "latin.csv"))
    assert latin.first()["city"] == "Orléans"
    assert csvfiles.csv_load(spark, str(folder / "bom.csv")).columns == ["a", "b"]


def test_quoted_line_breaks(spark, tmp_path):
    (tmp_path / "q.csv").write_text('a,b\n1,"two\nlines ""quoted"""\n')
    row = csvfiles.csv_load(spark, str(tmp_path / "q.csv"), multi_line=True).first()
    assert row["b"] == 'two\nlines "quoted"'


def test_size_and_guard(spark, folder):
    df = spark.read.parquet(f"{folder}/orders.parquet")
    assert csvfiles.size_mb(df).first()["size_mb"] == pytest.approx(0.035, abs=0.002)
    assert csvfiles.empty_guard(df.where("false")).first()["is_empty"]


def test_formula_cells(spark):
    df = spark.createDataFrame([(" =1+1", "ok"), ("@x", "-5"), (None, "|")], "a string, b string")
    got = {r["name"]: r["formula_cells"] for r in UP.formula_injection(df).collect()}
    assert got == {"a": 2, "b": 2}


def test_numbered_list_rules(spark):
    text = "Intro\n1. one\n  more\n\n#2) two\n3 - \n2: again\n7. seven\n1) \nlate"
    df = spark.createDataFrame([(1, text), (2, ""), (3, None)], "id int, t string")
    got = [(r["id"], r["item"], r["item_text"]) for r in TX.numbered_list(df, "t", 5).orderBy("item").collect()]
    assert got == [(1, 1, "late"), (1, 2, "again")]


def test_extract_json(spark):
    cases = ['```json\n{"a": 1}\n```', 'see [1, 2] there', "none", '{"a": }', "[1] and [2]", "", None]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "id int, t string")
    got = [r["json_text"] for r in TX.extract_json(df, "t").orderBy("id").collect()]
    assert got == ['{"a": 1}', "[1, 2]", None, None, None, None, None]


def quoted_rows(n):
    cells = ["plain", 'with "quotes"', "two\nlines", 'three\n"lines"\n\nhere', "", None, "a,b", "\n", "ünï"]
    return [(i, cells[i % len(cells)], i / 4) for i in range(n)]


def test_quoted_breaks_are_cut_inside_one_file(spark, tmp_path):
    """One file, many splits: records cross borders, one cell spans several splits, and all equals the source."""
    import csv

    rows = quoted_rows(900)
    rows[400] = (400, "long\n" * 3000, 100.0)
    path = tmp_path / "q.csv"
    with open(path, "w", newline="") as f:
        w = csv.writer(f, quoting=csv.QUOTE_MINIMAL)
        w.writerow(["n", "t", "x"])
        w.writerows([(a, "" if b is None else b, c) for a, b, c in rows])
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        df = csvfiles.csv_load(spark, str(path))
        assert dict(df.dtypes) == {"n": "int", "t": "string", "x": "double"}
        from colscope.sources.records import records_of

        pieces = records_of(spark, str(path))
        assert pieces.rdd.getNumPartitions() > 5
        assert pieces.count() == len(rows) + 1
        got = sorted((r["n"], r["t"], r["x"]) for r in df.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == [(a, b or None, c) for a, b, c in rows]


def test_quoted_breaks_match_the_whole_file_reader(spark, tmp_path):
    import csv

    for name, end in (("u.csv", "\n"), ("w.csv", "\r\n")):
        with open(tmp_path / name, "w", newline="") as f:
            w = csv.writer(f, lineterminator=end)
            w.writerow(["n", "t", "x"])
            w.writerows([(a, "" if b is None else b.replace("\n", end), c) for a, b, c in quoted_rows(60)])
    files = [str(tmp_path / n) for n in ("u.csv", "w.csv")]
    want = spark.read.option("header", True).option("escape", '"').option("multiLine", True).option("inferSchema", True).csv(files)
    got = csvfiles.csv_load(spark, files)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
