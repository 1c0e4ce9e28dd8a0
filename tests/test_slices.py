"""Many datasets in one plan give what an analysis of each gives."""

import pytest

from colscope.plans.analysis import Analysis
from colscope.plans.slices import Slices
from colscope.sources.tables import read_table
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def table(spark):
    """Two datasets: an imbalanced, collinear, padded one with copies and gaps, and a plain one; a null names a third."""
    a = spark.range(600).selectExpr(
        "'a' as part", "id % 300 as n", "(id % 300) * 2.0 + 1 as twice", "if(id % 20 = 0, 'yes', 'no') as label_text",
        "if(id % 4 = 0, null, concat(' x', id % 7)) as padded", "if(id % 10 = 0, 1e6, cast(id % 13 as double)) as spiky")
    b = spark.range(200).selectExpr(
        "if(id < 150, 'b', null) as part", "id as n", "cast((id * 37) % 101 as double) as twice", "if(id % 2 = 0, 'yes', 'no') as label_text",
        "concat('y', id % 5) as padded", "cast((id * 13) % 17 as double) as spiky")
    return a.unionByName(b)


def test_each_dataset_equals_its_own_analysis(spark, table):
    both = Slices({"t": table}, {"t": ("part",)})
    got = {r["dataset"]: r for r in both.traits.join(both.recommendation.drop("task_type"), "dataset").join(both.tasks, "dataset").collect()}
    found = {}
    for r in both.all_findings.collect():
        found.setdefault(r["dataset"], set()).add((r["type"], r["severity"], r["column"], r["var1"], r["var2"], r["correlation"], r["percentage"], r["count"], r["message"]))
    assert set(got) == {"t/a", "t/b", "t/None"}
    for value in ("a", "b"):
        own = Analysis(table.where(F.col("part") == value).drop("part"), "own")
        name = f"t/{value}"
        for r in (own.traits.first(), own.tasks.first(), own.recommendation.first()):
            for k, v in r.asDict(recursive=True).items():
                if k != "dataset":
                    assert got[name].asDict(recursive=True)[k] == v, (name, k)
        left_out = {"numeric_sentinel_values", "simpsons_paradox", "heteroscedasticity"}
        assert {r[0] for r in found.get(name, ())} - left_out == {r["type"] for r in own.all_findings.collect()} - left_out
        quality = {"high_missingness", "moderate_missingness", "constant_column", "whitespace_issues", "duplicate_rows", "multicollinearity", "class_imbalance"}
        assert {r for r in found.get(name, ()) if r[0] in quality} == {
            (r["type"], r["severity"], r["column"], r["var1"], r["var2"], r["correlation"], r["percentage"], r["count"], r["message"])
            for r in own.all_findings.collect() if r["type"] in quality}
    assert {"t/a"} <= {d for d, s in found.items() if any(f[0] == "class_imbalance" for f in s)}
    assert both.summary.count() == 3 and both.health.count() == 3


def test_whole_tables_and_an_empty_one(spark, folder):
    tables = {t: read_table(spark, folder, t) for t in ("nation", "supplier")}
    some = Slices(tables | {"none": spark.createDataFrame([], "a int, b string")})
    assert {r["dataset"]: (r["rows"], r["columns"]) for r in some.info.collect()} == {t: (df.count(), len(df.columns)) for t, df in tables.items()}


def test_datasets_in_bands(spark, table, monkeypatch):
    """Where the sums of all datasets are too large for a task, bands of them give the same pairs."""
    from colscope.plans import slices

    whole = sorted(map(str, Slices({"t": table}, {"t": ("part",)}).pairs.collect()))
    monkeypatch.setattr(slices, "PASS_BYTES", 600)
    assert whole and sorted(map(str, Slices({"t": table}, {"t": ("part",)}).pairs.collect())) == whole


def test_no_column_is_counted_twice(spark, table, monkeypatch, tmp_path):
    """Classes are counted of the columns that may be targets alone; outliers are the same whether bounds are sent to all tasks or joined."""
    from colscope.plans import slices

    table.write.parquet(f"{tmp_path}/t")
    read = spark.read.parquet(f"{tmp_path}/t")
    plans, keep = [], slices.settle
    both = Slices({"t": read, "u": read.select("n", "twice")}, {"t": ("part",)})
    assert both.features.count() and both.target_scores.count()
    monkeypatch.setattr(slices, "settle", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or keep(df))
    assert {"label_text", "padded"} <= {r["name"] for r in both.class_counts.collect()}
    assert "ReadSchema" in plans[0] and "label_text" in plans[0] and "twice" not in plans[0]
    outliers = sorted(map(str, both.outliers.collect()))
    monkeypatch.setattr(slices, "SENT_ROWS", 0)
    assert outliers and sorted(map(str, Slices({"t": read, "u": read.select("n", "twice")}, {"t": ("part",)}).outliers.collect())) == outliers
    text = Slices({"words": read.select("label_text")})
    assert text.outliers.count() == 0 and text.traits.count() == 1
