"""Edge cases of the profile: empty, null-only, constant, infinite, nested, oddly named columns."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from colscope.operators import profile as P
from colscope.operators import quantiles as Q
from colscope.operators import quality as QI
from colscope.operators.longform import schema_table
from colscope.plans.analysis import Analysis


def by_name(df):
    return {r["name"]: r for r in df.collect()}


def test_empty_table(spark):
    df = spark.createDataFrame([], "a int, b string, c double")
    rows = by_name(P.column_counts(df))
    assert {r["rows"] for r in rows.values()} == {0}
    assert rows["a"]["missing_pct"] == 0.0
    assert P.basic_info(P.column_counts(df)).first()["missing_percentage"] == 0.0
    assert P.duplicate_rows(df).first()["duplicate_rows"] == 0
    assert by_name(P.moments(df))["c"]["nn"] == 0
    assert Analysis(df, "empty").profile.count() == 3


def test_null_constant_and_infinite_columns(spark):
    rows = [(None, 1.0, float("inf"), float("nan")), (None, 1.0, 2.0, 3.0), (None, 1.0, -1.0, None)]
    df = spark.createDataFrame(rows, "gone double, same double, inf double, nan double")
    counts, m = by_name(P.column_counts(df)), by_name(P.moments(df))
    assert counts["gone"]["unique_count"] == 0 and counts["gone"]["missing_pct"] == 100.0
    assert counts["nan"]["missing_count"] == 2
    assert m["same"]["skewness"] is None and m["same"]["std"] == 0.0
    assert m["inf"]["inf_count"] == 1 and m["inf"]["mean"] is None
    num = by_name(P.numeric_profile(P.moments(df)))
    assert num["inf"]["max"] is None and num["inf"]["min"] == -1.0
    assert num["gone"]["zeros_pct"] is None
    # the NaN became null, which leaves one value in that column
    assert {r["column"] for r in QI.constant_columns(P.column_counts(df)).collect()} == {"gone", "same", "nan"}


def test_nested_columns_are_unknown(spark):
    df = spark.sql("select array(1,2) as a, named_struct('x', 1) as s, map('k', 1) as m, 5 as n union all "
                   "select array(1,2), named_struct('x', 1), map('k', 1), 5")
    a = Analysis(df, "nested")
    kinds = by_name(a.kinds)
    assert [kinds[c]["kind"] for c in "asm"] == ["unknown"] * 3
    assert a.duplicates.first()["duplicate_rows"] == 2
    assert by_name(a.counts)["a"]["unique_count"] == 1


def test_odd_names(spark):
    df = spark.createDataFrame([(1, "x", 2.0), (2, None, 3.0)], "`a.b` int, ` pad` string, `Q``x` double")
    assert set(by_name(P.column_counts(df))) == {"a.b", " pad", "Q`x"}
    assert by_name(P.moments(df))["Q`x"]["mean"] == 2.5
    names = schema_table(df, "t")
    assert {r["name"] for r in QI.name_special_chars(names).collect()} == {"a.b", " pad", "Q`x"}
    assert [r["name"] for r in QI.name_whitespace(names).collect()] == [" pad"]


def test_null_equals_null_in_duplicates_but_position_matters(spark):
    df = spark.createDataFrame([(None, 1), (None, 1), (1, None), (2, 3)], "a int, b int")
    assert P.duplicate_rows(df).first()["duplicate_rows"] == 2


@pytest.mark.parametrize("span", [5, 40, 200_000])
def test_ranks_are_exact_at_any_span(spark, monkeypatch, span):
    monkeypatch.setattr(Q, "SPAN_ROWS", span)
    rng = random.Random(span)
    heavy = [7.0] * 400 + [9.0] * 300
    values = heavy + [rng.gauss(0, 1000) for _ in range(500)] + [math.inf, -math.inf]
    df = spark.createDataFrame([(v, float(i % 3)) for i, v in enumerate(values)], "v double, few double")
    qs = (0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0)
    got = {(r["name"], r["q"]): r["value"] for r in Q.nearest_quantiles(df, qs).collect()}
    ordered, few = sorted(values), sorted(i % 3 for i in range(len(values)))
    for q in qs:
        rank = math.floor(q * (len(values) - 1) + 0.5)
        assert got[("v", q)] == ordered[rank]
        assert got[("few", q)] == few[rank]
    stats = {r["name"]: r for r in Q.order_statistics(df, (0.25,)).collect()}
    assert stats["v"]["median"] == pytest.approx(float(np.median(values)))


def test_number_and_date_grammar(spark):
    from colscope.functions import text as X

    cases = {"1": True, " 2.5 ": True, "1,000": True, "-1e5": True, "inf": True, "NaN": True, "1_0": True, ".5": True, "5.": True,
             "1d": False, "": False, "1__0": False, "abc": False, "1e": False, "0x1": False, "+": False}
    df = spark.createDataFrame(list(cases.items()), "t string, want boolean")
    assert df.where(X.looks_numeric(F.col("t")) != F.col("want")).collect() == []
    days = {"2024-02-29": True, "2023-02-29": False, "2024/01/05 10:20": True, "2024": False, "2024-13-01": False,
            "2024-01-01T25:00:00": False}
    df = spark.createDataFrame(list(days.items()), "t string, want boolean")
    assert df.where(X.is_ymd(F.col("t")) != F.col("want")).collect() == []


def test_long_text_keeps_its_text(spark):
    long = "x" * 500
    df = spark.createDataFrame([(long,), (long,), ("short",)], "t string")
    top = P.top_values(df).orderBy("rank").collect()
    assert [(r["value"], r["count"]) for r in top] == [(long, 2), ("short", 1)]
    assert {r["value"] for r in P.sample_values(df).collect()} == {long, "short"}


def test_samples_are_stable_and_from_the_data(spark, folder):
    df = spark.read.parquet(f"{folder}/customer.parquet")
    first, again = (sorted(map(tuple, P.sample_values(df, "c").collect())) for _ in range(2))
    assert first == again
    names = {r["c_name"] for r in df.select("c_name").collect()}
    assert {r[4] for r in first if r[2] == "c_name"} <= names


def test_approximate_counts_are_close(spark, folder):
    df = spark.read.parquet(f"{folder}/lineitem.parquet")
    exact, approx = by_name(P.column_counts(df)), by_name(P.column_counts(df, approximate=True))
    for n, r in exact.items():
        assert approx[n]["unique_count"] == pytest.approx(r["unique_count"], rel=0.1)
        assert approx[n]["missing_count"] == r["missing_count"]


def test_counts_and_histogram_read_the_table_once(spark, tmp_path):
    spark.range(50).selectExpr("id", "cast(id % 3 as double) as x", "repeat(concat('t', id % 2), 80) as t", "id % 2 = 0 as b").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    for got in (P.column_counts(df), P.value_histogram(df), P.sample_values(df, columns=["id", "x", "b"])):
        assert got._jdf.queryExecution().executedPlan().toString().count("FileScan") <= 1
    assert {(r["name"], r["unique_count"]) for r in P.column_counts(df).collect()} == {("id", 50), ("x", 3), ("t", 2), ("b", 2)}
    assert {r["value_str"] for r in P.value_histogram(df).where("name = 't'").collect()} == {"t0" * 80, "t1" * 80}


def test_ties_of_long_texts_go_by_value(spark):
    begin = "same begin " * 10
    rows = [(begin + c,) for c in "zyxwvutsrq" for _ in range(2)] + [("short",)] * 2 + [(begin + "a",)]
    got = P.top_values(spark.createDataFrame(rows, "t string").repartition(4), k=4).orderBy("rank").collect()
    assert [(r["value"], r["count"]) for r in got] == [(begin + c, 2) for c in "qrst"]
