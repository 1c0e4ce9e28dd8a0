"""Patterns of gaps and pairs of columns that are missing together, against counts row by row."""

from collections import Counter

from pyspark.sql import functions as F

from colscope.operators.missing import co_missing, co_missing_pairs, gap_patterns


def _plain(rows, names):
    sets = Counter("+".join(n for n, v in zip(names, r) if v is None or v != v) for r in rows)
    both = Counter()
    for r in rows:
        gone = [k for k, v in enumerate(r) if v is None or v != v]
        both.update((a, b) for a in gone for b in gone if a <= b)
    return sets, both


def _check(df):
    rows, names = [tuple(r) for r in df.collect()], df.columns
    sets, both = _plain(rows, names)
    assert {r["missing_together"]: r["rows"] for r in co_missing(df, "t").collect()} == dict(sets)
    got = co_missing_pairs(df, "t").collect()
    assert {(r["i"], r["j"]): (r["both"], r["missing_a"], r["missing_b"]) for r in got} == {
        (a, b): (n, both[a, a], both[b, b]) for (a, b), n in both.items() if a < b}
    assert all((r["col_a"], r["col_b"]) == (names[r["i"]], names[r["j"]]) for r in got)
    assert all(abs(r["together_pct"] - 100 * r["both"] / (r["missing_a"] + r["missing_b"] - r["both"])) < 0.006 for r in got)


def test_columns_on_both_sides_of_a_word(spark):
    """130 columns need three words; the last bit of a word is the sign of the number."""
    df = spark.range(400).repartition(5).select(*[
        F.when((F.col("id") * (k + 3)) % 7 > (k % 3), F.col("id")).alias(f"c{k}") if k % 5 and k not in (63, 64, 127, 128) or k in (63, 64, 127, 128)
        else F.lit(k).alias(f"c{k}") for k in range(130)])
    _check(df)


def test_types_nans_and_clashing_names(spark):
    df = spark.createDataFrame([(1, float("nan"), "", [1]), (None, None, None, None), (2, 1.0, None, None), (None, float("nan"), "x", []),
                                (None, None, None, None)], "`a.b` int, `A.B` double, `a b` string, l array<int>")
    _check(df.toDF("a.b", "A.B", "a b", "l"))


def test_empty_table_and_no_gaps(spark):
    empty = spark.createDataFrame([], "a int, b string")
    assert co_missing(empty).count() == 0 and co_missing_pairs(empty).count() == 0
    full = spark.range(3).withColumn("b", F.lit("x"))
    assert [tuple(r) for r in co_missing(full, "t").collect()] == [("t", "", 3)] and co_missing_pairs(full).count() == 0


def test_two_thousand_columns_make_one_small_key(spark):
    df = spark.range(50).selectExpr(*[f"if(id % {2 + k % 11} <> 0, 1, null) as c{k}" for k in range(2000)])
    patterns = gap_patterns(df).collect()
    assert sum(r["rows"] for r in patterns) == 50 and {len(r["words"]) for r in patterns} == {32}
    pairs = co_missing_pairs(df, columns=[f"c{k}" for k in range(200)])
    assert pairs.where("col_a = 'c0' and col_b = 'c1'").first()["both"] == sum(1 for i in range(50) if i % 6 == 0)
