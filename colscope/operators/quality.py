"""Quality findings, type advice and column-name checks (QI, DT, CN): rules over the profile."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colscope.functions.session import local_table
from colscope import constants as K
from colscope.functions import numeric as N
from colscope.functions import text as X
from colscope.operators import quantiles as Q
from colscope.operators.longform import (
    columns_of, long_numeric, ordinal_of, pos, schema_table, unpivot,
)
from colscope.schemas import as_finding, seq, union_all

SENTINEL_DDL = ("dataset string, ordinal int, name string, nn bigint, sentinel_values array<double>,"
                " counts array<bigint>, shares array<double>")


def _share(count: Column) -> Column:
    return count / F.greatest(F.col("rows"), F.lit(1)) * 100


def _about(fmt: str, *cols) -> Column:
    return F.format_string(fmt, *cols)


# ---------------------------------------------------------------- QI


def high_missingness(counts: DataFrame) -> DataFrame:
    """QI1: at least half of the values are null."""
    p = _share(F.col("missing_count"))
    return as_finding(counts.where(p >= 50), seq=seq(1, F.col("ordinal")), type="high_missingness", severity="high",
                      column=F.col("name"), percentage=F.round(p, 1),
                      message=_about('Column "%s" is %.1f%% empty.', "name", p))


def moderate_missingness(counts: DataFrame) -> DataFrame:
    """QI2: a fifth to a half of the values are null."""
    p = _share(F.col("missing_count"))
    return as_finding(counts.where((p >= 20) & (p < 50)), seq=seq(1, F.col("ordinal")), type="moderate_missingness",
                      severity="medium", column=F.col("name"), percentage=F.round(p, 1),
                      message=_about('Column "%s" is %.1f%% empty.', "name", p))


def constant_columns(counts: DataFrame) -> DataFrame:
    """QI3: at most one distinct value; an all-null column counts."""
    return as_finding(counts.where(F.col("unique_count") <= 1), seq=seq(1, F.col("ordinal"), 1),
                      type="constant_column", severity="high", column=F.col("name"),
                      message=_about('Column "%s" has a single value.', "name"))


def sentinel_candidates(df: DataFrame, dataset: str = "", columns=None) -> DataFrame:
    """Placeholder numbers per column: common enough, and outside the 1%-99% range of the other values.

    Candidates are counted in one scan; the range is only computed for columns where a candidate
    reaches the minimum share, so clean tables cost one aggregation.
    """
    spark = df.sparkSession
    cols = {c.ordinal: c for c in columns_of(df, columns) if c.numeric}
    if not cols:
        return local_table(spark, [], SENTINEL_DDL)
    v = F.col("v")
    counted = (
        long_numeric(df, list(cols.values())).where(v.isNotNull())
        .groupBy("o", F.when(v.isin(*K.NUMERIC_SENTINELS), v).alias("cand"))
        .agg(F.count(F.lit(1)).alias("cnt"))
        .select(ordinal_of(F.col("o")).alias("ordinal"), "cand", "cnt")
    )
    tally: dict[int, dict] = {}
    for r in counted.collect():  # at most ten rows per column
        tally.setdefault(r["ordinal"], {})[r["cand"]] = r["cnt"]
    suspects = []
    for o, by_value in tally.items():
        nn, other = sum(by_value.values()), by_value.get(None, 0)
        common = {c: n for c, n in by_value.items() if c is not None and n / nn * 100 >= K.SENTINEL_MIN_PCT}
        if nn >= 10 and other >= 5 and common:
            suspects += [(o, cols[o].name, nn, c, n) for c, n in common.items()]
    if not suspects:
        return local_table(spark, [], SENTINEL_DDL)
    names = {cols[o].name for o, *_ in suspects}
    bounds = Q.order_statistics(mask_values(df, {n: K.NUMERIC_SENTINELS for n in names}), (0.01, 0.99),
                                median=False, columns=names, sizes={o: tally[o][None] for o, *_ in suspects})
    table = local_table(spark, suspects, "ordinal int, name string, nn bigint, cand double, cnt bigint")
    outside = table.join(F.broadcast(bounds.select("ordinal", "q01", "q99")), "ordinal").where(
        (F.col("cand") < F.col("q01")) | (F.col("cand") > F.col("q99"))
    )
    found = F.sort_array(F.collect_list(F.struct("cand", "cnt")))
    return outside.groupBy("ordinal", "name", "nn").agg(found.alias("found")).select(
        F.lit(dataset).alias("dataset"), "ordinal", "name", "nn",
        F.transform("found", lambda s: s["cand"]).alias("sentinel_values"),
        F.transform("found", lambda s: s["cnt"]).alias("counts"),
        F.transform("found", lambda s: F.round(s["cnt"] / F.col("nn") * 100, 1)).alias("shares"),
    )


def mask_values(df: DataFrame, values: dict[str, tuple]) -> DataFrame:
    """Null out the given numbers of the given columns; one projection, nothing shuffled."""
    def masked(name):
        c = F.col(f"`{name}`")
        return F.when(~c.cast("double").isin(*[float(x) for x in values[name]]), c)

    return df.select(*[masked(n).alias(n) if n in values else F.col(f"`{n}`") for n in df.columns])


def numeric_sentinels(candidates: DataFrame) -> DataFrame:
    """QI4: one finding per column with placeholder numbers."""
    shown = F.array_join(F.transform("sentinel_values", lambda x: F.format_string("%.0f", x)), ", ")
    return as_finding(candidates, seq=seq(2, F.col("ordinal")), type="numeric_sentinel_values", severity="high",
                      column=F.col("name"), sentinel_values=F.col("sentinel_values"),
                      message=_about('Column "%s" contains placeholder values: %s.', "name", shown))


def high_cardinality(schema: DataFrame, counts: DataFrame) -> DataFrame:
    """QI5: text with more than 100 values that nearly all differ."""
    text = counts.join(schema.where("family = 'text'").select("dataset", "ordinal"), ["dataset", "ordinal"])
    hit = text.where((F.col("unique_count") / F.greatest(F.col("rows"), F.lit(1)) > 0.9) & (F.col("unique_count") > 100))
    return as_finding(hit, seq=seq(3, F.col("ordinal"), 0), type="high_cardinality", severity="medium",
                      column=F.col("name"), unique_count=F.col("unique_count"),
                      message=_about('Column "%s" has %d different texts.', "name", "unique_count"))


def mixed_types(text: DataFrame) -> DataFrame:
    """QI6: between 10% and 90% of the texts read as numbers."""
    return as_finding(text.where("mixed_type"), seq=seq(3, F.col("ordinal"), 1), type="mixed_types", severity="high",
                      column=F.col("name"), message=_about('Column "%s" mixes numbers and words.', "name"))


def disguised_missing(text: DataFrame, counts: DataFrame) -> DataFrame:
    """QI7: placeholder text; medium below 5% of the rows, else high."""
    both = text.join(counts.select("dataset", "ordinal", "rows"), ["dataset", "ordinal"]).where("disguised_missing > 0")
    p = _share(F.col("disguised_missing"))
    return as_finding(both, seq=seq(3, F.col("ordinal"), 2), type="disguised_missing",
                      severity=F.when(p < 5, "medium").otherwise("high"), column=F.col("name"),
                      count=F.col("disguised_missing"), percentage=F.round(p, 1),
                      message=_about('Column "%s" has %d hidden nulls.', "name", "disguised_missing"))


def whitespace_issues(text: DataFrame) -> DataFrame:
    """QI8: padded text."""
    return as_finding(text.where("whitespace_issues > 0"), seq=seq(3, F.col("ordinal"), 3), type="whitespace_issues",
                      severity="low", column=F.col("name"), count=F.col("whitespace_issues"),
                      message=_about('Column "%s" has %d padded values.', "name", "whitespace_issues"))


def duplicate_row_finding(duplicates: DataFrame, info: DataFrame) -> DataFrame:
    """QI9: duplicate rows; medium below 5% of the rows, else high."""
    both = duplicates.join(info.select("dataset", "rows"), "dataset").where("duplicate_rows > 0")
    p = _share(F.col("duplicate_rows"))
    return as_finding(both, seq=seq(4), type="duplicate_rows", severity=F.when(p < 5, "medium").otherwise("high"),
                      count=F.col("duplicate_rows"), percentage=F.round(p, 1),
                      message=_about("%d rows have an identical copy (%.1f%%).", "duplicate_rows", p))


def infinite_values(m: DataFrame) -> DataFrame:
    """QI10: infinite numbers."""
    return as_finding(m.where("inf_count > 0"), seq=seq(5, F.col("ordinal")), type="infinite_values", severity="high",
                      column=F.col("name"), count=F.col("inf_count"),
                      message=_about('Column "%s" has %d infinite values.', "name", "inf_count"))


def quality_issues(schema, counts, text, m, candidates, duplicates, info) -> DataFrame:
    """QI11: all quality findings of a table in one relation."""
    return union_all([
        high_missingness(counts), moderate_missingness(counts), constant_columns(counts),
        numeric_sentinels(candidates), high_cardinality(schema, counts), mixed_types(text),
        disguised_missing(text, counts), whitespace_issues(text), duplicate_row_finding(duplicates, info),
        infinite_values(m),
    ])


# ---------------------------------------------------------------- DT


def suggest_category(schema: DataFrame, counts: DataFrame) -> DataFrame:
    """DT1: text with at most 50 values."""
    both = schema.where("family = 'text'").join(counts.select("dataset", "ordinal", "unique_count"), ["dataset", "ordinal"])
    return both.where("unique_count between 1 and 50").select(
        "dataset", "ordinal", "name", F.col("dtype").alias("current_dtype"), F.lit("category").alias("suggested_dtype"),
        _about("%d distinct values", "unique_count").alias("reason"))


def suggest_integer(df: DataFrame, dataset: str = "", columns=None) -> DataFrame:
    """DT2: a float column that only holds whole numbers."""
    cols = [c for c in columns_of(df, columns) if c.family == "float"]
    out = "dataset string, ordinal int, name string, current_dtype string, suggested_dtype string, reason string"
    if not cols:
        return local_table(df.sparkSession, [], out)
    v = F.col("v")
    whole = long_numeric(df, cols).groupBy("o").agg(
        F.bool_and(F.when(N.is_inf(v), False).otherwise(v % 1 == 0)).alias("whole")
    ).where("whole").select(ordinal_of(F.col("o")).alias("ordinal"))
    return schema_table(df, dataset).join(F.broadcast(whole), "ordinal").select(
        "dataset", "ordinal", "name", F.col("dtype").alias("current_dtype"),
        F.lit("nullable integer").alias("suggested_dtype"), F.lit("only whole numbers").alias("reason"))


def suggest_narrow_int(df: DataFrame, dataset: str = "", columns=None) -> DataFrame:
    """DT3: an integer column whose range fits int8 or int16; only narrower types are suggested."""
    cols = [c for c in columns_of(df, columns) if c.family == "integer"]
    out = "dataset string, ordinal int, name string, current_dtype string, suggested_dtype string, reason string"
    if not cols:
        return local_table(df.sparkSession, [], out)
    spans = unpivot(df, [(c.ordinal, pos(c).cast("bigint")) for c in cols]).groupBy("o").agg(
        F.min("v").alias("lo"), F.max("v").alias("hi")
    ).select(ordinal_of(F.col("o")).alias("ordinal"), "lo", "hi")
    best = F.when((F.col("lo") >= -128) & (F.col("hi") <= 127) & (F.col("dtype") != "tinyint"), "int8").when(
        (F.col("lo") >= -32768) & (F.col("hi") <= 32767) & ~F.col("dtype").isin("tinyint", "smallint"), "int16")
    return schema_table(df, dataset).join(F.broadcast(spans), "ordinal").withColumn("suggested_dtype", best).where(
        "suggested_dtype is not null").select(
        "dataset", "ordinal", "name", F.col("dtype").alias("current_dtype"), "suggested_dtype",
        _about("range %d to %d", "lo", "hi").alias("reason"))


# ---------------------------------------------------------------- CN


def name_case_collisions(schema: DataFrame) -> DataFrame:
    """CN1: two names of a table that are equal once stripped and lower-cased."""
    folded = schema.withColumn("folded", F.lower(X.strip(F.col("name"))))
    w = Window.partitionBy("dataset", "folded").orderBy("ordinal")
    return folded.withColumn("earlier", F.lag("name").over(w)).where("earlier is not null").select(
        "dataset", "ordinal", F.lit("duplicate_after_lowering").alias("type"), F.col("earlier").alias("first_name"),
        F.col("name").alias("second_name"))


def name_special_chars(schema: DataFrame) -> DataFrame:
    """CN2: names with a non-word character, with a cleaned suggestion."""
    word = r"[^\p{L}\p{M}\p{N}_]"
    cleaned = F.lower(F.btrim(F.regexp_replace("name", word + "+", "_"), F.lit("_")))
    return schema.where(F.col("name").rlike(word)).select(
        "dataset", "ordinal", F.lit("special_characters").alias("type"), "name", cleaned.alias("suggestion"))


def name_whitespace(schema: DataFrame) -> DataFrame:
    """CN3: names with leading or trailing whitespace."""
    return schema.where(X.strip(F.col("name")) != F.col("name")).select(
        "dataset", "ordinal", F.lit("whitespace_in_name").alias("type"), "name")
