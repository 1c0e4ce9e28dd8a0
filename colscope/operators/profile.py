"""Column and table profile (PR1-PR24).

Operators on data return one row per column and scan the table once; operators on profiles take
those small tables. `rows` is floored at 1 where it divides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colscope import constants as K
from colscope.functions import numeric as N
from colscope.functions import text as X
from colscope.operators import quantiles as Q
from colscope.functions.session import local_table, settle
from colscope.operators.longform import (
    DIGEST_LENGTH, DIGEST_OVER, by_position, columns_of, compare_key, histogram, is_null_bucket, long_numeric, long_text, ordinal_of, pos,
    schema_table, unpivot,
)

FIXED_WIDTH = {
    "boolean": 1, "tinyint": 1, "smallint": 2, "int": 4, "bigint": 8, "float": 4, "double": 8,
    "date": 4, "timestamp": 8, "timestamp_ntz": 8,
}


def _named(df: DataFrame, stats: DataFrame, dataset: str, columns=None, families=None) -> DataFrame:
    """Attach dataset and column names to per-ordinal statistics; every column keeps a row."""
    names = schema_table(df, dataset, columns)
    if families:
        names = names.where(F.col("family").isin(*families))
    return names.select("dataset", "ordinal", "name").join(F.broadcast(stats), "ordinal", "left")


# ---------------------------------------------------------------- counts and histograms


def value_histogram(df: DataFrame, dataset: str = "", columns=None) -> DataFrame:
    """PR2: value counts of every column with the null bucket; texts are whole, whatever their length."""
    names = F.broadcast(schema_table(df, dataset, columns).select("dataset", "ordinal", "name"))
    return histogram(df, columns, whole=True).join(names, "ordinal").select(
        "dataset", "ordinal", "name", "value_int", "value_dbl", "value_str", "cnt"
    )


def column_counts(df: DataFrame, dataset: str = "", columns=None, approximate: bool = False) -> DataFrame:
    """PR1: rows, nulls and distinct non-null values per column, with their percentages.

    Exact by default: distinct values are counted from the histogram, so one (column, value)
    shuffle serves all columns. `approximate` replaces it by a HyperLogLog sketch per column,
    one scan and no shuffle of values.
    """
    if approximate:
        cols = columns_of(df, columns)
        exprs = [(c.ordinal, F.xxhash64(pos(c))) for c in cols]
        flags = [(c.ordinal, F.when(_present(c), e[1])) for c, e in zip(cols, exprs)]
        stats = unpivot(df, flags).groupBy("o").agg(
            F.count(F.lit(1)).alias("rows"),
            F.count_if(F.col("v").isNull()).alias("missing_count"),
            F.approx_count_distinct("v", 0.02).alias("unique_count"),
        ).select(ordinal_of(F.col("o")).alias("ordinal"), "rows", "missing_count", "unique_count")
    else:
        stats = histogram(df, columns).groupBy("ordinal").agg(*count_sums())
    return with_shares(_named(df, stats, dataset, columns))


def count_sums() -> list[Column]:
    """Rows, nulls and distinct values from value counts."""
    return [F.sum("cnt").alias("rows"), F.sum(F.when(is_null_bucket(), F.col("cnt")).otherwise(0)).alias("missing_count"),
            F.count_if(~is_null_bucket()).alias("unique_count")]


def with_shares(named: DataFrame) -> DataFrame:
    n = F.greatest(F.col("rows"), F.lit(1))
    return named.select(
        "dataset", "ordinal", "name",
        *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("rows", "missing_count", "unique_count")],
        F.coalesce(N.pct(F.col("missing_count"), n), F.lit(0.0)).alias("missing_pct"),
        F.coalesce(N.pct(F.col("unique_count"), n), F.lit(0.0)).alias("unique_pct"),
    )


def _present(c) -> Column:
    return N.as_double(pos(c), c.dtype).isNotNull() if c.family == "float" else pos(c).isNotNull()


def basic_info(counts: DataFrame) -> DataFrame:
    """PR3: rows, columns, missing cells and their share, from the column counts."""
    cells = F.sum("missing_count")
    total = F.max("rows") * F.count(F.lit(1))
    return counts.groupBy("dataset").agg(
        F.max("rows").alias("rows"),
        F.count(F.lit(1)).alias("columns"),
        cells.alias("missing_cells"),
        F.coalesce(F.round(N.ratio(cells, total) * 100, 2), F.lit(0.0)).alias("missing_percentage"),
    )


def duplicate_rows(df: DataFrame, dataset: str = "") -> DataFrame:
    """PR4: rows that have at least one identical copy, all copies counted; null equals null.

    Rows are counted by two 64-bit hashes, and each group carries the least and greatest of a third one: copies collapse
    before the only shuffle, which never carries a row's columns. Groups whose rows agree in all three hashes are copies;
    should a group differ in the third, its rows (and no others) are grouped by it in a second read.
    """
    cols = columns_of(df)
    exact = by_position(df).select(*[
        (N.as_double(pos(c), c.dtype) if c.family == "float"
         else F.to_json(F.struct(pos(c))) if "map<" in c.dtype.simpleString() else pos(c)).alias(f"c{c.ordinal}")
        for c in cols
    ])
    keys = exact.columns
    present = [F.when(F.col(k).isNull(), i).otherwise(-1) for i, k in enumerate(keys)]
    hashed = exact.select(*[F.xxhash64(F.lit(seed), *present, *keys).alias(h) for h, seed in (("h1", 3), ("h2", 7919), ("h3", 104729))])
    groups = hashed.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.min("h3").alias("low"), F.max("h3").alias("high")).where("n > 1")
    same = F.col("low") == F.col("high")
    total, mixed = groups.agg(F.coalesce(F.sum(F.when(same, F.col("n"))), F.lit(0)), F.count_if(~same)).first()
    if mixed:
        apart = hashed.join(groups.where(~same).select("h1", "h2"), ["h1", "h2"], "left_semi")
        total += apart.groupBy("h1", "h2", "h3").agg(F.count(F.lit(1)).alias("n")).where("n > 1").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return local_table(df.sparkSession, [(dataset, total)], "dataset string, duplicate_rows bigint")


def memory_mb(df: DataFrame, dataset: str = "") -> DataFrame:
    """PR5: logical size in MB - fixed widths times rows, plus the bytes of text.

    Offsets and validity bitmaps of an in-memory layout are left out.
    """
    cols = columns_of(df)
    fixed = sum(FIXED_WIDTH.get(c.dtype.simpleString(), 8 if c.family == "decimal" else 0) for c in cols)
    texts = [F.coalesce(F.octet_length(pos(c)), F.lit(0)).cast("bigint") for c in cols if c.family == "text"]
    varying = F.sum(sum(texts[1:], texts[0])) if texts else F.lit(0)
    return by_position(df).agg(
        F.round((F.count(F.lit(1)) * fixed + F.coalesce(varying, F.lit(0))) / F.lit(1048576.0), 3).alias("memory_mb")
    ).select(F.lit(dataset).alias("dataset"), "memory_mb")


# ---------------------------------------------------------------- numbers


def moments(df: DataFrame, dataset: str = "", columns=None, exclude=()) -> DataFrame:
    """Unrounded numeric statistics per column; infinities are counted and kept out of the moments."""
    cols = [c for c in columns_of(df, columns) if c.numeric and c.name not in exclude]
    if not cols:
        return local_table(df.sparkSession, [], "dataset string, ordinal int, name string, rows bigint, nn bigint, inf_count bigint, mean double,"
                " std double, min double, max double, zeros bigint, negatives bigint, skewness double, kurtosis double")
    stats = long_numeric(df, cols).groupBy("o").agg(*moment_sums()).withColumn("ordinal", ordinal_of(F.col("o"))).drop("o")
    return finite_moments(_named(df, stats, dataset, [c.name for c in cols]))


def moment_sums() -> list[Column]:
    """Aggregates of a numeric value v; finite values alone make the moments."""
    v, fin = F.col("v"), N.finite(F.col("v"))
    return [F.count(F.lit(1)).alias("rows"), F.count(v).alias("nn"), F.count_if(N.is_inf(v)).alias("inf_count"), F.avg(fin).alias("mean"),
            F.stddev_samp(fin).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"), F.count_if(v == 0).alias("zeros"),
            F.count_if(v < 0).alias("negatives"), F.skewness(fin).alias("skewness"), F.kurtosis(fin).alias("kurtosis")]


def finite_moments(named: DataFrame) -> DataFrame:
    """Moments are null where there are infinities, counts never are."""
    clean = F.col("inf_count") == 0
    return named.withColumns({m: F.when(clean, F.col(m)) for m in ("mean", "std", "skewness", "kurtosis")}).withColumns({
        c: F.coalesce(F.col(c), F.lit(0)) for c in ("rows", "nn", "inf_count", "zeros", "negatives")})


def numeric_profile(m: DataFrame) -> DataFrame:
    """PR6: rounded mean, std, min, max and the shares of zeros and negatives among non-nulls."""
    return m.select(
        "dataset", "ordinal", "name",
        *[N.finite_or_null(F.col(c)).alias(c) for c in ("mean", "std", "min", "max")],
        N.pct(F.col("zeros"), F.col("nn")).alias("zeros_pct"),
        N.pct(F.col("negatives"), F.col("nn")).alias("negative_pct"),
    )


def shape_profile(m: DataFrame) -> DataFrame:
    """PR7: population skewness and excess kurtosis."""
    return m.select("dataset", "ordinal", "name",
                    *[N.finite_or_null(F.col(c)).alias(c) for c in ("skewness", "kurtosis")])


def inf_counts(m: DataFrame) -> DataFrame:
    """PR10: infinite values per numeric column."""
    return m.select("dataset", "ordinal", "name", "inf_count")


def medians(df: DataFrame, dataset: str = "", columns=None) -> DataFrame:
    """PR8: interpolated median per numeric column, by exact rank selection."""
    return Q.order_statistics(df, columns=columns, dataset=dataset).select(
        "dataset", "ordinal", "name", N.finite_or_null(F.col("median")).alias("median")
    )


def quartiles(order_stats: DataFrame, m: DataFrame) -> DataFrame:
    """PR11: quartiles and whiskers 1.5 IQR away, kept inside the observed range."""
    iqr = F.col("q75") - F.col("q25")
    return order_stats.join(m.select("dataset", "ordinal", "min", "max"), ["dataset", "ordinal"]).select(
        "dataset", "ordinal", "name", "median",
        F.col("q25"), F.col("q75"),
        F.greatest(F.col("min"), F.col("q25") - iqr * 1.5).alias("whisker_low"),
        F.least(F.col("max"), F.col("q75") + iqr * 1.5).alias("whisker_high"),
    )


# ---------------------------------------------------------------- text


def text_profile(df: DataFrame, dataset: str = "", columns=None) -> DataFrame:
    """PR13-PR15, PR17-PR19 in one scan: lengths, padding, hidden nulls, number and date shapes."""
    cols = [c for c in columns_of(df, columns) if c.family == "text"]
    if not cols:
        return local_table(df.sparkSession, [], "dataset string, ordinal int, name string, nn bigint, avg_length double, whitespace_issues bigint,"
                " disguised_missing bigint, numeric_like bigint, ymd bigint, dmy bigint, mixed_type boolean,"
                " is_datetime boolean")
    stats = long_text(df, cols).groupBy("o").agg(*text_sums()).withColumn("ordinal", ordinal_of(F.col("o"))).drop("o")
    return judged_text(_named(df, stats, dataset, [c.name for c in cols]))


def text_sums() -> list[Column]:
    """Aggregates of a text v."""
    v = F.col("v")
    return [F.count(v).alias("nn"), F.avg(F.char_length(v)).alias("avg_length"), F.count_if(X.strip(v) != v).alias("whitespace_issues"),
            F.count_if(X.is_disguised_missing(v)).alias("disguised_missing"), F.count_if(X.looks_numeric(v)).alias("numeric_like"),
            F.count_if(X.is_ymd(v)).alias("ymd"), F.count_if(X.is_dmy(v)).alias("dmy")]


def judged_text(named: DataFrame) -> DataFrame:
    counts = ("nn", "whitespace_issues", "disguised_missing", "numeric_like", "ymd", "dmy")
    share = N.ratio(F.col("numeric_like"), F.col("nn"))
    return named.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in counts}).withColumns({
        "avg_length": F.round("avg_length", 4),
        "mixed_type": F.coalesce((share > 0.1) & (share < 0.9), F.lit(False)),
        "is_datetime": (F.col("nn") > 0) & ((F.col("ymd") == F.col("nn")) | (F.col("dmy") == F.col("nn"))),
    })


def _top(h: DataFrame, order, k: int, ties: bool = False) -> DataFrame:
    """First k histogram rows per column, with `ties` all that are no worse; Spark keeps only those per column and task before the shuffle."""
    w = Window.partitionBy("ordinal").orderBy(*order)
    return h.withColumn("rank", (F.rank() if ties else F.row_number()).over(w)).where(F.col("rank") <= k)


def _restore_text(df: DataFrame, top: DataFrame, columns) -> DataFrame:
    """Replace digests of long text by the text.

    `top` is settled first; the table is only read again when one of its rows is a digest, and then only rows that match one
    keep their text. How large those are is left to the engine, so nothing is broadcast unless it is small.
    """
    top = settle(top)
    digests = top.where(F.char_length("value_str") == DIGEST_LENGTH)
    if digests.isEmpty():
        return top
    cols = [c for c in columns_of(df, columns) if c.family == "text"]
    # digests alone, at most k rows per column and their ties: the wide side is not shuffled while they are small
    wanted = digests.select(F.concat(F.lit("c"), F.col("ordinal").cast("string")).alias("o"), F.col("value_str").alias("digest")).distinct()
    long = long_text(df, cols).where(F.char_length("v") > DIGEST_OVER).withColumn("digest", F.sha2("v", 256))
    texts = long.join(wanted, ["o", "digest"]).groupBy("o", "digest").agg(F.any_value("v").alias("text"))
    texts = texts.select(ordinal_of(F.col("o")).alias("ordinal"), F.col("digest").alias("value_str"), "text")
    return top.join(texts, ["ordinal", "value_str"], "left").withColumn(
        "value_str", F.coalesce("text", "value_str")).drop("text")


def top_values(df: DataFrame, dataset: str = "", columns=None, k: int = 5) -> DataFrame:
    """PR12: the k most frequent values of every text column; the null bucket is labelled None.

    Ties go to the smaller value. Long texts are counted by digest, each with its first characters: those order all but
    values that begin alike, and only values still tied with the k-th are restored before the last ranking.
    """
    cols = columns_of(df, columns)
    names = [c.name for c in cols if c.family == "text"]
    texts = [c for c in cols if c.family == "text"]
    if not texts:
        return local_table(df.sparkSession, [], "dataset string, ordinal int, name string, rank int, value string, count bigint")
    cells = unpivot(df, [(c.ordinal, F.struct(compare_key(pos(c)).alias("value_str"), F.substring(pos(c), 1, DIGEST_OVER).alias("begin"))) for c in texts])
    h = cells.select("o", "v.*").groupBy("o", "value_str").agg(F.count(F.lit(1)).alias("cnt"), F.min("begin").alias("begin")).select(
        ordinal_of(F.col("o")).alias("ordinal"), "value_str", "begin", "cnt")
    top = _top(h, [F.desc("cnt"), F.asc_nulls_first("begin")], k, ties=True).drop("rank", "begin")
    top = _top(_restore_text(df, top, names), [F.desc("cnt"), F.asc_nulls_first("value_str")], k)
    return _named(df, top, dataset, names).where("rank is not null").select(
        "dataset", "ordinal", "name", "rank", F.coalesce("value_str", F.lit("None")).alias("value"),
        F.col("cnt").alias("count"),
    )


def sample_values(df: DataFrame, dataset: str = "", columns=None, k: int = 5, seed: int = 0) -> DataFrame:
    """PR16: up to k pseudo-random distinct non-null values per column, the same on every run.

    Values are drawn by the order of a digest of their text; numbers with a fraction are written with ten digits for it.
    """
    h = histogram(df, columns).where(~is_null_bucket())
    value = F.coalesce(F.col("value_int").cast("string"), F.col("value_dbl").cast("string"), F.col("value_str"))
    drawn = F.when(F.col("value_dbl").isNotNull(), F.format_string("%.9e", "value_dbl")).otherwise(value)
    top = _top(h.withColumn("value", value), [F.md5(F.concat(drawn, F.lit(f"#{seed}"))), drawn, value], k)
    top = _restore_text(df, top, columns)
    return _named(df, top, dataset, columns).where("rank is not null").select(
        "dataset", "ordinal", "name", "rank", F.coalesce("value_str", "value").alias("value")
    )


# ---------------------------------------------------------------- rules over the profile


def id_columns(schema: DataFrame, counts: DataFrame, id_by_name_only: bool = False) -> DataFrame:
    """PR20: identifier by name fragment, or because all non-null values differ."""
    by_name = X.contains_any(F.col("name"), K.ID_KEYWORDS)
    nn = F.col("rows") - F.col("missing_count")
    by_value = (nn > 0) & (F.col("unique_count") == nn) if not id_by_name_only else F.lit(False)
    return schema.join(counts.drop("name"), ["dataset", "ordinal"]).select(
        "dataset", "ordinal", "name", (by_name | by_value).alias("is_id")
    )


def column_kinds(schema: DataFrame, counts: DataFrame, text: DataFrame) -> DataFrame:
    """PR21: what a column holds, judged by type, distinct values and number-like text."""
    nu, share = F.col("unique_count"), F.col("unique_count") / F.greatest(F.col("rows"), F.lit(1))
    numeric = F.col("family").isin("integer", "float", "decimal")
    kind = (
        F.when(F.col("family") == "boolean", "boolean")
        .when(F.col("family") == "temporal", "datetime")
        .when(numeric & (nu <= 10) & (share < 0.05), "numeric_categorical")
        .when(numeric, "numeric")
        .when(F.col("family") != "text", "unknown")
        .when(F.col("mixed_type"), "mixed_type")
        .when(nu <= 20, "categorical_low")
        .when(share > 0.9, "high_cardinality")
        .otherwise("categorical")
    )
    return (
        schema.join(counts.drop("name"), ["dataset", "ordinal"])
        .join(text.select("dataset", "ordinal", "mixed_type"), ["dataset", "ordinal"], "left")
        .select("dataset", "ordinal", "name", "dtype", kind.alias("kind"))
    )


def _names_where(flag: Column) -> Column:
    """Names of the flagged rows of a group, in column order."""
    pairs = F.sort_array(F.collect_list(F.when(flag, F.struct("ordinal", "name"))))
    return F.transform(pairs, lambda p: p["name"])


def structure_type(schema: DataFrame, ids: DataFrame, text: DataFrame) -> DataFrame:
    """PR22: time-series with any datetime column, panel with two id columns, else cross-sectional."""
    flags = (
        schema.join(ids.select("dataset", "ordinal", "is_id"), ["dataset", "ordinal"])
        .join(text.select("dataset", "ordinal", "is_datetime"), ["dataset", "ordinal"], "left")
    )
    is_dt = (F.col("family") == "temporal") | F.coalesce(F.col("is_datetime"), F.lit(False))
    return flags.groupBy("dataset").agg(
        _names_where(is_dt).alias("datetime_columns"), _names_where(F.col("is_id")).alias("id_columns")
    ).select(
        "dataset",
        F.when(F.size("datetime_columns") > 0, "time-series").when(F.size("id_columns") >= 2, "panel")
        .otherwise("cross-sectional").alias("type"),
        "datetime_columns", "id_columns",
    )


def kind_counts(schema: DataFrame) -> DataFrame:
    """PR23: numeric, text and boolean columns per dataset."""
    return schema.groupBy("dataset").agg(
        F.count_if(F.col("family").isin("integer", "float", "decimal")).alias("numeric_count"),
        F.count_if(F.col("family") == "text").alias("categorical_count"),
        F.count_if(F.col("family") == "boolean").alias("boolean_count"),
    )


def column_notes(profile: DataFrame) -> DataFrame:
    """PR24: short notes per column, joined by comma."""
    notes = F.array_compact(F.array(
        F.when(F.col("missing_pct") >= 50, "high missingness"),
        F.when(F.abs("skewness") > 2, F.format_string("skewed (%.1f)", "skewness")),
        F.when(F.col("disguised_missing") > 0, F.format_string("%d disguised nulls", "disguised_missing")),
        F.when(F.col("whitespace_issues") > 0, F.lit("whitespace issues")),
        F.when(F.col("inf_count") > 0, F.format_string("%d infinities", "inf_count")),
    ))
    return profile.select("dataset", "ordinal", "name", F.array_join(notes, ", ").alias("notes"))


def _listed(rows: DataFrame, item: Column, name: str) -> DataFrame:
    grouped = rows.groupBy("dataset", "ordinal").agg(F.sort_array(F.collect_list(F.struct("rank", item.alias("it")))).alias("a"))
    return grouped.select("dataset", "ordinal", F.transform("a", lambda x: x["it"]).alias(name))


def column_profile(schema, counts, kinds, m, order_stats, text, tops, samples) -> DataFrame:
    """The full profile: one row per column, assembled from the operators above."""
    key = ["dataset", "ordinal"]
    numbers = numeric_profile(m).drop("name").join(shape_profile(m).drop("name"), key).join(
        inf_counts(m).drop("name"), key)
    ranks = order_stats.select(*key, N.finite_or_null(F.col("median")).alias("median"),
                               N.finite_or_null(F.col("q25")).alias("q25"), N.finite_or_null(F.col("q75")).alias("q75"))
    words = text.select(*key, "avg_length", "whitespace_issues", "disguised_missing")
    top_list = _listed(tops, F.struct(F.col("value"), F.col("count")), "top_values")
    sample_list = _listed(samples, F.col("value"), "sample_values")
    out = kinds.join(counts.drop("name", "rows"), key)
    for part in (sample_list, numbers, ranks, top_list, words):
        out = out.join(part, key, "left")
    return out.select(
        "dataset", "ordinal", "name", "dtype", "kind", "missing_count", "missing_pct", "unique_count", "unique_pct",
        "sample_values", "mean", "std", "min", "max", "median", "q25", "q75", "skewness", "kurtosis", "zeros_pct",
        "negative_pct", "inf_count", "top_values", "avg_length", "whitespace_issues", "disguised_missing",
    )
