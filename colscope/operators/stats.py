"""Statistical checks (ST1-ST18). All of them read every row; nothing is sampled unless asked for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colscope.functions.session import local_table
from colscope import constants as K
from colscope.functions import numeric as N
from colscope.functions import text as X
from colscope.operators import quality
from colscope.operators.gram import gram_sums, group_correlations, pearson, residual_spreads
from colscope.operators.longform import by_position, columns_of, compare_key, long_numeric, long_text, ordinal_of, pos
from colscope.operators.quantiles import order_statistics
from colscope.schemas import as_finding, empty_findings, seq, seq_of_three

PAIR_DDL = "dataset string, i int, j int, col_a string, col_b string, n bigint, r double"


# ---------------------------------------------------------------- ST1-ST3


def sentinel_scrub(df: DataFrame, known: DataFrame | None = None, dataset: str = "", columns=None,
                   rescan: bool = True):
    """ST1: null out placeholder numbers. Returns (clean table, audit log).

    Columns named in `known` (from QI4) are scrubbed with the values found there; every other
    numeric column is scanned again, unless `known` came from this very table (`rescan=False`).
    The values become literals of one projection.
    """
    if known is None:
        known, rescan = quality.sentinel_candidates(df, dataset, columns), False
    first = known.withColumn("source", F.lit("blueprint"))
    flagged = {r["name"]: r["sentinel_values"] for r in first.select("name", "sentinel_values").collect()}
    rest = [c.name for c in columns_of(df, columns) if c.numeric and c.name not in flagged] if rescan else []
    second = quality.sentinel_candidates(df, dataset, rest).withColumn("source", F.lit("safety_net"))
    flagged |= {r["name"]: r["sentinel_values"] for r in second.select("name", "sentinel_values").collect()}
    log = first.unionByName(second).select(
        "dataset", "ordinal", F.col("name").alias("column"), "source", F.col("sentinel_values").alias("values"),
        F.aggregate("counts", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("cells_replaced"))
    return (quality.mask_values(df, flagged) if flagged else df), log


def row_sample(df: DataFrame, k: int = K.SAMPLE_MAX_ROWS, seed: int = 42, key: list[str] | None = None) -> DataFrame:
    """ST2: at most k rows, those with the smallest digest of seed and key (all columns by default).

    The choice depends on the rows alone, not on how they are partitioned. Tasks keep k rows each before
    the final ordering.
    """
    if key is None:
        digest = F.xxhash64(F.lit(seed), *[F.col(f"`{c}`") for c in df.columns])
    else:
        digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(f"`{c}`").cast("string") for c in key]).cast("binary"))
    return df.withColumn("_u", digest).orderBy("_u").limit(k).drop("_u")


def feature_columns(schema: DataFrame, ids: DataFrame) -> DataFrame:
    """ST3: numeric columns that are not identifiers, and all text columns."""
    numeric = F.col("family").isin("integer", "float", "decimal") & ~F.col("is_id")
    return schema.join(ids.select("dataset", "ordinal", "is_id"), ["dataset", "ordinal"]).where(
        numeric | (F.col("family") == "text")
    ).select("dataset", "ordinal", "name", F.when(F.col("family") == "text", "text").otherwise("numeric").alias("role"))


# ---------------------------------------------------------------- ST4-ST7


def _typical(df: DataFrame, cols) -> dict[int, float]:
    """A value near each column's median, to shift by; one aggregation over the long form."""
    rows = long_numeric(df, cols).groupBy("o").agg(F.percentile_approx(N.finite(F.col("v")), F.lit(0.5), F.lit(1000)).alias("c")).select(
        ordinal_of(F.col("o")).alias("ordinal"), "c").collect()
    return {r["ordinal"]: r["c"] for r in rows}


def pearson_pairs(df: DataFrame, columns=None, dataset: str = "", centers: dict[int, float] | None = None) -> DataFrame:
    """ST4: Pearson r of all numeric column pairs by pairwise deletion; undefined pairs are null."""
    cols = [c for c in columns_of(df, columns) if c.numeric]
    if len(cols) < 2:
        return local_table(df.sparkSession, [], PAIR_DDL)
    return pair_correlations(gram_sums(df, cols, _typical(df, cols) if centers is None else centers), names_of(df), dataset)


def names_of(df: DataFrame) -> list[str]:
    return list(df.columns)


def named(names: list[str], ordinal: str) -> Column:
    return F.array(*[F.lit(n) for n in names])[F.col(ordinal)]


def pair_correlations(sums: DataFrame, names: list[str], dataset: str = "") -> DataFrame:
    """ST4 from pair sums; `names` are all columns of the table."""
    return sums.where("kind = 'pair'").select(
        F.lit(dataset).alias("dataset"), "i", "j", named(names, "i").alias("col_a"), named(names, "j").alias("col_b"),
        F.col("n").cast("bigint").alias("n"), pearson().alias("r"))


def strength(r: Column) -> Column:
    return N.bands(F.abs(r), K.STRENGTH_LABELS, "negligible")


def known_correlations(pairs: DataFrame) -> DataFrame:
    """All defined pairs with rounded r and strength, which is judged before rounding."""
    return pairs.where("r is not null").select(
        "dataset", "i", "j", "col_a", "col_b", N.rounded(F.col("r"), 3).alias("correlation"), strength(F.col("r")).alias("strength"), "n")


def top_correlations(pairs: DataFrame, k: int = K.TOP_PAIRS) -> DataFrame:
    """ST5: the k strongest defined pairs per dataset."""
    w = Window.partitionBy("dataset").orderBy(F.desc(F.abs("correlation")), "i", "j")
    return known_correlations(pairs).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(
        "dataset", "rank", "col_a", "col_b", "correlation", "strength", "n")


def multicollinearity(pairs: DataFrame) -> DataFrame:
    """ST6: |r| of at least 0.95; the finding carries |r|."""
    a = F.abs("r")
    return as_finding(pairs.where(a >= 0.95), seq=seq(9, F.col("i"), F.col("j")), type="multicollinearity",
                      severity="high", var1=F.col("col_a"), var2=F.col("col_b"), correlation=F.round(a, 3),
                      message=F.format_string('"%s" and "%s" are almost the same (|r| = %.2f).', "col_a", "col_b", a))


def high_correlation(pairs: DataFrame) -> DataFrame:
    """ST7: |r| from 0.85 up to 0.95."""
    a = F.abs("r")
    return as_finding(pairs.where((a >= 0.85) & (a < 0.95)), seq=seq(9, F.col("i"), F.col("j")),
                      type="high_correlation", severity="medium", var1=F.col("col_a"), var2=F.col("col_b"),
                      correlation=F.round(a, 3),
                      message=F.format_string('"%s" and "%s" move together (|r| = %.2f).', "col_a", "col_b", a))


# ---------------------------------------------------------------- ST8, ST17


def outlier_counts(df: DataFrame, order_stats: DataFrame, columns=None, dataset: str = "") -> DataFrame:
    """Values outside 1.5 and 3 IQR of every numeric column with at least 10 values and a spread."""
    cols = [c for c in columns_of(df, columns) if c.numeric]
    if not cols:
        return local_table(df.sparkSession, [], "dataset string, ordinal int, name string, nn bigint, mild bigint, extreme bigint")
    iqr = F.col("q75") - F.col("q25")
    bounds = order_stats.where((F.col("nn") >= 10) & (iqr != 0)).select(
        F.concat(F.lit("c"), F.col("ordinal").cast("string")).alias("o"), "ordinal", "name", "q25", "q75")
    v = F.col("v")

    def beyond(width):
        return F.count_if((v < F.col("q25") - iqr * width) | (v > F.col("q75") + iqr * width))

    return (
        long_numeric(df, cols).where(v.isNotNull()).join(F.broadcast(bounds), "o")
        .groupBy("ordinal", "name").agg(F.count(v).alias("nn"), beyond(1.5).alias("mild"), beyond(3.0).alias("extreme"))
        .select(F.lit(dataset).alias("dataset"), "ordinal", "name", "nn", "mild", "extreme")
    )


def high_outliers(outliers: DataFrame) -> DataFrame:
    """ST8: at least 5% of the values beyond three IQR."""
    p = F.col("extreme") / F.col("nn") * 100
    return as_finding(outliers.where(p >= 5), seq=seq(10, F.col("ordinal")), type="high_outliers", severity="medium",
                      column=F.col("name"), percentage=F.round(p, 1),
                      message=F.format_string('%.1f%% of "%s" are extreme outliers.', p, F.col("name")))


def outlier_summary(outliers: DataFrame, features: DataFrame, limit_columns: int | None = None) -> DataFrame:
    """ST17: share of values beyond 1.5 IQR of every numeric column (or of the first `limit_columns`), largest share first."""
    p = F.round(F.col("mild") / F.col("nn") * 100, 2)
    first = _first_numeric(features, limit_columns)
    return outliers.join(first, ["dataset", "ordinal"], "left_semi").where("mild > 0").select(
        "dataset", "ordinal", F.col("name").alias("column"), F.col("mild").alias("outlier_count"),
        p.alias("outlier_pct"))


def _first_numeric(features: DataFrame, limit_columns: int | None) -> DataFrame:
    numeric = features.where("role = 'numeric'")
    if limit_columns is None:
        return numeric
    w = Window.partitionBy("dataset").orderBy("ordinal")
    return numeric.withColumn("at", F.row_number().over(w)).where(F.col("at") <= limit_columns).drop("at")


# ---------------------------------------------------------------- ST9, ST10


def _xy(df: DataFrame, x: str, y: str) -> DataFrame:
    cols = {c.name: c for c in columns_of(df)}
    return by_position(df).select(
        N.as_double(pos(cols[x]), cols[x].dtype).alias("x"), N.as_double(pos(cols[y]), cols[y].dtype).alias("y")
    ).where("x is not null and y is not null")


def ols_fit(df: DataFrame, x: str, y: str, dataset: str = "") -> DataFrame:
    """ST9: least squares of y on x over complete rows; null when x has no spread."""
    return _xy(df, x, y).agg(
        F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"),
        F.count(F.lit(1)).alias("n"),
    ).select(F.lit(dataset).alias("dataset"), F.lit(x).alias("x"), F.lit(y).alias("y"), "slope", "intercept", "n")


SPREAD_DDL = "dataset string, x string, y string, n bigint, n_low bigint, n_high bigint, ratio double"


def residual_spread(df: DataFrame, x: str, y: str, dataset: str = "") -> DataFrame:
    """Residual variance at or above the median of x over the variance below it."""
    spark = df.sparkSession
    fit = ols_fit(df, x, y).first()
    if fit["n"] < 30 or fit["slope"] is None:
        return local_table(spark, [], SPREAD_DDL)
    xy = _xy(df, x, y)
    med = order_statistics(xy, columns=["x"], sizes={0: fit["n"]}).first()["median"]
    res = F.col("y") - (F.col("x") * fit["slope"] + fit["intercept"])
    high = F.col("x") >= F.lit(med)
    return xy.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(~high).alias("n_low"), F.count_if(high).alias("n_high"),
        F.var_pop(F.when(high, res)).alias("vh"), F.var_pop(F.when(~high, res)).alias("vl"),
    ).select(F.lit(dataset).alias("dataset"), F.lit(x).alias("x"), F.lit(y).alias("y"), "n", "n_low", "n_high",
             (F.col("vh") / (F.col("vl") + 1e-10)).alias("ratio"))


def pair_spreads(sums: DataFrame, names: list[str], dataset: str = "") -> DataFrame:
    """ST10 of every ordered pair from its sums. The median is that of all values of x; `residual_spread` takes those beside a y."""
    return residual_spreads(sums).select(F.lit(dataset).alias("dataset"), named(names, "i").alias("x"), named(names, "j").alias("y"),
                                         "n", "n_low", "n_high", "ratio", "i", "j")


def heteroscedasticity(spread: DataFrame) -> DataFrame:
    """ST10: residual spread that changes by more than a factor of four across the median of x."""
    uneven = (F.col("n_low") >= 5) & (F.col("n_high") >= 5) & ((F.col("ratio") > 4) | (F.col("ratio") < 0.25))
    place = seq(11, F.col("i"), F.col("j")) if "i" in spread.columns else seq(11)
    return as_finding(spread.where(uneven), seq=place, type="heteroscedasticity", severity="high",
                      columns=F.array("x", "y"),
                      message=F.format_string('The spread of "%s" around its trend changes along "%s".', "y", "x"))


# ---------------------------------------------------------------- ST11, ST12, ST16, ST18


def near_zero_variance(m: DataFrame, counts: DataFrame) -> DataFrame:
    """ST11: standard deviation below 1% of the mean, with more than one value."""
    cv = F.col("std") / (F.abs("mean") + 1e-10)
    both = m.join(counts.select("dataset", "ordinal", "unique_count"), ["dataset", "ordinal"])
    return as_finding(both.where((F.col("nn") >= 10) & (cv < 0.01) & (F.col("unique_count") > 1)),
                      seq=seq(12, F.col("ordinal")), type="near_zero_variance", severity="medium", column=F.col("name"),
                      message=F.format_string('Column "%s" barely varies.', "name"))


def extreme_skewness(m: DataFrame, order_stats: DataFrame) -> DataFrame:
    """ST12: |skewness| of at least 50; undefined skewness is no finding."""
    s = F.col("skewness")
    both = m.join(order_stats.select("dataset", "ordinal", "q01", "q99"), ["dataset", "ordinal"])
    far = F.when(s > 0, F.col("max")).otherwise(F.col("min"))
    return as_finding(both.where((F.col("nn") >= 10) & (F.abs(s) >= K.EXTREME_SKEW)), seq=seq(13, F.col("ordinal")),
                      type="extreme_skewness", severity="high", column=F.col("name"), skewness=F.round(s, 2),
                      message=F.format_string('"%s" is skewed to the %s (%.1f): %.1f against a usual range of %.1f to %.1f.',
                                              F.col("name"), F.when(s > 0, "right").otherwise("left"), s, far,
                                              F.col("q01"), F.col("q99")))


def patterns(info: DataFrame, schema: DataFrame, features: DataFrame, m: DataFrame) -> DataFrame:
    """ST16: table-level traits."""
    skew = features.where("role = 'numeric'").join(m.select("dataset", "ordinal", "skewness"), ["dataset", "ordinal"], "left")
    a = F.abs("skewness")

    def names(cond):
        return F.transform(F.sort_array(F.collect_list(F.when(cond, F.struct("ordinal", "name")))), lambda s: s["name"])

    numeric = skew.groupBy("dataset").agg(
        F.count(F.lit(1)).alias("n_numeric"), names((a > 2) & (a <= K.EXTREME_SKEW)).alias("skewed_columns"),
        names(a > K.EXTREME_SKEW).alias("extremely_skewed_columns"))
    texts = schema.groupBy("dataset").agg(F.count_if(F.col("family") == "text").alias("n_text"))
    n = F.coalesce("n_numeric", F.lit(0))
    none = F.array().cast("array<string>")
    return info.join(texts, "dataset").join(numeric, "dataset", "left").select(
        "dataset", (n > 0).alias("has_numeric_features"), (F.col("columns") > 50).alias("high_dimensional"),
        (F.col("rows") > 100_000).alias("large_dataset"), (F.col("rows") < 500).alias("small_dataset"),
        (F.col("n_text") > n).alias("many_categoricals"),
        F.coalesce("skewed_columns", none).alias("skewed_columns"),
        (F.size(F.coalesce("skewed_columns", none)) > 0).alias("has_skewed_features"),
        F.coalesce("extremely_skewed_columns", none).alias("extremely_skewed_columns"),
        (F.size(F.coalesce("extremely_skewed_columns", none)) > 0).alias("has_extreme_skewness"))


def distribution_summary(m: DataFrame, features: DataFrame, limit_columns: int | None = None) -> DataFrame:
    """ST18: skewness, kurtosis and the shape they suggest; undefined skewness reads as normal."""
    s = F.col("skewness")
    shape = (
        F.when(F.abs(s) > K.EXTREME_SKEW, "critically skewed").when(s > 2, "heavily right-skewed")
        .when(s > 0.5, "right-skewed").when(s < -2, "heavily left-skewed").when(s < -0.5, "left-skewed")
        .otherwise("roughly normal")
    )
    first = _first_numeric(features, limit_columns)
    return m.join(first, ["dataset", "ordinal"], "left_semi").where("nn >= 10").select(
        "dataset", "ordinal", F.col("name").alias("column"), N.rounded(s, 3).alias("skewness"),
        N.rounded(F.col("kurtosis"), 3).alias("kurtosis"), shape.alias("shape"))


# ---------------------------------------------------------------- ST13-ST15


def class_imbalance(targets: DataFrame, classes: DataFrame) -> DataFrame:
    """ST13: the first target holds at least 85% of the rows in one class (null bucket included)."""
    first = targets.where("rank = 1 and n_classes <= 20").select("dataset", "ordinal", "column")
    share = classes.join(first, ["dataset", "ordinal"]).groupBy("dataset", "column").agg(
        (F.max("cnt") / F.sum("cnt")).alias("share"))
    return as_finding(share.where("share >= 0.85"), seq=seq(6), type="class_imbalance", severity="critical",
                      column=F.col("column"), majority_pct=F.round(F.col("share") * 100, 1),
                      message=F.format_string('%.1f%% of the rows of target "%s" belong to one class.',
                                              F.col("share") * 100, F.col("column")))


def reversal_stats(df: DataFrame, a: str, b: str, by: str, dataset: str = "") -> DataFrame:
    """Correlation overall and inside every group, from one aggregation.

    Groups leave the data as moments; the overall correlation is the merge of those moments, so the
    table is read once and no group is gathered anywhere.
    """
    cols = {c.name: c for c in columns_of(df)}
    x, y = (N.as_double(pos(cols[n]), cols[n].dtype) for n in (a, b))
    base = by_position(df).select(x.alias("x"), y.alias("y"), pos(cols[by]).cast("string").alias("g"))
    both = F.col("x").isNotNull() & F.col("y").isNotNull()
    mx, my = F.when(both, F.col("x")), F.when(both, F.col("y"))
    groups = base.groupBy("g").agg(
        F.count_if(both).alias("n"), F.avg(mx).alias("mx"), F.avg(my).alias("my"),
        F.var_pop(mx).alias("vx"), F.var_pop(my).alias("vy"), F.covar_pop(mx, my).alias("cv"))
    whole = groups.agg(
        F.sum("n").alias("n"), F.count_if(F.col("g").isNotNull()).alias("n_groups"),
        N.ratio(F.sum(F.col("n") * F.col("mx")), F.sum("n")).alias("gx"),
        N.ratio(F.sum(F.col("n") * F.col("my")), F.sum("n")).alias("gy"))
    centred = groups.withColumn("k", F.lit(1)).join(F.broadcast(whole.withColumn("k", F.lit(1)).select("k", "gx", "gy", "n_groups")), "k")
    dx, dy = F.col("mx") - F.col("gx"), F.col("my") - F.col("gy")
    total = centred.agg(
        F.sum(F.col("n") * (F.col("cv") + dx * dy)).alias("c"), F.sum(F.col("n") * (F.col("vx") + dx * dx)).alias("vx"),
        F.sum(F.col("n") * (F.col("vy") + dy * dy)).alias("vy"), F.sum("n").alias("n"), F.max("n_groups").alias("n_groups"))
    overall = F.nanvl(F.col("c") / F.nullif(F.sqrt("vx") * F.sqrt("vy"), F.lit(0.0)), F.lit(None))
    overall = F.when(F.col("n") >= 3, overall)
    one = total.select(F.lit(1).alias("k"), overall.alias("overall_r"), "n_groups")
    group_r = F.col("cv") / F.nullif(F.sqrt("vx") * F.sqrt("vy"), F.lit(0.0))
    # Only the count of reversed groups matters, so groups are judged and summed where they are.
    return groups.where("g is not null").select(F.lit(1).alias("k"), "g", "n", group_r.alias("group_r")).join(
        F.broadcast(one), "k"
    ).select(F.lit(dataset).alias("dataset"), F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(by).alias("by"),
             F.col("g").alias("group"), "n", "group_r", "overall_r", "n_groups")


def pair_reversals(sums: DataFrame, names: list[str], n_groups: dict[int, int], dataset: str = "") -> DataFrame:
    """ST14 of every pair inside the groups of every column of `n_groups` (ordinal: number of values), from their sums."""
    groups = local_table(sums.sparkSession, list(n_groups.items()), "by int, n_groups bigint")
    # a row per text column
    return group_correlations(sums).join(F.broadcast(groups), "by").select(
        F.lit(dataset).alias("dataset"), named(names, "i").alias("a"), named(names, "j").alias("b"), named(names, "by").alias("by"),
        F.col("value").alias("group"), "n", "group_r", "overall_r", "n_groups", "i", "j", F.col("by").alias("k"))


def simpsons_paradox(stats: DataFrame) -> DataFrame:
    """ST14: at least two of 2-10 groups run against the overall trend with |r| above 0.2."""
    against = (
        (F.col("n") >= 10) & (F.signum("group_r") != F.signum("overall_r")) & (F.abs("group_r") > 0.2)
    )
    order = [c for c in ("i", "j", "k") if c in stats.columns]
    judged = stats.groupBy("dataset", "a", "b", "by", *order).agg(
        F.count_if(against).alias("reversed"), F.max("n_groups").alias("n_groups"), F.max("overall_r").alias("overall_r"))
    hit = judged.where("n_groups between 2 and 10 and reversed >= 2")
    return as_finding(hit, seq=seq_of_three(7, "k", "i", "j") if order else seq(7), type="simpsons_paradox", severity="critical", columns=F.array("a", "b", "by"),
                      count=F.col("reversed"),
                      message=F.format_string('"%s" against "%s" reverses inside %d groups of "%s".', "a", "b", "reversed", "by"))


def leakage_by_name(schema: DataFrame, targets: DataFrame) -> DataFrame:
    """ST15: columns other than the first target whose name hints at later knowledge."""
    first = targets.where("rank = 1").select("dataset", F.col("column").alias("target"))
    hit = schema.join(F.broadcast(first), "dataset").where(
        (F.col("name") != F.col("target")) & X.contains_any(F.col("name"), K.LEAKAGE_KEYWORDS))
    return as_finding(hit, seq=seq(8, F.col("ordinal")), type="data_leakage_risk", severity="critical",
                      column=F.col("name"),
                      message=F.format_string('The name "%s" suggests it may reveal the target "%s".', "name", "target"))


def all_triples(df: DataFrame, numeric: list[str], text: list[str], dataset: str = "") -> DataFrame:
    """ST14 over every pair of the given numeric columns and every text column of 2 to 10 values, in two reads of the table."""
    texts = columns_of(df, text)
    cols = [c for c in columns_of(df, numeric) if c.numeric]
    if len(cols) < 2 or not texts:
        return empty_findings(df)
    counts = long_text(df, texts).where("v is not null").groupBy("o").agg(F.count_distinct(compare_key(F.col("v"))).alias("n")).select(
        ordinal_of(F.col("o")).alias("ordinal"), "n").where("n between 2 and 10").collect()
    few = {r["ordinal"]: r["n"] for r in counts}
    sums = gram_sums(df, cols, _typical(df, cols), by=[(c, few[c.ordinal]) for c in texts if c.ordinal in few])
    return simpsons_paradox(pair_reversals(sums, names_of(df), few, dataset))
