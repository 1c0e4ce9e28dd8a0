"""The table behind each report chart (CH1-CH14). Drawing is left to whoever shows them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colscope.functions import numeric as N
from colscope.operators.missing import co_missing, co_missing_pairs  # noqa: F401  CH11

MISSING_BANDS = ((50, "critical"), (20, "high"), (5, "medium"))


def _top(df: DataFrame, order, k: int | None = None) -> DataFrame:
    """Rows with their rank; all of them, or the first k."""
    w = Window.partitionBy("dataset").orderBy(*order)
    ranked = df.withColumn("rank", F.row_number().over(w))
    return ranked if k is None else ranked.where(F.col("rank") <= k)


def missing_values(counts: DataFrame, k: int | None = None) -> DataFrame:
    """CH1: columns with gaps, most first, with a severity band."""
    gaps = counts.where("missing_pct > 0")
    return _top(gaps, [F.desc("missing_pct"), "ordinal"], k).select(
        "dataset", "rank", "name", "missing_pct", N.bands(F.col("missing_pct"), MISSING_BANDS, "low").alias("band"))


def correlation(pairs: DataFrame) -> DataFrame:
    """CH2: the symmetric matrix as rows, for all columns; null where r is undefined, 1 on the diagonal."""
    value = N.rounded(F.col("r"), 3).alias("value")
    above = pairs.select("dataset", F.col("col_a").alias("row"), F.col("col_b").alias("col"), value)
    names = pairs.select("dataset", F.explode(F.array("col_a", "col_b")).alias("row")).distinct()
    return above.unionByName(above.select("dataset", F.col("col").alias("row"), F.col("row").alias("col"), "value")).unionByName(
        names.select("dataset", "row", F.col("row").alias("col"), F.lit(1.0).alias("value")))


def target_distribution(targets: DataFrame, distribution: DataFrame, profile: DataFrame) -> DataFrame:
    """CH3: classes of the first target, or min, max, mean and median of a numeric regression target."""
    first = targets.where("rank = 1").select("dataset", "ordinal", "task_type")
    classes = distribution.join(first, ["dataset", "ordinal"]).select(
        "dataset", "name", F.col("value").alias("label"), F.col("count").cast("double").alias("amount"), "pct", "flag")
    numbers = profile.join(first.where("task_type = 'regression'"), ["dataset", "ordinal"]).where("top_values is null")
    stats = numbers.select("dataset", "name", F.explode(F.array(*[
        F.struct(F.lit(c).alias("label"), F.col(c).alias("amount")) for c in ("min", "max", "mean", "median")])).alias("s"))
    return classes.unionByName(stats.where("s.amount is not null").select(
        "dataset", "name", "s.label", "s.amount", F.lit(None).cast("double").alias("pct"), F.lit("normal").alias("flag")))


def outliers(summary: DataFrame, k: int | None = None) -> DataFrame:
    """CH4: columns with at least 1% outliers."""
    hit = summary.where("outlier_pct >= 1")
    return _top(hit, [F.desc("outlier_pct"), "ordinal"], k).select(
        "dataset", "rank", "column", "outlier_count", "outlier_pct",
        N.bands(F.col("outlier_pct"), ((15, "critical"), (5, "high")), "medium").alias("band"))


def skewness(shapes: DataFrame, k: int | None = None) -> DataFrame:
    """CH5: columns with |skewness| of at least 1."""
    a = F.abs("skewness")
    return _top(shapes.where(a >= 1), [F.desc(a), "ordinal"], k).select(
        "dataset", "rank", "column", "skewness",
        N.bands(a, ((50, "critical"), (10, "high"), (3, "medium")), "normal").alias("band"))


def _steps(value: Column, steps, last) -> Column:
    out = F
    for limit, points in steps:
        out = out.when(value < limit, points)
    return out.otherwise(last)


def health_radar(info, duplicates, outlier_rows, shapes, findings, split) -> DataFrame:
    """CH6: six scores from 0 to 100, their mean and a label.

    Consistency counts the text and constant-column issues of the full finding list.
    """
    avg_out = outlier_rows.groupBy("dataset").agg(F.avg("outlier_pct").alias("avg_out"))
    extreme = shapes.groupBy("dataset").agg(F.count_if(F.abs("skewness") >= 10).alias("extreme"))
    bad = findings.groupBy("dataset").agg(F.count_if(F.col("type").isin(
        "whitespace_issues", "disguised_missing", "mixed_types", "constant_column")).alias("bad"))
    x = info.join(duplicates, "dataset").join(split, "dataset")
    for part in (avg_out, extreme, bad):
        x = x.join(part, "dataset", "left")
    x = x.fillna(0, ["avg_out", "extreme", "bad"])
    miss, avg_o = F.col("missing_percentage"), F.col("avg_out")
    dup = F.col("duplicate_rows") / F.greatest("rows", F.lit(1)) * 100
    scores = {
        "completeness": F.when(miss == 0, 100).otherwise(_steps(miss, ((2, 90), (5, 75), (15, 55), (30, 35)), 15)),
        "uniqueness": F.when(dup == 0, 100).otherwise(_steps(dup, ((1, 85), (5, 65), (10, 45)), 25)),
        "consistency": _steps(F.col("bad"), ((1, 100), (3, 80), (6, 60), (11, 40)), 20),
        "distribution": _steps(F.col("extreme"), ((1, 100), (3, 75), (6, 50)), 25),
        "outliers": F.when(avg_o == 0, 100).otherwise(_steps(avg_o, ((2, 85), (5, 65), (10, 45), (20, 25)), 10)),
        "reliability": F.greatest(F.lit(0), 100 - F.col("critical") * 20 - F.col("high") * 8),
    }
    out = x.select("dataset", *[s.cast("int").alias(n) for n, s in scores.items()])
    overall = sum((F.col(n) for n in list(scores)[1:]), F.col("completeness")) / len(scores)
    return out.withColumn("overall", F.round(overall, 4)).withColumn(
        "label", N.bands(overall, ((85, "Excellent"), (70, "Good"), (50, "Fair")), "Poor"))


def column_types(schema: DataFrame) -> DataFrame:
    """CH7: columns per type label."""
    f = F.col("family")
    label = (F.when(f.isin("integer", "float", "decimal"), "Numeric").when(f == "text", "Text")
             .when(f == "temporal", "Datetime").when(f == "boolean", "Boolean").otherwise("Other"))
    return schema.groupBy("dataset", label.alias("label")).agg(F.count(F.lit(1)).alias("n"))


def duplicates(info: DataFrame, dups: DataFrame) -> DataFrame:
    """CH8: unique against duplicate rows; nothing for a table without duplicates."""
    return info.join(dups, "dataset").where("duplicate_rows > 0").select(
        "dataset", (F.col("rows") - F.col("duplicate_rows")).alias("unique_rows"), "duplicate_rows",
        N.pct(F.col("duplicate_rows"), F.col("rows")).alias("duplicate_pct"))


def cardinality(counts: DataFrame, k: int | None = None) -> DataFrame:
    """CH9: distinct values per column, most first."""
    return _top(counts, [F.desc("unique_count"), "ordinal"], k).select(
        "dataset", "rank", "name", "unique_count", "unique_pct",
        N.bands(F.col("unique_pct"), ((95, "nearly unique"), (80, "high")), "normal").alias("band"))


def feature_importance(targets: DataFrame, correlations: DataFrame, k: int | None = None) -> DataFrame:
    """CH10: |r| of the pairs that touch the first target."""
    first = targets.where("rank = 1").select("dataset", F.col("column").alias("target"))
    x = correlations.join(F.broadcast(first), "dataset").where(
        (F.col("col_a") == F.col("target")) | (F.col("col_b") == F.col("target")))
    other = F.when(F.col("col_a") == F.col("target"), F.col("col_b")).otherwise(F.col("col_a"))
    x = x.select("dataset", "target", other.alias("feature"), F.abs("correlation").alias("importance"), "i", "j")
    return _top(x, [F.desc("importance"), "i", "j"], k).select(
        "dataset", "rank", "target", "feature", "importance",
        N.bands(F.col("importance"), ((0.5, "strong"), (0.3, "moderate")), "weak").alias("band"))


def missing_pattern(counts: DataFrame, k: int | None = None) -> DataFrame:
    """CH11: columns with gaps when there are at least two, most first."""
    gaps = counts.where("missing_pct > 0").withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("dataset")))
    return _top(gaps.where("n >= 2"), [F.desc("missing_pct"), "ordinal"], k).select(
        "dataset", "rank", "name", "missing_pct", N.bands(F.col("missing_pct"), MISSING_BANDS, "low").alias("band"))


def box_plots(quartiles: DataFrame, k: int | None = None) -> DataFrame:
    """CH12: median, quartiles and whiskers of the numeric columns."""
    return _top(quartiles.where("q25 is not null and q75 is not null"), ["ordinal"], k).select(
        "dataset", "rank", "name", "median", "q25", "q75", "whisker_low", "whisker_high")


def pca_variance(summary: DataFrame) -> DataFrame:
    """CH13: explained variance per component in percent."""
    return summary.select("dataset", "component", F.round(F.col("ratio") * 100, 2).alias("ratio_pct"),
                          F.round(F.col("cumulative") * 100, 2).alias("cumulative_pct"))


def cluster_points(points: DataFrame) -> DataFrame:
    """CH14: points with the size of their cluster."""
    sizes = points.groupBy("dataset", "label").agg(F.count(F.lit(1)).alias("cluster_points"))
    return points.select("dataset", "pc1", "pc2", "label").join(sizes, ["dataset", "label"])
