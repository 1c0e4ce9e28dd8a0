"""Target detection (TG1-TG4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colscope import constants as K
from colscope.functions import numeric as N
from colscope.functions import text as X
from colscope.operators.longform import histogram

TOP_CANDIDATES = 3


def score_targets(schema: DataFrame, counts: DataFrame, whole_word_y: bool = False) -> DataFrame:
    """Score of every column as a target; the keyword 'y' matches as a substring unless told otherwise."""
    words = [w for w in K.TARGET_KEYWORDS if not (whole_word_y and w == "y")]
    named = X.contains_any(F.col("name"), words)
    if whole_word_y:
        named = named | F.lower("name").rlike(r"(^|[^a-z0-9])y($|[^a-z0-9])")
    nu = F.col("unique_count")
    numeric = F.col("family").isin("integer", "float", "decimal")
    last = F.col("ordinal") == F.max("ordinal").over(Window.partitionBy("dataset"))
    rules = (
        (named, 3, "named like a target"),
        (last, 1, "stands last"),
        (numeric & (nu == 2), 2, "two numbers"),
        (numeric & (nu != 2) & (nu <= 10), 1, "few numbers"),
        ((F.col("family") == "text") & (nu <= 10), 2, "few texts"),
    )
    score = sum((F.when(cond, points).otherwise(0) for cond, points, _ in rules), F.lit(0))
    reasons = F.array_compact(F.array(*[F.when(cond, F.lit(why)) for cond, _, why in rules]))
    return (
        schema.join(counts.select("dataset", "ordinal", "unique_count"), ["dataset", "ordinal"])
        .withColumns({"score": score, "reasons": reasons})
        .select("dataset", "ordinal", "name", "score",
                F.when(nu <= 10, "classification").otherwise("regression").alias("task_type"),
                nu.alias("n_classes"), "reasons")
    )


def class_counts(df: DataFrame, columns, dataset: str = "") -> DataFrame:
    """Class sizes of low-cardinality columns, null bucket included."""
    names = {i: n for i, n in enumerate(df.columns)}
    label = F.coalesce(F.col("value_int").cast("string"), F.col("value_dbl").cast("string"), F.col("value_str"))
    named = F.create_map(*[F.lit(x) for i, n in names.items() for x in (i, n)])
    return histogram(df, columns).select(
        F.lit(dataset).alias("dataset"), "ordinal", named[F.col("ordinal")].alias("name"),
        label.alias("value"), "cnt")


def imbalance_ratio(classes: DataFrame) -> DataFrame:
    """TG2: share of the largest class over share of the smallest; 1.0 for a single class."""
    return classes.groupBy("dataset", "ordinal", "name").agg(
        F.round(F.max("cnt") / F.min("cnt"), 2).alias("imbalance_ratio"), F.count(F.lit(1)).alias("buckets"))


def suggest_targets(scores: DataFrame, ratios: DataFrame) -> DataFrame:
    """TG1: the three best columns that score at least 2; ties keep column order."""
    w = Window.partitionBy("dataset").orderBy(F.desc("score"), "ordinal")
    best = scores.where("score >= 2").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= TOP_CANDIDATES)
    ratio = F.when(F.col("task_type") == "classification", F.col("imbalance_ratio"))
    return best.join(ratios.drop("name"), ["dataset", "ordinal"], "left").select(
        "dataset", "rank", "ordinal", F.col("name").alias("column"), "score", "task_type", "n_classes",
        ratio.alias("imbalance_ratio"), "reasons")


def explicit_target(candidates: DataFrame, scores: DataFrame, ratios: DataFrame, column: str) -> DataFrame:
    """TG3: the column a user names goes first; it is a classification target up to 20 values."""
    task = F.when(F.col("n_classes") <= 20, "classification").otherwise("regression")
    chosen = scores.where(F.col("name") == column).withColumn("task_type", task).join(
        ratios.drop("name"), ["dataset", "ordinal"], "left"
    ).select(
        "dataset", F.lit(0).alias("rank"), "ordinal", F.col("name").alias("column"), F.lit(999).alias("score"),
        "task_type", "n_classes",
        F.when((F.col("task_type") == "classification") & (F.col("buckets") >= 2), F.col("imbalance_ratio"))
        .alias("imbalance_ratio"),
        F.array(F.lit("chosen by the caller")).alias("reasons"))
    both = candidates.where(F.col("column") != column).unionByName(chosen)
    w = Window.partitionBy("dataset").orderBy("rank")
    return both.withColumn("rank", F.row_number().over(w))


def class_distribution(tops: DataFrame, counts: DataFrame) -> DataFrame:
    """TG4: the most frequent classes with their share of the column's rows; the majority is flagged at 50% and 70%."""
    per_column = Window.partitionBy("dataset", "ordinal")
    tops = tops.join(counts.select("dataset", "ordinal", "rows"), ["dataset", "ordinal"])
    share = N.ratio(F.col("count"), F.col("rows"))
    is_top = (F.col("count") == F.max("count").over(per_column)) & (F.count(F.lit(1)).over(per_column) >= 2)
    flag = F.when(is_top & (share > 0.7), "critical").when(is_top & (share > 0.5), "high").otherwise("normal")
    return tops.select("dataset", "ordinal", "name", "value", "count", F.round(share * 100, 2).alias("pct"),
                       flag.alias("flag"))
