"""Model recommendation (RC1-RC7): rules as columns, one row per dataset, so a catalogue is one job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colscope import constants as K

# Why a model is worth considering, in our own words.
WHY = {
    "Random Forest": "Steady default that shrugs off outliers and reports feature importance.",
    "XGBoost": "Strong on tables; takes missing values and class weights as they come.",
    "Logistic Regression": "Quick baseline whose coefficients are easy to explain.",
    "LightGBM": "Fast on many rows; takes categories without encoding.",
    "Support Vector Machine": "Good when classes are well separated and rows are few.",
    "Random Forest Regressor": "Steady default that shrugs off outliers and reports feature importance.",
    "XGBoost Regressor": "Strong on tables and tolerant of missing values.",
    "Ridge Regression": "Regularised linear baseline that copes with correlated features.",
    "LightGBM Regressor": "Fast on many rows with mixed feature types.",
    "Lasso Regression": "Linear model that drops features which do not help.",
}
FLAGS = ("on_missing", "on_imbalance", "on_outliers", "on_categories", "on_small", "on_large", "explainable")


def task_type(datasets: DataFrame, targets: DataFrame) -> DataFrame:
    """RC1: task of the first target candidate; classification without one."""
    first = targets.where("rank = 1").select("dataset", "task_type")
    return datasets.select("dataset").join(first, "dataset", "left").select(
        "dataset", F.coalesce("task_type", F.lit("classification")).alias("task_type"))


def characteristics(info: DataFrame, findings: DataFrame, patterns: DataFrame) -> DataFrame:
    """RC2: the traits that the rules below look at."""
    def seen(t):
        return F.bool_or(F.col("type") == t)

    flags = findings.groupBy("dataset").agg(
        seen("class_imbalance").alias("imb"), seen("multicollinearity").alias("mc"), seen("high_outliers").alias("out"))
    rows, cols, gaps = F.col("rows"), F.col("columns"), F.col("missing_percentage")

    def flag(c):
        return F.coalesce(F.col(c), F.lit(False))

    return info.join(flags, "dataset", "left").join(
        patterns.select("dataset", "many_categoricals", "has_skewed_features"), "dataset", "left"
    ).select(
        "dataset", rows.alias("n_rows"), cols.alias("n_cols"), flag("imb").alias("has_imbalance"),
        flag("mc").alias("has_multicollinearity"), flag("out").alias("has_outliers"), (gaps > 5).alias("has_missing"),
        gaps.alias("missing_pct"), (rows > 50_000).alias("is_large"), (rows < 500).alias("is_small"),
        (cols > 50).alias("is_high_dimensional"), flag("many_categoricals").alias("has_categoricals"),
        flag("has_skewed_features").alias("has_skewed"))


def _models() -> Column:
    """The model table as an array literal, so candidates come from explode and not from a join."""
    return F.array(*[
        F.struct(F.lit(task).alias("task"), F.lit(no).alias("rule_no"), F.lit(name).alias("model"),
                 F.lit(WHY[name]).alias("why"), *[F.lit(bool(f)).alias(n) for n, f in zip(FLAGS, flags)])
        for task, no, name, flags in K.MODELS
    ])


def _rules() -> list[tuple[Column, float, Column | None]]:
    """(when, points, reason): every scoring rule as one row of a table."""
    c = F.col
    name = c("model")
    clean = ~(c("has_missing") | c("has_imbalance") | c("is_large") | c("has_categoricals"))
    return [
        (c("has_missing") & c("on_missing"), 2.0,
         F.format_string("takes the %.0f%% missing values as they are", "missing_pct")),
        (c("has_missing") & ~c("on_missing"), -1.5, None),
        (c("has_imbalance") & c("on_imbalance"), 2.0, F.lit("can weight imbalanced classes")),
        (c("has_outliers") & c("on_outliers"), 1.0, F.lit("robust against the outliers found")),
        (c("has_outliers") & ~c("on_outliers"), -1.0, None),
        (c("has_categoricals") & c("on_categories"), 1.0, F.lit("takes categories without encoding")),
        (c("is_large") & c("on_large"), 1.5, F.lit("scales to this many rows")),
        (c("is_large") & ~c("on_large"), -2.5, None),
        (c("is_large") & name.contains("LightGBM"), 0.5, F.lit("histograms keep memory low at scale")),
        (c("is_small") & c("on_small"), 0.5, None),
        (~c("is_small") & ~c("is_large") & ~c("on_small"), -0.5, None),
        (c("has_multicollinearity") & name.isin("Ridge Regression", "Lasso Regression"), 1.0,
         F.lit("regularisation copes with the collinear columns")),
        (c("is_high_dimensional") & (name == "Lasso Regression"), 1.0, F.lit("selects among the many columns")),
        (clean & name.isin("Logistic Regression", "Ridge Regression"), 0.5,
         F.lit("clean data favours a fast, explainable baseline")),
        (c("on_small") & c("on_large") & ~c("on_missing") & ~c("on_imbalance"), -0.4, None),
    ]


def model_scores(traits: DataFrame, tasks: DataFrame) -> DataFrame:
    """RC3: score of every model for the dataset's task, capped at 10, with the reasons that applied."""
    candidates = traits.join(tasks, "dataset").withColumn("m", F.explode(_models())).select(
        *[c for c in traits.columns], "task_type", "m.*").where(F.col("task") == F.col("task_type"))
    rules = _rules()
    score = sum((F.when(cond, F.lit(points)).otherwise(F.lit(0.0)) for cond, points, _ in rules), F.lit(5.0))
    reasons = F.array_compact(F.array(*[F.when(cond, why) for cond, _, why in rules if why is not None]))
    return candidates.select(
        "dataset", "task_type", "rule_no", "model", F.round(F.least(score, F.lit(10.0)), 4).alias("score"),
        F.when(F.size(reasons) > 0, reasons).otherwise(F.array(F.lit("solid all-round choice"))).alias("reasons"), "why")


def pick_model(scores: DataFrame) -> DataFrame:
    """RC4: best model, the next two as alternatives, confidence as a tenth of the score."""
    ranked = scores.withColumn("rank", F.row_number().over(
        Window.partitionBy("dataset").orderBy(F.desc("score"), "rule_no")))
    first = F.col("rank") == 1
    others = F.sort_array(F.collect_list(F.when(F.col("rank").between(2, 3), F.struct("rank", "model", "why"))))
    return ranked.groupBy("dataset").agg(
        F.max(F.when(first, F.col("task_type"))).alias("task_type"),
        F.max(F.when(first, F.col("model"))).alias("primary_model"),
        F.max(F.when(first, F.round(F.col("score") / 10, 2))).alias("confidence"),
        F.max(F.when(first, F.col("why"))).alias("why_this_model"),
        F.max(F.when(first, F.col("reasons"))).alias("reasoning"),
        F.transform(others, lambda s: F.struct(s["model"].alias("model"), s["why"].alias("why"))).alias("alternatives"),
    )


def preprocessing_steps(traits: DataFrame) -> DataFrame:
    """RC5: ordered advice; the split always comes last."""
    c = F.col
    steps = F.array_compact(F.array(
        F.when(c("has_missing"), "Impute: median for numbers, most frequent value for categories."),
        F.when(c("has_outliers"), "Winsorise at the 1st and 99th percentile."),
        F.when(c("has_skewed"), "Log-transform strongly skewed numbers."),
        F.when(c("has_categoricals"), "Encode categories: one-hot below 10 values, target encoding above."),
        F.when(c("has_multicollinearity"), "Drop one column of each collinear pair, or use PCA."),
        F.when(~c("is_large"), "Scale numeric features."),
        F.lit("Split 80% / 20% before fitting anything."),
    ))
    return traits.select("dataset", steps.alias("preprocessing_steps"))


def cv_strategy(traits: DataFrame, structure: DataFrame) -> DataFrame:
    """RC6: walk-forward for time series, stratified when imbalanced, leave-one-out when small, else 5-fold."""
    name = (
        F.when(F.col("type") == "time-series", "Time Series Split (Walk-Forward Validation)")
        .when(F.col("has_imbalance"), "Stratified 5-Fold Cross-Validation")
        .when(F.col("is_small"), "Leave-One-Out Cross-Validation (LOOCV) or Stratified 10-Fold")
        .otherwise("5-Fold Cross-Validation")
    )
    return traits.join(structure.select("dataset", "type"), "dataset", "left").select("dataset", name.alias("cv_strategy"))


def metrics(traits: DataFrame, tasks: DataFrame) -> DataFrame:
    """RC7: what to measure."""
    def names(*xs):
        return F.array(*[F.lit(x) for x in xs])

    chosen = (
        F.when(F.col("task_type") == "regression", names("RMSE", "MAE", "R²"))
        .when(F.col("has_imbalance"), names("F1-Score", "AUC-ROC", "Precision-Recall AUC", "not Accuracy"))
        .otherwise(names("Accuracy", "F1-Score", "AUC-ROC"))
    )
    return traits.join(tasks, "dataset").select("dataset", chosen.alias("recommended_metrics"))


def recommend(traits, tasks, structure) -> DataFrame:
    """The whole recommendation, one row per dataset."""
    return (
        pick_model(model_scores(traits, tasks)).join(preprocessing_steps(traits), "dataset")
        .join(cv_strategy(traits, structure), "dataset").join(metrics(traits, tasks), "dataset")
    )
