"""Result schemas, and the one shape every finding has."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colscope.functions.session import local_table

PAIR = "struct<var1:string,var2:string,correlation:double>"

# Declared finding columns. `seq` carries the list order: block * 10^12 + major * 10^5 + minor.
FINDING = (
    ("dataset", "string"), ("seq", "bigint"), ("type", "string"), ("severity", "string"),
    ("column", "string"), ("columns", "array<string>"), ("var1", "string"), ("var2", "string"),
    ("correlation", "double"), ("percentage", "double"), ("majority_pct", "double"),
    ("skewness", "double"), ("count", "bigint"), ("unique_count", "bigint"),
    ("sentinel_values", "array<double>"), ("pairs", f"array<{PAIR}>"), ("aggregated", "boolean"),
    ("message", "string"), ("plain_english", "string"), ("recommendation", "string"), ("source", "string"),
)
FINDING_DDL = ", ".join(f"`{n}` {t}" for n, t in FINDING)

COLUMN_PROFILE_DDL = (
    "dataset string, ordinal int, name string, dtype string, kind string, missing_count bigint, missing_pct double,"
    " unique_count bigint, unique_pct double, sample_values array<string>, mean double, std double, min double,"
    " max double, median double, q25 double, q75 double, skewness double, kurtosis double, zeros_pct double,"
    " negative_pct double, inf_count bigint, top_values array<struct<value:string,count:bigint>>, avg_length double,"
    " whitespace_issues bigint, disguised_missing bigint"
)

# Why a finding matters and what to do, in our own words. {c} is replaced by the column name.
ADVICE = {
    "high_missingness": ("More than half of the cells are empty, so little is known about this column.",
                         "Drop the column unless domain knowledge says its gaps carry meaning."),
    "moderate_missingness": ("A notable share of the cells is empty.",
                             "Fill gaps with the median or the most frequent value, or use a model that accepts gaps."),
    "constant_column": ("Every row holds the same value.", "Drop the column; nothing can be learned from it."),
    "numeric_sentinel_values": ("Some numbers look like codes for 'not recorded' rather than measurements.",
                                "Set these values to null, then decide how to fill them."),
    "high_cardinality": ("Almost every row has its own text.", "Drop the column, or encode it before modelling."),
    "mixed_types": ("Numbers and words share one column.", "Separate the words from the numbers, then convert."),
    "disguised_missing": ("Placeholder text hides missing values.", "Turn the placeholders into nulls."),
    "whitespace_issues": ("Padding makes equal values look different.", "Strip leading and trailing whitespace."),
    "duplicate_rows": ("Identical rows are counted more than once.", "Remove the surplus copies before training."),
    "infinite_values": ("Infinite numbers break most estimators.", "Set infinities to null, then fill or drop them."),
    "class_imbalance": ("Always guessing the largest class would already look accurate.",
                        "Weight or resample the classes, and judge by F1 or AUC instead of accuracy."),
    "simpsons_paradox": ("The overall trend and the trend inside the groups point in opposite directions.",
                         "Analyse each group on its own, or keep the grouping column as a feature."),
    "data_leakage_risk": ("The name suggests something that is known only after the event.",
                          "Check when the column is recorded; remove it if that is after the event."),
    "metadata_leakage": ("Its values stem from the bookkeeping around each record; the thing under study plays no part in them.",
                         "Leave it out of the training features; joins and audits may still need it."),
    "multicollinearity": ("The two columns say the same thing twice.", "Keep the one that is easier to explain."),
    "high_correlation": ("The two columns largely move together.", "Combine them, or keep one for linear models."),
    "high_outliers": ("Extreme values pull averages and fitted lines towards them.",
                      "Cap at the 1st and 99th percentile, or use a tree-based model."),
    "heteroscedasticity": ("Errors grow or shrink along the first column, which linear regression assumes away.",
                           "Transform the response, or use a tree-based model."),
    "near_zero_variance": ("The values hardly differ from each other.", "Consider dropping the column."),
    "extreme_skewness": ("A few values are far beyond anything a natural distribution produces.",
                         "Look for placeholder values or faulty readings before transforming."),
}


def seq(block: int, major=0, minor=0) -> Column:
    """Sort key that reproduces list order across unions."""
    def num(x):
        return x.cast("bigint") if isinstance(x, Column) else F.lit(x).cast("bigint")

    return F.lit(block * 10**12).cast("bigint") + num(major) * 100_000 + num(minor)


def seq_of_three(block: int, a: str, b: str, c: str) -> Column:
    """The same for three column positions, each below 10,000."""
    at = F.lit(0).cast("bigint")
    for name in (a, b, c):
        at = at * 10_000 + F.col(name).cast("bigint")
    return F.lit(block * 10**12).cast("bigint") + at


def advice(type_: Column, index: int) -> Column:
    """Fixed text by finding type, as one map lookup."""
    return F.create_map(*[F.lit(x) for t, pair in ADVICE.items() for x in (t, pair[index])])[type_]


def as_finding(df: DataFrame, **values) -> DataFrame:
    """Project to the finding shape; what is not given is null."""
    if isinstance(values["type"], str):
        why, todo = ADVICE[values["type"]]
        values = {"plain_english": why, "recommendation": todo} | values
    given = {k: v if isinstance(v, Column) else F.lit(v) for k, v in values.items()}
    given.setdefault("dataset", F.col("dataset"))
    given.setdefault("aggregated", F.lit(False))
    given.setdefault("plain_english", advice(given["type"], 0))
    given.setdefault("recommendation", advice(given["type"], 1))
    return df.select(*[given.get(n, F.lit(None)).cast(t).alias(n) for n, t in FINDING])


def empty_findings(df: DataFrame) -> DataFrame:
    return local_table(df.sparkSession, [], FINDING_DDL)


def union_all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
