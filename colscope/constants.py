"""Word lists, thresholds, weights and labels that results must agree on."""

# --- fixed values: text that stands for a missing value (compared stripped and lower-cased)
DISGUISED_MISSING = (
    "", "na", "n/a", "null", "none", "nan", "missing", "?", "-", "--",
    "undefined", "not available", "not applicable", "#n/a", "#ref!", "#value!",
)

# --- fixed values: name fragments of identifier columns
ID_KEYWORDS = ("id", "key", "code", "uuid", "guid")

# --- fixed values: name fragments of likely target columns
TARGET_KEYWORDS = (
    "target", "label", "class", "output", "result", "outcome", "churn", "fraud", "default",
    "price", "sales", "revenue", "score", "rating", "y", "surviv", "diagnosis", "status",
    "approved", "accept", "reject", "spam", "sentiment", "category", "species", "quality",
    "risk", "severity", "grade", "pass", "fail", "positive", "negative", "attrition",
    "readmit", "clicked", "purchased", "converted",
)

# --- fixed values: name fragments that hint at information from after the event
LEAKAGE_KEYWORDS = (
    "result", "outcome", "final", "actual", "true_", "real_", "batch", "plate_", "_plate",
    "machine_id", "machine_no", "machine_num", "instrument_id", "instrument_no",
    "operator_id", "operator_no", "run_no", "run_num", "run_id", "job_id", "job_no", "job_num",
    "session_id", "experiment_id", "experiment_no", "pipeline_id", "etl_",
    "load_dt", "ingest_dt", "extract_dt",
)

# --- fixed values: numbers used as placeholders, and the share (percent) that makes them suspicious
NUMERIC_SENTINELS = (-9999.0, -999.0, -99.0, -9.0, -1.0, 9.0, 99.0, 999.0, 9999.0)
SENTINEL_MIN_PCT = 0.5

# --- fixed values: thresholds of the statistical checks
EXTREME_SKEW = 50
SAMPLE_MAX_ROWS = 50_000
TOP_PAIRS = 20

# --- fixed values: hex heads of non-text files
BINARY_HEADS = ("89504E47", "FFD8FF", "504B0304", "25504446", "0000", "7F454C46", "D0CF11")

# --- fixed values: characters that start a spreadsheet formula
FORMULA_STARTS = ("=", "+", "-", "@", "|")

# --- fixed values: weight of a finding type and multiplier of its severity
TYPE_WEIGHTS = (
    ("class_imbalance", 10), ("data_leakage_risk", 10), ("simpsons_paradox", 9),
    ("high_missingness", 8), ("metadata_leakage", 8), ("constant_column", 7),
    ("multicollinearity", 6), ("high_correlation", 5), ("high_outliers", 5), ("mixed_types", 5),
    ("near_zero_variance", 4), ("heteroscedasticity", 4), ("moderate_missingness", 3),
    ("high_cardinality", 3), ("disguised_missing", 3), ("infinite_values", 3),
    ("duplicate_rows", 2), ("whitespace_issues", 1),
)
SEVERITY_WEIGHTS = (("critical", 3), ("high", 2), ("medium", 1))

# --- fixed values: finding types by how they relate to a model family
LINEAR_ONLY_TYPES = ("multicollinearity", "heteroscedasticity")
CONTEXTUAL_TYPES = (
    "high_correlation", "high_outliers", "near_zero_variance", "extreme_skewness",
    "high_missingness", "moderate_missingness",
)
UNIVERSAL_TYPES = (
    "class_imbalance", "data_leakage_risk", "metadata_leakage", "simpsons_paradox",
    "constant_column", "mixed_types", "disguised_missing", "infinite_values",
    "numeric_sentinel_values",
)

# --- fixed values: model families by name fragment, tried in this order
MODEL_FAMILIES = (
    ("tree", ("random forest", "xgboost", "lightgbm", "gradient boost", "decision tree", "catboost")),
    ("linear", ("logistic", "ridge", "lasso", "linear", "elastic")),
    ("svm", ("svm", "support vector")),
    ("knn", ("knn", "k-nearest", "nearest neighbor")),
    ("neural", ("neural", "deep learning", "mlp")),
)

# --- fixed values: models per task with the capability flags
# (native missing, imbalance, outliers, categoricals, good on small, good on large, explainable)
MODELS = (
    ("classification", 1, "Random Forest", (0, 0, 1, 0, 1, 1, 1)),
    ("classification", 2, "XGBoost", (1, 1, 1, 0, 0, 1, 1)),
    ("classification", 3, "Logistic Regression", (0, 1, 0, 0, 1, 1, 1)),
    ("classification", 4, "LightGBM", (1, 1, 1, 1, 0, 1, 1)),
    ("classification", 5, "Support Vector Machine", (0, 1, 0, 0, 1, 0, 0)),
    ("regression", 1, "Random Forest Regressor", (0, 0, 1, 0, 1, 1, 1)),
    ("regression", 2, "XGBoost Regressor", (1, 0, 1, 0, 0, 1, 1)),
    ("regression", 3, "Ridge Regression", (0, 0, 0, 0, 1, 1, 1)),
    ("regression", 4, "LightGBM Regressor", (1, 0, 1, 1, 0, 1, 1)),
    ("regression", 5, "Lasso Regression", (0, 0, 0, 0, 1, 1, 1)),
)

# --- fixed values: labels of correlation strength, from strong to weak
STRENGTH_LABELS = ((0.9, "very strong"), (0.7, "strong"), (0.5, "moderate"), (0.3, "weak"))

# --- fixed values: progress reported after each step of an analysis job
JOB_STEPS = (
    (1, "validate", 5), (2, "load", 10), (3, "structure", 30), (4, "statistics", 55),
    (5, "recommend", 75), (6, "insights", 90), (7, "save", 98), (8, "done", 100),
)

# --- fixed values: request limiter tiers (limit, window in seconds) and path rules
GLOBAL_TIER = (200, 60)
STRICT_TIER = (10, 60)
STRICT_PATHS = ("/api/analyze",)
EXEMPT_PATHS = ("/health",)
EXEMPT_PREFIXES = ("/api/status/",)
