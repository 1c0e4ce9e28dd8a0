"""Checks on uploaded files (IN3-IN7, IN12): one row per file, read with the binaryFile source.

The checks look at whole files; judging by the first bytes only is available through `head_bytes`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colscope.functions.session import local_table
from colscope import constants as K
from colscope.functions import text as X
from colscope.operators.longform import columns_of, long_text, ordinal_of, schema_table

DELIMITERS = (",", ";", "\t", "|")
MAX_MB = 200
MAX_COLUMNS = 2000


def read_uploads(spark: SparkSession, folder: str) -> DataFrame:
    """path, length and content of every file under a folder."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select(
        "path", "length", "content")


def _head(content: Column, head_bytes: int | None) -> Column:
    return content if head_bytes is None else F.substring(content, 1, head_bytes)


def triage_error(max_mb: int = MAX_MB) -> Column:
    """IN3: first failed check of size and extension, null when both pass."""
    return F.when(F.col("length") > max_mb * 1024 * 1024, "too_large").when(
        ~F.lower("path").endswith(".csv"), "not_csv")


def file_triage(files: DataFrame, max_mb: int = MAX_MB) -> DataFrame:
    error = triage_error(max_mb)
    return files.select("path", error.isNull().alias("valid"), error.alias("error"))


def is_binary(content: Column, head_bytes: int | None = None) -> Column:
    """IN4: a known non-text signature, or more than 5% NUL bytes."""
    start = F.hex(F.substring(content, 1, 4))
    signed = F.lit(False)
    for head in K.BINARY_HEADS:
        signed = signed | start.startswith(head)
    # one character per byte, so NULs are counted without alignment trouble
    text = F.decode(_head(content, head_bytes), "ISO-8859-1")
    nuls = F.length(text) - F.length(F.replace(text, F.lit("\0"), F.lit("")))
    return signed | F.coalesce(nuls / F.nullif(F.length(text), F.lit(0)) > 0.05, F.lit(False))


def binary_detect(files: DataFrame, head_bytes: int | None = None) -> DataFrame:
    return files.select("path", is_binary(F.col("content"), head_bytes).alias("is_binary"))


def encoding_of(content: Column, head_bytes: int | None = None) -> Column:
    """IN5: by byte-order mark, else utf-8 when the bytes are valid, else latin-1."""
    start = F.hex(F.substring(content, 1, 3))
    return (
        F.when(start == "EFBBBF", "utf-8-sig")
        .when(start.startswith("FFFE") | start.startswith("FEFF"), "utf-16")
        .when(F.is_valid_utf8(_head(content, head_bytes).cast("string")), "utf-8")
        .otherwise("latin-1")
    )


def encoding_detect(files: DataFrame, head_bytes: int | None = None) -> DataFrame:
    return files.select("path", encoding_of(F.col("content"), head_bytes).alias("encoding"))


def decoded(content: Column) -> Column:
    """The content as text in its detected encoding."""
    enc = encoding_of(content)
    return (
        F.when(enc == "utf-8-sig", F.decode(F.substring(content, 4, 2147483647), "UTF-8"))
        .when(enc == "utf-16", F.decode(content, "UTF-16"))
        .when(enc == "utf-8", F.decode(content, "UTF-8"))
        .otherwise(F.decode(content, "ISO-8859-1"))
    )


def header_check(files: DataFrame, max_columns: int = MAX_COLUMNS, sniff_lines: int | None = None) -> DataFrame:
    """IN6: delimiter, header width and the first problem found: no header, too wide, no data row.

    The delimiter is the first candidate that occurs in the header and equally often in the
    lines below it (all of them, or the first `sniff_lines`); the comma is the fallback.
    """
    lines = F.split(F.regexp_replace(decoded(F.col("content")), "\r\n?", "\n"), "\n")
    x = files.select("path", lines.alias("lines")).select(
        "path", F.col("lines")[0].alias("header"),
        F.filter(F.slice("lines", F.lit(2), F.size("lines")), lambda v: v != "").alias("rows"))

    def occurs(line, d):
        return F.length(line) - F.length(F.replace(line, F.lit(d), F.lit("")))

    def fits(d):
        n = occurs(F.col("header"), d)
        return (n > 0) & F.forall(F.col("rows") if sniff_lines is None else F.slice("rows", 1, sniff_lines), lambda v: occurs(v, d) == n)

    delimiter = F
    for d in DELIMITERS:
        delimiter = delimiter.when(fits(d), d)
    x = x.withColumn("delimiter", delimiter.otherwise(","))
    blank = X.strip(F.replace("header", "delimiter", F.lit(""))) == ""
    x = x.withColumn("n_columns", F.length("header") - F.length(F.replace("header", "delimiter", F.lit(""))) + 1)
    error = (F.when(blank, "no_header").when(F.col("n_columns") > max_columns, "too_many_columns")
             .when(F.size("rows") == 0, "no_data_rows"))
    return x.select("path", "delimiter", "n_columns", error.isNull().alias("valid"), error.alias("error"))


def validate_uploads(files: DataFrame, max_mb: int = MAX_MB, max_columns: int = MAX_COLUMNS) -> DataFrame:
    """All file checks in order; the first failure is the verdict."""
    checks = files.select("path", triage_error(max_mb).alias("triage"),
                          F.when(is_binary(F.col("content")), "binary").alias("binary"),
                          encoding_of(F.col("content")).alias("encoding"), "content")
    header = header_check(checks.where("triage is null and binary is null").select("path", "content"), max_columns)
    out = checks.drop("content").join(header.select("path", "delimiter", F.col("error").alias("header")), "path", "left")
    error = F.coalesce("triage", "binary", "header")
    return out.select("path", error.isNull().alias("valid"), error.alias("error"), "encoding", "delimiter")


def formula_injection(df: DataFrame, dataset: str = "", columns=None) -> DataFrame:
    """IN7: cells per text column that start like a spreadsheet formula; every row is looked at."""
    cols = [c for c in columns_of(df, columns) if c.family == "text"]
    if not cols:
        return local_table(df.sparkSession, [], "dataset string, ordinal int, name string, formula_cells bigint")
    hits = long_text(df, cols).groupBy("o").agg(F.count_if(X.starts_like_formula(F.col("v"))).alias("formula_cells")).select(
        ordinal_of(F.col("o")).alias("ordinal"), "formula_cells")
    return schema_table(df, dataset, [c.name for c in cols]).join(F.broadcast(hits), "ordinal", "left").select(
        "dataset", "ordinal", "name", F.coalesce("formula_cells", F.lit(0)).alias("formula_cells"))


def safe_name(df: DataFrame, column: str) -> DataFrame:
    """IN12: file stem that is safe in a response header."""
    return df.withColumn("safe_name", X.safe_name(F.col(column)))
