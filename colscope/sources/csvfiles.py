"""CSV in, dataset facts, and JSON or Parquet out (IN1, IN2, IN9-IN11)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colscope.functions.numeric import INF
from colscope.sources.records import has_bare_returns, quoted_csv

#: How files with quoted line breaks are read; True and False are the reader's own multiLine.
RECORDS = "records"
SPARK_CHARSETS = {"utf-8": "UTF-8", "utf-8-sig": "UTF-8", "utf-16": "UTF-16", "latin-1": "ISO-8859-1"}
#: How a column's types in several groups of files are joined; anything else becomes text.
WIDER = (T.IntegerType(), T.LongType(), T.DoubleType())


def text_layout(spark: SparkSession, path) -> DataFrame:
    """file, encoding, open_quotes and bare_returns of each text file: files of any size are split as usual, lines are judged where they lie.

    UTF-16 is told by the mark at a file's first byte, latin-1 by bytes that are not UTF-8. open_quotes: whether
    a line leaves a quoted cell open. bare_returns: whether a carriage return stands elsewhere than before a line feed.
    """
    line = spark.read.option("lineSep", "\n").text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                                        F.monotonically_increasing_id().alias("at"))
    quotes = F.length("value") - F.length(F.replace(F.col("value"), F.lit('"'), F.lit("")))
    seen = line.groupBy("file").agg(
        F.min_by(F.hex(F.substring(F.col("value").cast("binary"), 1, 2)), F.struct("block", "at")).alias("start"),
        F.bool_and(F.is_valid_utf8("value")).alias("utf8"), F.bool_or(quotes % 2 == 1).alias("open_quotes"),
        F.bool_or(has_bare_returns(F.col("value"))).alias("bare_returns"))
    encoding = F.when(F.col("start").isin("FFFE", "FEFF"), "utf-16").when(F.col("utf8"), "utf-8").otherwise("latin-1")
    return seen.select("file", encoding.alias("encoding"), "open_quotes", "bare_returns")


def _wider(a: T.DataType, b: T.DataType) -> T.DataType:
    if a == b:
        return a
    return WIDER[max(WIDER.index(a), WIDER.index(b))] if a in WIDER and b in WIDER else T.StringType()


def csv_load(spark: SparkSession, path, encoding: str | None = None, schema=None, delimiter: str = ",",
             multi_line: bool | None = None) -> DataFrame:
    """IN1: CSV files with a header. Each file is read in its own encoding: UTF-8, UTF-16 with a mark, else latin-1.

    Files with quoted line breaks are cut into records inside their splits; UTF-16 files, and quoted ones with bare carriage
    returns, are read by one task each; all others are split as usual. Files are grouped by what
    they need, so there is one read per kind of file; types are inferred per group and joined. Giving encoding and
    multi_line saves the pass that looks at the files.
    """
    if encoding is not None and multi_line is not None:
        groups = {(encoding, multi_line): path}
    else:
        groups = {}
        for r in text_layout(spark, path).collect():  # a row per file
            kind = encoding or r["encoding"]
            whole = (r["open_quotes"] or kind == "utf-16") if multi_line is None else multi_line
            if whole and kind != "utf-16" and not r["bare_returns"]:
                whole = RECORDS
            groups.setdefault((kind, whole), []).append(r["file"])
        groups = groups or {("utf-8", False): path}

    def reader(kind: str, whole: bool):
        if whole == RECORDS:
            return None
        return spark.read.option("header", True).option("quote", '"').option("escape", '"').option("sep", delimiter).option(
            "encoding", SPARK_CHARSETS.get(kind, kind)).option("multiLine", whole)

    if schema is None:
        found = [quoted_csv(spark, files, SPARK_CHARSETS.get(kind[0], kind[0]), None, delimiter).schema if kind[1] == RECORDS
                 else reader(*kind).option("inferSchema", True).csv(files).schema for kind, files in groups.items()]
        types = {f.name: f.dataType for f in found[0].fields}
        for other in found[1:]:
            types |= {f.name: _wider(types.get(f.name, f.dataType), f.dataType) for f in other.fields}
        schema = T.StructType([T.StructField(n, t) for n, t in types.items()])
    out = None
    for kind, files in groups.items():
        part = quoted_csv(spark, files, SPARK_CHARSETS.get(kind[0], kind[0]), schema, delimiter) if kind[1] == RECORDS else reader(*kind).schema(schema).csv(files)
        out = part if out is None else out.unionByName(part)
    return out


def empty_guard(df: DataFrame, dataset: str = "") -> DataFrame:
    """IN2: whether the dataset has no row; reads at most one row."""
    return df.limit(1).agg((F.count(F.lit(1)) == 0).alias("is_empty")).select(F.lit(dataset).alias("dataset"), "is_empty")


def dataset_info(df: DataFrame, dataset: str = "") -> DataFrame:
    """IN9: rows, columns and column names."""
    return df.agg(F.count(F.lit(1)).alias("rows")).select(
        F.lit(dataset).alias("dataset"), "rows", F.lit(len(df.columns)).alias("columns"),
        F.array(*[F.lit(c) for c in df.columns]).cast("array<string>").alias("column_names"))


def size_mb(df: DataFrame, dataset: str = "") -> DataFrame:
    """IN9: size of the files behind a file-based table, three digits."""
    files = df.select("_metadata.file_path", "_metadata.file_size").groupBy("file_path").agg(F.max("file_size").alias("b"))
    return files.agg(F.round(F.sum("b") / 1024 / 1024, 3).alias("size_mb")).select(F.lit(dataset).alias("dataset"), "size_mb")


def sanitized(c: Column, t: T.DataType) -> Column:
    """IN10: NaN and infinities become null, at any depth of structs, arrays and map values."""
    if isinstance(t, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(c) & (F.abs(c) < F.lit(INF)), c)
    if isinstance(t, T.StructType):
        return F.when(c.isNotNull(), F.struct(*[sanitized(c[f.name], f.dataType).alias(f.name) for f in t.fields]))
    if isinstance(t, T.ArrayType):
        return F.transform(c, lambda x: sanitized(x, t.elementType))
    if isinstance(t, T.MapType):
        return F.transform_values(c, lambda _, v: sanitized(v, t.valueType))
    return c


def json_sanitize(df: DataFrame) -> DataFrame:
    """IN10 for every column of a table."""
    return df.select(*[sanitized(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields])


def as_json(df: DataFrame, name: str = "document") -> DataFrame:
    clean = json_sanitize(df)
    return clean.select(*clean.columns, F.to_json(F.struct(*[F.col(f"`{c}`") for c in clean.columns])).alias(name))


def result_sink(documents: dict[str, DataFrame], folder: str, fmt: str = "parquet", mode: str = "overwrite") -> dict[str, str]:
    """IN11: write the result documents, partitioned by dataset; returns the folder of each.

    Overwriting replaces the datasets that a document holds and leaves the files of all others as they are.
    """
    paths = {}
    for name, df in documents.items():
        paths[name] = f"{folder.rstrip('/')}/{name}"
        json_sanitize(df).write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("dataset").format(fmt).save(paths[name])
    return paths


