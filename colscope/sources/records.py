"""Records of CSV files with quoted line breaks, read in parallel inside each file.

A line begins a record when an even number of quotes stands before it. Quotes are counted per split first; a running exclusive-or over
the splits of a file gives the state in which each split begins, so every task can cut the records of its split by
itself. What remains are the records that cross a split border: the open tail of one split, whole splits inside a cell, and the
head of another. Only these fragments are shuffled and joined.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Kinds of pieces that leave a split: a whole record; the end of a record begun earlier; the begin of one that goes on; nothing but the middle of one.
WHOLE, HEAD, TAIL, MIDDLE = 0, 1, 2, 3
_PIECES = pa.schema([("file", pa.string()), ("block", pa.int64()), ("place", pa.int64()), ("kind", pa.int32()), ("text", pa.string())])
_PIECES_DDL = "file string, block long, place long, kind int, text string"


def lines_of(spark: SparkSession, files, charset: str) -> DataFrame:
    """(file, block, value) in the order of the files; a line ends at a line feed."""
    # the text source hands on the bytes of a line as they are
    value = F.col("value") if charset == "UTF-8" else F.decode(F.col("value").cast("binary"), charset)
    return spark.read.option("lineSep", "\n").text(files).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), value.alias("value"))


def split_states(lines: DataFrame, quote: str) -> DataFrame:
    """(file, block, open): whether the split begins inside a quoted cell. One row per split."""
    quotes = F.length("value") - F.length(F.replace(F.col("value"), F.lit(quote), F.lit("")))
    each = lines.groupBy("file", "block").agg(F.bit_xor((quotes % 2).cast("int")).alias("odd"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return each.select("file", "block", (F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2 == 1).alias("open"))


def _cut(quote: str):
    """Lines of splits, one split after the other, to pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, parts, inside, begun, place = None, [], False, False, 0
        out: list[tuple] = []

        def close():
            """The end of a split leaves its unfinished record behind."""
            if split is not None and parts:
                out.append((*split, place, TAIL if begun else MIDDLE, "\n".join(parts)))

        for b in batches:
            odd = pc.bit_wise_and(pc.count_substring(b.column("value"), quote), 1).to_pylist()
            rows = zip(b.column("file").to_pylist(), b.column("block").to_pylist(), b.column("open").to_pylist(), b.column("value").to_pylist(), odd)
            for file, block, opened, value, flips in rows:
                if (file, block) != split:
                    close()
                    # a split that begins inside a cell goes on with a record of an earlier one
                    split, parts, inside, begun, place = (file, block), [], opened, not opened, 0
                parts.append(value)
                if flips:
                    inside = not inside
                if not inside:
                    out.append((*split, place, WHOLE if begun else HEAD, "\n".join(parts)))
                    parts, begun, place = [], True, place + 1
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out) if out else [[]] * 5, _PIECES)], schema=_PIECES)
            out = []
        close()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _PIECES)], schema=_PIECES)

    return run


def records_of(spark: SparkSession, files, charset: str = "UTF-8", quote: str = '"') -> DataFrame:
    """(file, block, place, text): every record of the files, line feeds inside cells kept, carriage returns before them dropped.

    A quote that is never closed makes one record of all that follows, as for any reader.
    """
    lines = lines_of(spark, files, charset).withColumn("value", F.regexp_replace("value", "\r$", ""))
    # a row per split: a few thousand for a terabyte
    states = split_states(lines, quote)
    pieces = lines.join(F.broadcast(states), ["file", "block"]).select("file", "block", "value", "open").mapInArrow(_cut(quote), _PIECES_DDL)
    whole = pieces.where(F.col("kind") == WHOLE).select("file", "block", "place", "text")
    # fragments of records that cross a border: at most two per split
    order = Window.partitionBy("file").orderBy("block", "place")
    parts = pieces.where(F.col("kind") != WHOLE).withColumn("owner", F.sum(F.when(F.col("kind") == TAIL, 1).otherwise(0)).over(order))
    joined = parts.groupBy("file", "owner").agg(
        F.min(F.struct("block", "place")).alias("at"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "place", "text"))), lambda x: x["text"]), "\n").alias("text"))
    return whole.unionByName(joined.select("file", "at.block", "at.place", "text")).where("text != ''")


def parsed(records: DataFrame, names: list[str], delimiter: str = ",", schema: T.StructType | None = None) -> DataFrame:
    """The records' cells, without each file's header, in the schema given or as texts."""
    first = (F.col("block") == 0) & (F.col("place") == 0)
    schema = schema or T.StructType([T.StructField(n, T.StringType()) for n in names])
    row = F.from_csv("text", _ddl(schema), {"sep": delimiter, "quote": '"', "escape": '"', "mode": "PERMISSIVE"})
    return records.where(~first).select(row.alias("row")).select("row.*")


def _ddl(schema: T.StructType) -> str:
    return ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in schema)


#: Types tried in order for a column of texts, and what a cell must look like.
KINDS = (
    ("int", lambda c: c.try_cast("int").isNotNull() & c.rlike(r"^\s*[+-]?\d+\s*$")),
    ("bigint", lambda c: c.try_cast("bigint").isNotNull() & c.rlike(r"^\s*[+-]?\d+\s*$")),
    ("double", lambda c: c.try_cast("double").isNotNull() & c.rlike(r"^\s*[+-]?(\d|\.\d|NaN|Inf)")),
    ("timestamp_ntz", lambda c: c.try_cast("timestamp_ntz").isNotNull() & c.rlike(r"^\d{4}-\d{2}-\d{2}")),
    ("boolean", lambda c: F.lower(c).isin("true", "false")),
)


TYPES = {"int": T.IntegerType(), "bigint": T.LongType(), "double": T.DoubleType(), "timestamp_ntz": T.TimestampNTZType(), "boolean": T.BooleanType(),
         "string": T.StringType()}


def inferred(texts: DataFrame) -> T.StructType:
    """The narrowest type of KINDS that all cells of a column fit, else text; one aggregation over (column, cell)."""
    wide = texts.toDF(*[str(i) for i in range(len(texts.columns))])
    cell = F.col("v")
    fits = wide.unpivot([], wide.columns, "o", "v").where("v is not null").groupBy("o").agg(
        *[F.bool_and(F.coalesce(test(cell), F.lit(False))).alias(kind) for kind, test in KINDS]).collect()
    found = {int(r["o"]): next((k for k, _ in KINDS if r[k]), "string") for r in fits}
    return T.StructType([T.StructField(n, TYPES[found.get(i, "string")]) for i, n in enumerate(texts.columns)])


def header_names(spark: SparkSession, file: str, charset: str, delimiter: str = ",") -> list[str]:
    """Column names as the reader takes them from the first record of a file."""
    return spark.read.option("header", True).option("sep", delimiter).option("encoding", charset).option("escape", '"').csv(file).columns


def quoted_csv(spark: SparkSession, files: list[str], charset: str = "UTF-8", schema: T.StructType | None = None, delimiter: str = ",") -> DataFrame:
    """CSV files with a header and quoted line breaks, each read by as many tasks as it has splits."""
    names = schema.names if schema is not None else header_names(spark, files[0], charset, delimiter)
    records = records_of(spark, files, charset)
    return parsed(records, names, delimiter, schema or inferred(parsed(records, names, delimiter)))


def has_bare_returns(line: Column) -> Column:
    """A carriage return that ends no line: such files are left to the whole-file reader."""
    return F.regexp_replace(line, "\r$", "").contains("\r")
