"""Which columns are missing together (CH11): patterns of gaps and counts of pairs, from one scan.

A row's gaps are packed into words of 64 bits, one bit for each column, so 2,000 columns make a group key of 250 bytes. Rows with
equal gaps collapse before anything is shuffled; everything else works on patterns, of which most tables have few.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colscope.functions import numeric as N
from colscope.functions.session import local_table
from colscope.operators.longform import ColumnInfo, by_position, columns_of, pos

WORD = 64
#: Patterns that are unpacked at a time; their matrix has a cell for each pattern and column.
CELLS = 1 << 21
PAIR_DDL = "i int, j int, both bigint"
_ROWS = pa.schema([("i", pa.int32()), ("counts", pa.binary())])
_PAIRS = pa.schema([("i", pa.int32()), ("j", pa.int32()), ("both", pa.int64())])


def _word(cols: list[ColumnInfo], first: int) -> str:
    """The bits of some columns as SQL (2,000 columns would be slow to put together one by one); halves are joined, so a word is six deep."""
    if len(cols) > 1:
        half = len(cols) // 2
        return f"({_word(cols[:half], first)} | {_word(cols[half:], first + half)})"
    name = f"`{cols[0].ordinal}`"
    gone = f"{name} is null" + (f" or isnan({name})" if cols[0].family == "float" else "")
    return f"if({gone}, shiftleft(1L, {first}), 0L)"


def _listed(values: list, kind: str) -> Column:
    return F.from_json(F.lit(json.dumps(values)), f"array<{kind}>")


def gap_patterns(df: DataFrame, columns=None) -> DataFrame:
    """(words array<bigint>, rows): rows per set of missing columns; bit b of word w stands for the (64 w + b)-th column.

    An empty table has no patterns; a table without columns has one, of no words.
    """
    cols = columns_of(df, columns)
    words = [F.expr(_word(cols[a:a + WORD], 0)).alias(f"w{a // WORD}") for a in range(0, len(cols), WORD)]
    names = [f"w{k}" for k in range(len(words))]
    counted = by_position(df).select(*words).groupBy(*names).agg(F.count(F.lit(1)).alias("rows"))
    packed = F.array(*names) if names else F.array().cast("array<bigint>")
    return counted.where("rows > 0").select(packed.alias("words"), "rows")


def co_missing(df: DataFrame, dataset: str = "", columns=None) -> DataFrame:
    """CH11: rows per set of columns that are missing together; names, in table order, are put in after counting."""
    cols = columns_of(df, columns)
    names = _listed([c.name for c in cols], "string")
    here = F.filter(names, lambda name, k: F.getbit(F.col("words")[(k / WORD).cast("int")], k % WORD) == 1)
    return gap_patterns(df, columns).select(F.lit(dataset).alias("dataset"), F.array_join(here, "+").alias("missing_together"), "rows")


def _products(p: int):
    """A task's patterns as a 0/1 matrix, times itself weighted by rows; one binary row of counts for each column with gaps."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            step = max(64, CELLS // p)
            for start in range(0, batch.num_rows, step):
                part = batch.slice(start, step)
                words = part.column(0).flatten().to_numpy(zero_copy_only=False).astype("<i8").reshape(part.num_rows, -1)
                gaps = np.unpackbits(words.view(np.uint8), axis=1, bitorder="little")[:, :p].astype("float64")
                rows = part.column(1).to_numpy(zero_copy_only=False).astype("float64")
                product = (gaps * rows[:, None]).T @ gaps
                # whole numbers under 2**53 are exact in a product; its sums over batches are kept as integers
                total = product.astype("int64") if total is None else total + product.astype("int64")
        if total is not None:
            at = np.flatnonzero(np.diagonal(total))
            for i in at:
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([total[i].astype("<i8").tobytes()], pa.binary())], schema=_ROWS)

    return run


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one column follow each other and are added; a task holds one row of counts, however many tasks sent some."""
    def pairs(i: int, counts: np.ndarray) -> pa.RecordBatch:
        later = np.flatnonzero(counts)
        later = later[later >= i]
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(later), i, "int32")), pa.array(later.astype("int32")), pa.array(counts[later])], schema=_PAIRS)

    current, total = None, None
    for batch in batches:
        for i, counts in zip(batch.column(0).to_pylist(), batch.column(1)):
            counts = np.frombuffer(counts.as_py(), "<i8").astype("int64")
            if i == current:
                total = total + counts
                continue
            if current is not None:
                yield pairs(current, total)
            current, total = i, counts
    if current is not None:
        yield pairs(current, total)


def co_missing_pairs(df: DataFrame, dataset: str = "", columns=None) -> DataFrame:
    """CH11: every pair of columns with a row in which both are missing: that count, each column's own, and both as a share of either.

    Pairs are sums over patterns, not over rows. Without such a pair there is no row.
    """
    cols = columns_of(df, columns)
    if not cols:
        sums = local_table(df.sparkSession, [], PAIR_DDL)
    else:
        sums = gap_patterns(df, columns).mapInArrow(_products(len(cols)), "i int, counts binary").repartition("i").sortWithinPartitions(
            "i").mapInArrow(_sums, PAIR_DDL)
    # one row per pair and column; Spark sees to the join by size
    own = sums.where("i = j").select("i", F.col("both").alias("own"))
    alone = sums.where("i < j").join(own.withColumnRenamed("own", "missing_a"), "i").join(
        own.select(F.col("i").alias("j"), F.col("own").alias("missing_b")), "j")
    ordinals = _listed([c.ordinal for c in cols], "int")
    names = _listed([c.name for c in cols], "string")
    return alone.select(
        F.lit(dataset).alias("dataset"), ordinals[F.col("i")].alias("i"), ordinals[F.col("j")].alias("j"),
        names[F.col("i")].alias("col_a"), names[F.col("j")].alias("col_b"), "both", "missing_a", "missing_b",
        N.pct(F.col("both"), F.col("missing_a") + F.col("missing_b") - F.col("both")).alias("together_pct"))
