"""Long (column, value) form of a table: the shared input of the profile operators.

A wide aggregate with several expressions per column outgrows generated code after a few dozen
columns. The long form keeps the plan the same size for 5 or 2,000 columns: one Expand, then one
partial aggregation per task keyed by the column ordinal, so only a handful of rows per task is
shuffled and no column - however skewed its values - lands unaggregated in one task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colscope.functions.session import local_table
from colscope.functions.numeric import as_double

# Longer text is compared by its SHA-256 digest, so histograms shuffle 64 characters at most.
DIGEST_OVER = 64
DIGEST_LENGTH = 64

INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FLOATING = (T.FloatType, T.DoubleType)


@dataclass(frozen=True)
class ColumnInfo:
    ordinal: int
    name: str
    dtype: T.DataType
    family: str  # integer, float, decimal, text, boolean, temporal, other

    @property
    def numeric(self) -> bool:
        return self.family in ("integer", "float", "decimal")


def _family(t: T.DataType) -> str:
    if isinstance(t, INTEGRAL):
        return "integer"
    if isinstance(t, FLOATING):
        return "float"
    if isinstance(t, T.DecimalType):
        return "decimal"
    if isinstance(t, (T.StringType, T.CharType, T.VarcharType)):
        return "text"
    if isinstance(t, T.BooleanType):
        return "boolean"
    if isinstance(t, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "temporal"
    return "other"


def columns_of(df: DataFrame, columns=None) -> list[ColumnInfo]:
    """Schema as a list; `columns` narrows it but ordinals stay those of the table."""
    keep = None if columns is None else set(columns)
    return [
        ColumnInfo(i, f.name, f.dataType, _family(f.dataType))
        for i, f in enumerate(df.schema.fields)
        if keep is None or f.name in keep
    ]


def schema_table(df: DataFrame, dataset: str = "", columns=None) -> DataFrame:
    """The schema as a relation: one row per column. Bounded by the number of columns."""
    rows = [(dataset, c.ordinal, c.name, c.dtype.simpleString(), c.family) for c in columns_of(df, columns)]
    return local_table(df.sparkSession, rows, "dataset string, ordinal int, name string, dtype string, family string"
    )


def by_position(df: DataFrame) -> DataFrame:
    """Rename columns to their ordinals, so dots, blanks and case collisions cannot hurt."""
    return df.toDF(*[str(i) for i in range(len(df.columns))])


def pos(c: ColumnInfo) -> Column:
    return F.col(f"`{c.ordinal}`")


def unpivot(df: DataFrame, exprs: list[tuple[int, Column]], value: str = "v") -> DataFrame:
    """(ordinal, value) rows from positional expressions; all expressions share one type."""
    wide = by_position(df).select(*[e.alias(f"c{o}") for o, e in exprs])
    return wide.unpivot([], [f"c{o}" for o, _ in exprs], "o", value)


def ordinal_of(o: Column) -> Column:
    """The ordinal behind an unpivoted name. Never null, so joins on it push no filter below the
    aggregation, where it would run once per cell."""
    return F.coalesce(F.substring(o, 2, 10).try_cast("int"), F.lit(-1))


def long_numeric(df: DataFrame, cols: list[ColumnInfo]) -> DataFrame:
    return unpivot(df, [(c.ordinal, as_double(pos(c), c.dtype)) for c in cols])


def long_text(df: DataFrame, cols: list[ColumnInfo]) -> DataFrame:
    return unpivot(df, [(c.ordinal, pos(c).cast("string")) for c in cols])


def compare_key(c: Column) -> Column:
    """The text itself, or its digest when it is long."""
    return F.when(F.char_length(c) > DIGEST_OVER, F.sha2(c, 256)).otherwise(c)


def _as_text(c: ColumnInfo) -> Column:
    if c.family == "other":
        if isinstance(c.dtype, T.BinaryType):
            return F.hex(pos(c))
        return F.when(pos(c).isNotNull(), F.to_json(F.struct(pos(c).alias("v"))))
    return pos(c).cast("string")


def typed_cell(c: ColumnInfo, whole: bool = False) -> Column:
    """A cell as (value_int, value_dbl, value_str), of which at most one is set, so no type loses precision."""
    text = F.lit(None).cast("string")
    if c.family not in ("integer", "float"):
        text = _as_text(c) if whole else compare_key(_as_text(c))
    return F.struct(
        (pos(c).cast("bigint") if c.family == "integer" else F.lit(None).cast("bigint")).alias("value_int"),
        (as_double(pos(c), c.dtype) if c.family == "float" else F.lit(None).cast("double")).alias("value_dbl"), text.alias("value_str"))


def histogram(df: DataFrame, columns=None, whole: bool = False) -> DataFrame:
    """(ordinal, value_int, value_dbl, value_str, cnt): value counts of every column, nulls included, from one scan.

    One Expand of tagged cells serves all types. Hot values collapse in the map-side partial aggregation; what is shuffled is
    at most the distinct values of each task, long texts as digests unless the `whole` text is asked for.
    """
    cols = columns_of(df, columns)
    if not cols:
        return local_table(df.sparkSession, [], "ordinal int, value_int bigint, value_dbl double, value_str string, cnt bigint")
    return unpivot(df, [(c.ordinal, typed_cell(c, whole)) for c in cols]).select("o", "v.value_int", "v.value_dbl", "v.value_str").groupBy(
        "o", "value_int", "value_dbl", "value_str").agg(F.count(F.lit(1)).alias("cnt")).select(
        ordinal_of(F.col("o")).alias("ordinal"), "value_int", "value_dbl", "value_str", "cnt")


def is_null_bucket() -> Column:
    return F.col("value_int").isNull() & F.col("value_dbl").isNull() & F.col("value_str").isNull()
