"""Numeric expressions that stay safe under ANSI mode (no divide by zero, no NaN surprises)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

INF = float("inf")


def as_double(c: Column, dtype: T.DataType) -> Column:
    """Cast to double; NaN becomes null, infinities stay."""
    d = c.cast("double")
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        d = F.when(~F.isnan(d), d)
    return d


def is_inf(c: Column) -> Column:
    return F.abs(c) == F.lit(INF)


def finite(c: Column) -> Column:
    return F.when(F.abs(c) < F.lit(INF), c)


def ratio(a: Column, b: Column) -> Column:
    """a / b, null when b is zero."""
    return a.cast("double") / F.nullif(b.cast("double"), F.lit(0.0))


def pct(a: Column, b: Column, digits: int = 2) -> Column:
    return F.round(ratio(a, b) * 100, digits)


def rounded(c: Column, digits: int) -> Column:
    """Rounded value without a negative zero."""
    return F.round(c, digits) + F.lit(0.0)


def finite_or_null(c: Column, digits: int = 4) -> Column:
    """Rounded value; NaN and infinities become null."""
    return F.when(F.abs(c) < F.lit(INF), rounded(c, digits))


def bands(c: Column, steps, default: str) -> Column:
    """Label by the first threshold reached, from high to low."""
    out = None
    for limit, label in steps:
        out = F.when(c >= limit, label) if out is None else out.when(c >= limit, label)
    return out.otherwise(default)
