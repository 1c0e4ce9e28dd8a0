"""Text expressions: all JVM-side, no Python per value."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from colscope import constants as K

# Every Unicode White_Space character; trim() alone strips blanks only.
WHITESPACE = "".join(
    chr(c)
    for c in (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
              0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
)
# Number grammar of a float literal: sign, digits with single underscores, exponent, inf, nan.
_DIGITS = r"[0-9](_?[0-9])*"
NUMBER_PATTERN = (
    rf"^[+-]?(({_DIGITS}(\.({_DIGITS})?)?|\.{_DIGITS})([eE][+-]?{_DIGITS})?"
    r"|[iI][nN][fF]([iI][nN][iI][tT][yY])?|[nN][aA][nN])$"
)
_TIME = r"([T ]([01][0-9]|2[0-3]):[0-5][0-9](:[0-5][0-9](\.[0-9]{1,9})?)?(Z|[+-][0-9]{2}:?[0-9]{2})?)?"
YMD_PATTERN = rf"^[0-9]{{4}}[-/][0-9]{{2}}[-/][0-9]{{2}}{_TIME}$"
DMY_PATTERN = rf"^[0-9]{{2}}[-/][0-9]{{2}}[-/][0-9]{{4}}{_TIME}$"
FENCE_PATTERN = r"```(json)?\s*"


def strip(c: Column) -> Column:
    """Remove leading and trailing whitespace of any kind."""
    return F.btrim(c, F.lit(WHITESPACE))


def looks_numeric(c: Column) -> Column:
    """True when the text, commas removed, reads as a float literal."""
    return strip(F.replace(c, F.lit(","), F.lit(""))).rlike(NUMBER_PATTERN)


def is_disguised_missing(c: Column) -> Column:
    return F.lower(strip(c)).isin(*K.DISGUISED_MISSING)


def _valid_day(c: Column, shape: str, fmt: str) -> Column:
    day = F.replace(F.substring(c, 1, 10), F.lit("/"), F.lit("-"))
    return F.when(c.rlike(shape), F.try_to_timestamp(day, F.lit(fmt)).isNotNull()).otherwise(False)


def is_ymd(c: Column) -> Column:
    """Year-month-day text with an optional time, and a day that exists in the calendar."""
    return _valid_day(c, YMD_PATTERN, "yyyy-MM-dd")


def is_dmy(c: Column) -> Column:
    return _valid_day(c, DMY_PATTERN, "dd-MM-yyyy")


def starts_like_formula(c: Column) -> Column:
    return F.substring(strip(c), 1, 1).isin(*K.FORMULA_STARTS)


def safe_name(c: Column) -> Column:
    """File stem that is safe to use in a header: word characters, dot and hyphen only."""
    stem = F.regexp_replace(c, r"(?i)\.csv$", "")
    kept = F.regexp_replace(stem, r"[^A-Za-z0-9._-]", "_")
    return F.coalesce(F.nullif(F.btrim(kept, F.lit("._")), F.lit("")), F.lit("report"))


def unfence(c: Column) -> Column:
    """Drop code-fence marks."""
    return F.regexp_replace(c, FENCE_PATTERN, "")


def contains_any(c: Column, words) -> Column:
    """True when the lower-cased text contains one of the (fixed, short) words."""
    low = F.lower(c)
    hit = F.lit(False)
    for w in words:
        hit = hit | low.contains(w)
    return hit
