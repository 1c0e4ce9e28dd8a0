"""Text-response jobs (TX1-TX5), without a shuffle except for the statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colscope.functions import text as X

SPAN_PATTERN = r"(\[[\s\S]*\]|\{[\s\S]*\})"
ITEM_HEAD = r"^#?[ \t]*([0-9]+)[ \t]*[.):\-]\s*"


def clean_text(c: Column) -> Column:
    """TX1: no fence marks, at most one blank line in a row, stripped; null becomes empty."""
    return F.coalesce(X.strip(F.regexp_replace(X.unfence(c), "\n{3,}", "\n\n")), F.lit(""))


def _is_json(c: Column) -> Column:
    """The whole text is one JSON value. The parser ignores what follows a value, so the text is
    judged as an array element and as an object member."""
    element = F.try_parse_json(F.concat(F.lit("["), c, F.lit("]")))
    member = F.try_parse_json(F.concat(F.lit('{"v":'), c, F.lit("}")))
    return element.isNotNull() & member.isNotNull()


def extract_json(df: DataFrame, text_col: str) -> DataFrame:
    """TX2: the text as JSON once fences are gone, else its first bracketed span, else null."""
    whole = X.strip(X.unfence(F.col(text_col)))
    span = F.regexp_extract("_whole", SPAN_PATTERN, 1)
    return df.withColumn("_whole", whole).withColumn("_span", span).withColumn(
        "json_text",
        F.when(_is_json(F.col("_whole")), F.col("_whole"))
        .when((F.col("_span") != "") & _is_json(F.col("_span")), F.col("_span")),
    ).drop("_whole", "_span")


def numbered_list(df: DataFrame, text_col: str, expected: int) -> DataFrame:
    """TX3: items 1..expected of a numbered list; unnumbered lines continue the item above them.

    A later item with the same number replaces an earlier one. Everything happens inside the row.
    """
    lines = F.filter(F.transform(F.split(text_col, "\n"), X.strip), lambda x: x != "")
    joined = F.array_join(lines, "\n")
    blocks = F.split(joined, r"\n(?=#?[ \t]*[0-9]+[ \t]*[.):\-])")
    items = F.transform(
        F.filter(blocks, lambda b: b.rlike(ITEM_HEAD)),
        lambda b: F.struct(
            F.regexp_extract(b, ITEM_HEAD, 1).try_cast("int").alias("item"),
            X.strip(F.replace(F.regexp_replace(b, ITEM_HEAD, ""), F.lit("\n"), F.lit(" "))).alias("text")))
    kept = F.filter(items, lambda i: (i["text"] != "") & (i["item"] >= 1) & (i["item"] <= expected))
    last = F.filter(kept, lambda i, at: ~F.exists(
        F.slice(kept, at + 2, F.greatest(F.size(kept), F.lit(1))), lambda later: later["item"] == i["item"]))
    keys = [c for c in df.columns if c != text_col]
    return df.select(*keys, F.explode(last).alias("i")).select(*keys, "i.item", F.col("i.text").alias("item_text"))


def fingerprint(model: Column, prompt: Column) -> Column:
    """TX4: first 16 hex digits of the SHA-256 of "model:prompt"."""
    return F.substring(F.sha2(F.concat_ws(":", model, prompt), 256), 1, 16)
