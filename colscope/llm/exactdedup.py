"""Exact duplicates by a tree merge of digest runs, in DataFrame operations only.

Every input partition is a run of (digest, smallest identifier, rows). At each level `fan_in` neighbouring
runs are merged into one: entries with the same digest meet, their counts are added and the smallest
identifier is retained. An entry also carries the length and a second, independent hash of the text and only
meets entries that agree in all three, so each level verifies what it merges. After log(runs) levels a single
run is left, spread over the cluster by digest. A text that fills a third of all rows has one entry per run
from the first level on, and the way back (root, runs, rows) joins on run and digest, so that no key of a
join holds more rows than a run has.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colscope.llm.common import SPACES, documents, free_name, settle, whole_text

ENTRY = ["digest", "length", "check"]


def digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One slim row per row of df: run, position, identifier and the digest of the text with white space made one space."""
    text = F.regexp_replace(whole_text(text_col), SPACES, " ")
    return df.select(
        F.spark_partition_id().alias("run"), F.monotonically_increasing_id().alias("pos"),
        F.col(id_col).cast("long").alias("doc_id"), text.alias("text"),
    ).select("run", "pos", "doc_id", F.unhex(F.sha2("text", 256)).alias("digest"), F.length("text").alias("length"),
             F.xxhash64("text").alias("check"))


def merge_runs(slim: DataFrame, runs: int, fan_in: int = 8) -> tuple[DataFrame, DataFrame]:
    """(entries of the input runs, entries of the last run), both with the smallest row `keep` and `rows`."""
    smallest = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "pos")).alias("keep")
    leaves = slim.groupBy("run", *ENTRY).agg(smallest, F.count("*").alias("rows"))
    merged = leaves
    while runs > 1:
        merged = merged.withColumn("run", F.expr(f"run div {fan_in}").cast("int")).groupBy("run", *ENTRY).agg(
            F.min("keep").alias("keep"), F.sum("rows").alias("rows"))
        runs = -(-runs // fan_in)
    return leaves, merged.drop("run")


def exact_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", fan_in: int = 8) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 for every row of df.

    Texts are equal when identical after replacing each run of ASCII white space by one space; null counts as
    empty. The row with the smallest identifier stays; a null identifier is larger than any other, and of rows
    that also repeat the identifier the first one read stays. An empty table gives no rows. Other columns of df
    are neither read nor returned.
    """
    slim = settle(digests(df, id_col, text_col), "digests")
    runs = slim.agg(F.max("run")).first()[0]
    leaves, root = merge_runs(slim, 1 if runs is None else runs + 1, fan_in)
    answers = leaves.select("run", *ENTRY).join(root, ENTRY)
    rows = slim.join(answers, ["run", *ENTRY])
    return rows.select(
        "doc_id", F.col("keep.doc_id").alias("keep_id"), F.col("rows").alias("group_size"),
        (F.col("pos") == F.col("keep.pos")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def drop_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", fan_in: int = 8) -> DataFrame:
    """The rows of df that stay, with all their columns.

    Rows are found again by identifier and digest; of rows that repeat both, one stays (its other columns may be any of theirs).
    """
    kept = exact_groups(df, id_col, text_col, fan_in).where("kept")
    key, digest = free_name(df, "kept_id"), free_name(df, "kept_digest")
    marked = df.withColumn(key, F.col(id_col).cast("long")).withColumn(
        digest, F.sha2(F.regexp_replace(whole_text(text_col), SPACES, " "), 256))
    kept = kept.select(F.col("doc_id").alias(key), F.col("text_sha256").alias(digest))
    found = marked.join(kept.withColumnRenamed(key, "k").withColumnRenamed(digest, "d"),
                        F.col(key).eqNullSafe(F.col("k")) & (F.col(digest) == F.col("d")), "left_semi")
    return found.dropDuplicates([key, digest]).select(*df.columns)


def op6_exact(spark, folder: str) -> DataFrame:
    return exact_groups(documents(spark, folder))


ORACLE = r"""
with t as (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as body from documents)
select doc_id, min(doc_id) over (partition by body) as keep_id, count(*) over (partition by body) as group_size,
       doc_id = min(doc_id) over (partition by body) as kept, sha256(body) as text_sha256
from t
"""
