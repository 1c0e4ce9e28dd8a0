"""What the operators share: settled tables, free column names, whole texts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colscope.functions.session import new_folder

#: White space of the contracts: the ASCII space and the five control characters from tab to carriage return.
SPACES = r"[\x20\x09-\x0D]+"


def settle(df: DataFrame, stem: str = "llm") -> DataFrame:
    """Write a derived table to the shared folder of the cluster and read it back.

    What follows is computed from the files: rows keep their run and position numbers when a task
    is repeated, and no executor's loss reaches behind this point.
    """
    spark = df.sparkSession
    path = new_folder(spark, stem)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def settle_lean(df: DataFrame, stem: str = "llm") -> DataFrame:
    """settle, without what the write has shuffled: its files go when it ends, not when the driver happens to collect its garbage."""
    conf, name = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(name)
    conf.set(name, "true")
    try:
        return settle(df, stem)
    finally:
        conf.set(name, before)


def forget(df: DataFrame) -> None:
    """Delete the folder of a settled table that nothing reads again."""
    spark = df.sparkSession
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Bytes of an Arrow batch. A worker holds a batch's texts several times over (as Arrow, as strings, as what is made of them) and keeps
#: that memory for the next task, and the JVM holds a batch for each running task; Spark's own limit is 64 MB.
BATCH_BYTES = "8m"


def small_batches(spark) -> None:
    """From now on the session's Python tasks get batches of at most BATCH_BYTES. It stays set, as what an operator returns is computed later."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def whole_text(name: str) -> Column:
    """A text column with null as the empty text."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def free_name(df: DataFrame, name: str) -> str:
    """name, or name with underscores, so that no column of df is hidden by it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def remainder(id_col: str, n: int) -> Column:
    """crc32 of the identifier as text, mod n; null as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("long").cast("string"), F.lit("")).cast("binary")), F.lit(n))


def filled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The batches that have rows: columns of texts or lists can't be made of none."""
    return (b for b in batches if len(b))


def documents(spark, folder: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")
