"""Analysis history (HX1-HX6): queries over a table of jobs and its metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from colscope import constants as K

TERMINAL = ("completed", "failed", "cancelled")


def latest_per_session(jobs: DataFrame, limit: int = 50, status: str | None = None) -> DataFrame:
    """HX1: newest jobs of every session.

    Spark keeps at most `limit` rows per session and task before the shuffle, so a session that
    owns a large part of the table reaches one task with a bounded number of rows.
    """
    rows = jobs if status is None else jobs.where(F.col("status") == status)
    w = Window.partitionBy("session_id").orderBy(F.desc("created_at"), "job_id")
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def retention_split(jobs: DataFrame, now: Column, hours: int = 48) -> DataFrame:
    """HX2: rows past the retention period and rows kept, in one pass."""
    cutoff = now - F.expr(f"interval {int(hours)} hours")
    return jobs.agg(F.count_if(F.col("created_at") < cutoff).alias("removed"),
                    F.count_if(~(F.col("created_at") < cutoff)).alias("kept"))


def retained(jobs: DataFrame, now: Column, hours: int = 48) -> DataFrame:
    """HX2: the rows that stay; write them back to apply the retention."""
    return jobs.where(~(F.col("created_at") < now - F.expr(f"interval {int(hours)} hours")))


def write_history(jobs: DataFrame, folder: str) -> None:
    """HX2: add or replace whole days of history, partitioned by `day`; days that jobs does not hold stay as they are."""
    jobs.withColumn("day", F.to_date("created_at")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(folder)


def apply_retention(spark: SparkSession, folder: str, now: Column, hours: int = 48) -> None:
    """HX2: drop expired rows from a history that write_history wrote.

    The day of the cutoff is rewritten, if rows of it expire; days before it are dropped as folders; later days and rows
    without a time are not touched. Every step may be repeated, so a run that was cut off is finished by the next.
    """
    schema = spark.read.parquet(folder).drop("day").schema
    history = spark.read.schema(schema.add("day", "date")).parquet(folder)
    cutoff = now - F.expr(f"interval {int(hours)} hours")
    edge = history.where(F.col("day") == F.to_date(cutoff))
    removed, kept = retention_split(edge, now, hours).first()
    if removed and kept:
        retained(edge, now, hours).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(folder)
    last = spark.range(1).select(F.date_format(cutoff, "yyyy-MM-dd")).first()[0]
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(folder)
    files = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for entry in files.listStatus(root):
        name = entry.getPath().getName()
        if name[:4] == "day=" and name[4:5].isdigit() and (name[4:] < last or name[4:] == last and removed and not kept):
            files.delete(entry.getPath(), True)


def active_sessions(sessions: DataFrame, now: Column, hours: int = 168) -> DataFrame:
    """HX3: sessions with their expiry and whether they are still valid."""
    expires = F.col("created_at") + F.expr(f"interval {int(hours)} hours")
    return sessions.select("session_id", "created_at", expires.alias("expires_at"), (~(expires < now)).alias("active"))


def metadata_rows(info, duplicates, structure, split, picks) -> DataFrame:
    """HX4: the short record kept per analysed dataset."""
    return (
        info.join(duplicates, "dataset").join(structure.select("dataset", "type"), "dataset").join(split, "dataset")
        .join(picks.select("dataset", "primary_model"), "dataset", "left")
        .select("dataset", F.col("rows").alias("row_count"), F.col("columns").alias("column_count"), "missing_percentage",
                "duplicate_rows", F.col("type").alias("data_structure_type"), F.col("critical").alias("critical_issues_count"),
                F.col("high").alias("high_issues_count"), F.col("medium").alias("medium_issues_count"),
                F.col("primary_model").alias("primary_model_recommendation"))
    )


def history_view(jobs: DataFrame, metadata: DataFrame) -> DataFrame:
    """HX5: jobs with their metadata as a struct, null where there is none. One row per job in `metadata`."""
    packed = metadata.select("job_id", F.struct(*[c for c in metadata.columns if c != "job_id"]).alias("metadata"))
    return jobs.join(packed, "job_id", "left")


def latest_state(events: DataFrame) -> DataFrame:
    """HX6: last known status per job; map-side partial, so a chatty job costs nothing extra."""
    return events.groupBy("job_id").agg(
        F.max_by("status", F.struct("changed_at", "event_id")).alias("status"), F.max("step").alias("step"))


def job_state_rules(states: DataFrame) -> DataFrame:
    """HX6: whether a job may be cancelled, and its progress by the last finished step."""
    progress = F.create_map(*[F.lit(x) for no, _, pct in K.JOB_STEPS for x in (no, pct)])[F.col("step")]
    return states.select("job_id", "status", (~F.col("status").isin(*TERMINAL)).alias("cancellable"),
                         F.when(F.col("status") == "completed", 100).otherwise(F.coalesce(progress, F.lit(0))).alias("progress"))
