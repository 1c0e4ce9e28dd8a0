"""Histories on disk: only what a write or the retention touches is written anew."""

import datetime
import glob
import os

from pyspark.sql import functions as F

from colscope.operators import history as HX
from colscope.operators import profile as P
from colscope.sources import csvfiles

NOW = datetime.datetime(2024, 3, 10, 12)


def files(folder):
    return {os.path.relpath(p, folder) for p in glob.glob(f"{folder}/*/*.parquet")}


def rows_of(spark, folder):
    return sorted((r.job_id, r.created_at) for r in spark.read.parquet(folder).select("job_id", "created_at").collect())


def test_retention_touches_only_expired_days(spark, tmp_path):
    folder = str(tmp_path / "history")
    hours = [1, 5, 30, 47, 49, 55, 80, 200, 30 * 24]
    jobs = spark.createDataFrame([(i, NOW - datetime.timedelta(hours=h)) for i, h in enumerate(hours)], "job_id long, created_at timestamp_ntz")
    HX.write_history(jobs, folder)
    before = files(folder)
    now = F.lit(NOW).cast("timestamp_ntz")
    HX.apply_retention(spark, folder, now)
    want = sorted((i, NOW - datetime.timedelta(hours=h)) for i, h in enumerate(hours) if h <= 48)
    assert rows_of(spark, folder) == want
    after = files(folder)
    late = {f for f in before if f >= "day=2024-03-09"}
    assert late and late <= after and not {f for f in after if f < "day=2024-03-08"}
    HX.apply_retention(spark, folder, now)  # again: nothing expires
    assert files(folder) == after and rows_of(spark, folder) == want
    HX.apply_retention(spark, folder, F.lit(NOW + datetime.timedelta(hours=36)).cast("timestamp_ntz"))  # a day with no row left
    assert rows_of(spark, folder) == [r for r in want if r[1] >= NOW - datetime.timedelta(hours=12)]


def test_days_are_replaced_and_repeated_writes_change_nothing(spark, tmp_path):
    folder = str(tmp_path / "history")
    a = spark.createDataFrame([(1, NOW), (2, NOW - datetime.timedelta(days=1))], "job_id long, created_at timestamp_ntz")
    HX.write_history(a, folder)
    kept = {f for f in files(folder) if f.startswith("day=2024-03-10")}
    for _ in range(2):
        HX.write_history(spark.createDataFrame([(3, NOW - datetime.timedelta(days=1))], a.schema), folder)
        assert [i for i, _ in rows_of(spark, folder)] == [1, 3] and kept <= files(folder)


def test_sink_leaves_other_datasets(spark, tmp_path):
    counts = {n: P.column_counts(spark.range(n), f"t{n}") for n in (3, 4)}
    where = csvfiles.result_sink({"counts": counts[3].unionByName(counts[4])}, str(tmp_path))["counts"]
    before = files(where)
    for _ in range(2):
        csvfiles.result_sink({"counts": counts[4]}, str(tmp_path))
        after = files(where)
        assert {f for f in before if f.startswith("dataset=t3")} <= after
        assert sorted((r.dataset, r.rows) for r in spark.read.parquet(where).collect()) == [("t3", 3), ("t4", 4)]
