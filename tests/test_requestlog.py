"""Window counts of a request log against a plain loop."""

import datetime
import random

import pytest

from colscope.operators import requestlog as RL
from pyspark.sql import functions as F

START = datetime.datetime(2024, 1, 1)


def log(seed):
    """One key with a third of all rows, bursts, quiet times, ties and exact window distances."""
    rng, rows, event = random.Random(seed), [], 0
    for key in ["hot"] * 5 + [f"k{i}" for i in range(10)]:
        t = rng.randrange(100) * 1_000_000
        for _ in range(60):
            t += rng.choice([0, 1, 500_000, 1_000_000, 10_000_000, 60_000_000, 200_000_000]) if rng.random() < 0.5 else rng.randrange(20_000_000)
            rows.append((key, t, event))
            event += 1
    return rows


def frame(spark, rows):
    return spark.createDataFrame(
        [(k, START + datetime.timedelta(microseconds=t), e) for k, t, e in rows], "key string, ts timestamp_ntz, id bigint")


@pytest.mark.parametrize("slice_s", [1, 7, 60])
def test_window_counts_equal_a_loop(spark, slice_s):
    rows = log(5)
    got = {(r["key"], r["t"]): (r["requests"], r["in_window"])
           for r in RL.requests_in_window(frame(spark, rows), "key", "ts", 60, slice_s).collect()}
    base = int(START.replace(tzinfo=datetime.timezone.utc).timestamp() * 1_000_000)
    for key, t, _ in rows:
        mine = [x for k, x, _ in rows if k == key]
        assert got[(key, base + t)] == (mine.count(t), sum(t - 60_000_000 <= x <= t for x in mine))


@pytest.mark.parametrize("bucket_s", [None, 150])
def test_stream_equals_the_batch(spark, tmp_path, bucket_s):
    rows = sorted(log(6), key=lambda r: r[1])
    rng = random.Random(7)
    moved = sorted(rows, key=lambda r: r[1] + rng.randrange(25_000_000))  # out of order by less than the delay
    end = rows[-1][1] + 10**12
    step = len(moved) // 5 + 1
    for i in range(0, len(moved), step):
        frame(spark, moved[i: i + step]).coalesce(1).write.mode("append").parquet(f"{tmp_path}/log")
    frame(spark, [("end", end, 0), (None, end, 0)]).coalesce(1).write.mode("append").parquet(f"{tmp_path}/log")
    stream = spark.readStream.schema("key string, ts timestamp_ntz, id bigint").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/log")
    out = RL.streamed_requests_in_window(stream, "key", "ts", 60, bucket_s, "30 seconds")
    run = out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/marks").trigger(
        availableNow=True).start()
    assert run.awaitTermination(240)
    got = spark.read.parquet(f"{tmp_path}/out").collect()
    want = RL.requests_in_window(frame(spark, rows), "key", "ts", 60).collect()
    assert sorted(tuple(r) for r in got) == sorted((r["key"], r["t"], r["requests"], r["in_window"]) for r in want)
    assert len([p for p in run.recentProgress if p.numInputRows]) > 3


@pytest.mark.parametrize("kind", ["bigint", "string", "array<bigint>"])
def test_stream_of_many_keys_shares_calls(spark, tmp_path, kind):
    """A bucket's many keys take few states; null keys, keys over 2 ** 53 and keys in lists count as in a loop."""
    rng = random.Random(3)
    rows = [(rng.choice([None, *range(2**60, 2**60 + 300)]), rng.randrange(600_000_000), i) for i in range(1200)]
    rows.sort(key=lambda r: r[1])
    end = 10**12
    files = [rows[:600], rows[600:], [(1, end, 0)]]

    def table(some):
        made = spark.createDataFrame([(k, START + datetime.timedelta(microseconds=t), e) for k, t, e in some], "key bigint, ts timestamp_ntz, id bigint")
        return made.withColumn("key", F.array("key") if kind.startswith("array") else F.col("key").cast(kind))

    for some in files:
        table(some).coalesce(1).write.mode("append").parquet(f"{tmp_path}/log")
    stream = spark.readStream.schema(table(rows[:1]).schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/log")
    out = RL.streamed_requests_in_window(stream, "key", "ts", 60, 120, "30 seconds")
    run = out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/marks").trigger(
        availableNow=True).start()
    assert run.awaitTermination(240)
    base = 1_704_067_200_000_000
    got = {(str(r["key"]), r["t"] - base): (r["requests"], r["in_window"]) for r in spark.read.schema(out.schema).parquet(f"{tmp_path}/out").where(f"t < {base + 10**11}").collect()}
    want = {}
    for key, t, _ in rows:
        mine = [x for k, x, _ in rows if k == key]
        want[str([key] if kind.startswith("array") else key), t] = mine.count(t), sum(t - 60_000_000 <= x <= t for x in mine)
    assert got == want
    most = max(p.stateOperators[0].numRowsTotal for p in run.recentProgress if p.stateOperators)
    assert kind.startswith("array") or 0 < most <= 33 * 8  # shards and the one of null keys, by buckets


def test_stream_rows_just_behind_the_mark(spark, tmp_path):
    """What comes in between two marks ends its bucket, and the buckets of keys that share its state are not held up."""
    def write(rows):
        frame(spark, [(k, t * 1_000_000, 0) for k, t in rows]).coalesce(1).write.mode("append").parquet(f"{tmp_path}/log")

    write([(f"k{i}", 10 + i % 5) for i in range(100)])
    write([("k0", 1000)])
    write([("k0", 20), ("k1", 15)])  # behind the mark that the file before has set, not behind the one that held when it came
    stream = spark.readStream.schema("key string, ts timestamp_ntz, id bigint").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/log")
    out = RL.streamed_requests_in_window(stream, "key", "ts", 60, None, "30 seconds", 1)
    run = out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/marks").trigger(
        availableNow=True).start()
    assert run.awaitTermination(240)
    got = sorted((r["key"], r["requests"], r["in_window"]) for r in spark.read.schema(out.schema).parquet(f"{tmp_path}/out").collect())
    assert got == sorted([(f"k{i}", 1, 1) for i in range(100)] + [("k0", 1, 2), ("k1", 1, 2)])
