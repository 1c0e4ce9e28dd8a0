"""Request-log analytics (RL1, RL3)."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from colscope import constants as K

SLICE_S = 10
#: Into how many parts the keys of a stream's time bucket are dealt.
SHARDS = 32


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def slice_no(t: Column, width_us: int) -> Column:
    """Number of the time slice, in whole microseconds."""
    return ((t - F.pmod(t, F.lit(width_us))) / width_us).cast("bigint")


def requests_in_window(events: DataFrame, key: str, ts: str, window_s: int = 60, slice_s: int = SLICE_S) -> DataFrame:
    """RL1: requests of the key in the trailing window, for every (key, time) that has any.

    A request exactly `window_s` old still counts. The count is a difference of two running
    totals. Totals are built in two levels - inside short time slices, and over slices per key -
    so a key that owns a third of the log is spread over as many tasks as it has slices, and one
    task never orders more than the distinct times of one slice or the slices of one key.
    """
    w_us, s_us = window_s * 1_000_000, max(1, min(slice_s, window_s)) * 1_000_000
    hits = events.select(F.col(key).alias("key"), micros(F.col(ts)).alias("t")).groupBy("key", "t").agg(
        F.count(F.lit(1)).alias("n"))
    # Each time asks for the running total up to itself and up to just before its window starts.
    points = hits.withColumn("p", F.explode(F.array(
        F.struct(F.col("t").alias("at"), F.lit(1).alias("sign"), F.col("n").alias("add")),
        F.struct((F.col("t") - w_us).alias("at"), F.lit(-1).alias("sign"), F.lit(0).cast("bigint").alias("add")),
    ))).select("key", "t", "n", "p.*").withColumn("slice", slice_no(F.col("at"), s_us))
    inside = Window.partitionBy("key", "slice").orderBy("at", "sign").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("key").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = points.groupBy("key", "slice").agg(F.sum("add").alias("total")).select(
        "key", "slice", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("before"))
    return points.withColumn("within", F.sum("add").over(inside)).join(slices, ["key", "slice"]).groupBy("key", "t").agg(
        F.max("n").alias("requests"),
        F.sum(F.col("sign") * (F.col("within") + F.col("before"))).alias("in_window"))


def streamed_requests_in_window(events: DataFrame, key: str, ts: str, window_s: int = 60, bucket_s: int | None = None,
                                delay: str = "10 seconds", shards: int = SHARDS) -> DataFrame:
    """RL1 over a stream: the same rows as requests_in_window, in append mode, once the watermark has passed them.

    Time is cut into buckets of at least the window's length. A request goes to its own bucket and, where its window
    reaches over the bucket's end, also to the next, so a bucket is counted from its own rows alone: a key that owns a third of
    the stream is split over time, and a state never holds more than the distinct keys and times of one bucket and one
    window. The keys of a bucket are dealt to `shards` states, so that many keys of few requests share a call; those of types that Python can't hash
    have a state each. Requests later than `delay` behind the newest, and those without a time, do not count.
    """
    w_us, b_us = window_s * 1_000_000, max(bucket_s or 0, window_s) * 1_000_000
    timed = events.select(F.col(key).alias("key"), F.col(ts).cast("timestamp").alias("ts")).where(F.col("ts").isNotNull())
    kind = timed.schema["key"].dataType.simpleString()
    parts = timed.withWatermark("ts", delay).withColumn("t", micros(F.col("ts"))).withColumn("own", slice_no(F.col("t"), b_us))
    ahead = (F.col("own") + 1) * b_us - F.col("t") <= w_us
    alone = kind.startswith(("array", "struct")) or "collate" in kind
    # null keys have a shard of their own, as they would turn numbers into floats
    shard = F.col("key") if alone else F.when(F.col("key").isNull(), -1).otherwise(F.pmod(F.hash("key"), F.lit(shards)))
    parts = parts.withColumn("bucket", F.explode(F.when(ahead, F.array("own", F.col("own") + 1)).otherwise(F.array("own")))).select(
        shard.alias("shard"), "bucket", "key", "t", "ts")

    def count(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        bucket, one = int(group[1]), alone or group[0] == -1
        names, codes, times, counts = None, *[np.empty(0, np.int64)] * 3
        if state.exists:
            names = pickle.loads(state.get[0])
            codes, times, counts = (np.frombuffer(x, np.int64) for x in state.get[1:])
        if not state.hasTimedOut:
            came = pd.concat(list(frames), ignore_index=True)
            new = np.zeros(len(came), np.int64)
            if not one:
                new, names = pd.factorize(came["key"] if names is None else pd.concat([names.to_series(), came["key"]], ignore_index=True), use_na_sentinel=False)
                new = new[len(new) - len(came):]  # the names so far keep their codes
            codes, times = np.concatenate([codes, new]), np.concatenate([times, came["t"].to_numpy(np.int64)])
            counts = np.concatenate([counts, np.ones(len(came), np.int64)])
            order = np.lexsort((times, codes))
            codes, times, counts = codes[order], times[order], counts[order]
            fresh = np.flatnonzero(np.r_[True, (codes[1:] != codes[:-1]) | (times[1:] != times[:-1])])
            codes, times, counts = codes[fresh], times[fresh], np.add.reduceat(counts, fresh)
            # rows that came in just behind the mark end their bucket at once: none can come any more
            if state.getCurrentWatermarkMs() < (bucket + 1) * b_us // 1000:
                state.update((pickle.dumps(names), codes.tobytes(), times.tobytes(), counts.tobytes()))
                state.setTimeoutTimestamp((bucket + 1) * b_us // 1000)
                return
        state.remove()
        # each time's window begins behind all that is before it in the order of keys and times
        order = np.lexsort((np.repeat([1, 0], len(times)), np.concatenate([times, times - w_us]), np.tile(codes, 2)))
        before = np.empty(len(order), np.int64)
        before[order] = np.cumsum(np.concatenate([counts, np.zeros_like(counts)])[order])
        inside = np.cumsum(counts) - before[len(times):]
        own = times >= bucket * b_us
        if own.any():
            keys = [group[0] if alone else None] * int(own.sum()) if one else names.take(codes[own])
            yield pd.DataFrame({"key": keys, "t": times[own], "requests": counts[own], "in_window": inside[own]})

    return parts.groupBy("shard", "bucket").applyInPandasWithState(
        count, f"key {kind}, t bigint, requests bigint, in_window bigint", "names binary, codes binary, times binary, counts binary", "append",
        GroupStateTimeout.EventTimeTimeout)


def tier_rules(requests: DataFrame) -> DataFrame:
    """RL3: which limit applies to a request: skipped, strict or global, and the key it counts against."""
    path = F.regexp_replace("path", "/+$", "")
    exempt = path.isin(*K.EXEMPT_PATHS)
    for prefix in K.EXEMPT_PREFIXES:
        exempt = exempt | path.startswith(prefix)
    tier = (F.when(F.col("method") == "OPTIONS", "skip").when(exempt, "skip")
            .when(path.isin(*K.STRICT_PATHS), "strict").otherwise("global"))
    limit = F.when(tier == "strict", K.STRICT_TIER[0]).when(tier == "global", K.GLOBAL_TIER[0])
    window = F.when(tier == "strict", K.STRICT_TIER[1]).when(tier == "global", K.GLOBAL_TIER[1])
    return requests.withColumns({"tier": tier, "max_reqs": limit, "window_s": window}).withColumn(
        "limit_key", F.when(F.col("tier") != "skip", F.concat_ws(":", "tier", "client")))
