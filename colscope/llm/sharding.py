"""A uniform shuffle into shards of exact size by a hypergeometric communication matrix.

How many rows of each input partition go to each shard is drawn exactly, as if all rows had been permuted and
cut: row p of the matrix is a multivariate hypergeometric draw from what the earlier partitions left of each
shard. Every partition permutes its rows and deals them out by its row of the matrix; the rows are exchanged,
and every shard is permuted again. Only row counts per partition reach the driver.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colscope.functions.session import local_table
from colscope.llm.common import documents, free_name, settle, whole_text

#: numpy draws hypergeometric numbers up to this population.
NUMPY_MOST = 10**9
#: Rows that one task of the second permutation sorts, about.
CELL_ROWS = 500_000


def hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """Good ones among `draws` from good + bad without replacement, for populations of any size."""
    if draws == 0 or good == 0:
        return 0
    if bad == 0 or draws == good + bad:
        return min(good, draws)
    if good + bad < NUMPY_MOST:
        return int(rng.hypergeometric(good, bad, draws))
    lowest, highest = max(0, draws - bad), min(draws, good)

    def log_p(k: int) -> float:
        return -(math.lgamma(k + 1) + math.lgamma(good - k + 1) + math.lgamma(draws - k + 1) + math.lgamma(bad - draws + k + 1))

    mode = min(max((draws + 1) * (good + 1) // (good + bad + 2), lowest), highest)
    top = log_p(mode)
    share = good / (good + bad)
    spread = math.sqrt(draws * share * (1 - share) * (good + bad - draws) / (good + bad - 1)) + 0.5
    # ratio of uniforms around the mode, with the usual hat of width s
    s, centre = 2 * math.sqrt(2 / math.e) * spread + (3 - 2 * math.sqrt(3 / math.e)), draws * share + 0.5
    while True:
        u = 1.0 - rng.random()
        x = centre + s * (rng.random() - 0.5) / u
        k = math.floor(x)
        if lowest <= k <= highest and 2 * math.log(u) <= log_p(k) - top:
            return k


def communication_matrix(counts: list[int], shards: int, seed: int) -> np.ndarray:
    """matrix[p, j]: rows of partition p for shard j; shard sizes are at most one apart."""
    rng = np.random.default_rng(seed)
    total = sum(counts)
    room = [total // shards + (j < total % shards) for j in range(shards)]
    out = np.zeros((len(counts), shards), dtype=np.int64)
    for p, left in enumerate(counts):
        rest = sum(room)
        for j in range(shards):
            rest -= room[j]
            take = hypergeometric(rng, room[j], rest, left)
            out[p, j] = take
            left -= take
        for j in range(shards):
            room[j] -= int(out[p, j])
    return out


def shard_rows(df: DataFrame, shards: int = 16, seed: int = 7, shard_col: str = "shard", slot_col: str = "slot") -> DataFrame:
    """df with shard (0 to shards - 1, sizes at most one apart) and slot (the place in the shard, gapless from 0).

    Every row is dealt by its place in the input alone, so nulls, empty texts and repeated rows (even a third
    of all rows with one key) need no care; columns named as the new ones are an error. An empty table gives no rows.
    df is settled first, since the matrix only fits the very partitions that were counted.
    """
    if {shard_col.lower(), slot_col.lower()} & {c.lower() for c in df.columns}:
        raise ValueError(f"the table has a column {shard_col} or {slot_col}")
    part, pos, one, two, rank, cell, shift = (free_name(df, x) for x in ("part", "pos", "key_one", "key_two", "rank", "cell", "shift"))
    cuts = free_name(df, "cuts")
    placed = settle(df.withColumn(part, F.spark_partition_id()).withColumn(pos, F.monotonically_increasing_id()), "shards")
    counted = sorted((r[0], r[1]) for r in placed.groupBy(part).count().collect())
    matrix = communication_matrix([n for _, n in counted], shards, seed)
    total = int(matrix.sum())
    edges = local_table(df.sparkSession, [(p, int(j), int(c)) for (p, _), row in zip(counted, matrix) for j, c in enumerate(np.cumsum(row))],
                        f"{part} int, j int, below bigint")
    edges = edges.groupBy(part).agg(F.sort_array(F.collect_list("below")).alias(cuts))
    local = Window.partitionBy(part).orderBy(one, pos)
    dealt = placed.withColumn(one, F.xxhash64(F.lit(seed), F.lit("deal"), pos)).withColumn(two, F.xxhash64(F.lit(seed), F.lit("place"), pos))
    dealt = dealt.withColumn(rank, F.row_number().over(local) - 1).join(edges, part)
    dealt = dealt.withColumn(shard_col, F.size(F.filter(F.col(cuts), lambda c: c <= F.col(rank))))
    # the second permutation: by the top bits of a random key into cells, sorted within each
    bits = max(3, math.ceil(math.log2(max(1, total / shards / CELL_ROWS))))
    dealt = dealt.withColumn(cell, F.shiftrightunsigned(two, 64 - bits).cast("int"))
    sizes = dealt.groupBy(shard_col, cell).count().withColumn(
        shift, F.sum("count").over(Window.partitionBy(shard_col).orderBy(cell)) - F.col("count")).drop("count")
    within = Window.partitionBy(shard_col, cell).orderBy(two, pos)
    dealt = dealt.withColumn(rank, F.row_number().over(within) - 1).join(sizes, [shard_col, cell])
    return dealt.select(*df.columns, F.col(shard_col).cast("int"), (F.col(rank) + F.col(shift)).cast("long").alias(slot_col))


def op3_shards(spark, folder: str) -> DataFrame:
    text = F.encode(whole_text("text"), "UTF-8")
    slim = documents(spark, folder).select(F.col("doc_id").cast("long").alias("doc_id"), (F.length(text) + 1).cast("long").alias("size"),
                                           F.crc32(text).alias("text_crc32"))
    return shard_rows(slim).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                                   F.lit(None).cast("int").alias("grown_shard"))
