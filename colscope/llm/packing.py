"""First-fit decreasing with a tournament tree of bin capacities, in randomised groups of documents.

A document's ids are cut into pieces of a whole sequence and a rest; whole pieces fill sequences of their own.
The rests are dealt at random into groups of about GROUP_PIECES, and each group is packed by itself: longest
first, each into the first bin that still has room. The bins are the leaves of a tournament tree whose inner
nodes hold the most room below them, so the first bin with room is found in log(bins) steps. Groups are of equal size
whatever the documents are, so no task depends on a source or a key.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colscope.llm.common import documents, settle, whole_text
from colscope.llm.tokens import WORD_BPE, encoder

SEQUENCE = 2048
#: The id that ends every document.
END_ID = 1
#: Pieces that are packed together, about.
GROUP_PIECES = 4096
#: Bins of a group are numbered below this.
GROUP_BINS = 1 << 32
#: Sequences of a single whole piece are numbered from here on.
FULL_FROM = 1 << 62


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset in the bin) of every piece; equal lengths are taken in the order given."""
    order = np.argsort(-lengths, kind="stable")
    leaves = 1
    while leaves < len(lengths):
        leaves *= 2
    room = [capacity] * (2 * leaves)
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for i, length in zip(order.tolist(), lengths[order].tolist()):
        if not 0 < length <= capacity:
            raise ValueError(f"a piece of {length} in bins of {capacity}")
        node = 1
        while node < leaves:
            node *= 2
            if room[node] < length:
                node += 1
        bins[i], offsets[i] = node - leaves, capacity - room[node]
        room[node] -= length
        while node > 1:
            node //= 2
            most = max(room[2 * node], room[2 * node + 1])
            if room[node] == most:
                break
            room[node] = most
    return bins, offsets


def pieces(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = WORD_BPE, capacity: int = SEQUENCE) -> DataFrame:
    """doc_id, start, length, ids_crc32 and doc_tokens: every document's ids and the end id, cut at each `capacity` ids."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tool = encoder(path)
        for batch in batches:
            out: list[tuple] = []
            for doc, text in zip(batch["doc_id"].astype("Int64").array, batch["text"]):
                ids = np.append(np.frombuffer(tool.encode(text), np.uint32), END_ID).astype("<u4")
                for start in range(0, len(ids), capacity):
                    part = ids[start: start + capacity]
                    out.append((doc, start, len(part), zlib.crc32(part.tobytes()), len(ids)))
            yield pd.DataFrame(out, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens"]).astype({"doc_id": "Int64"})

    slim = df.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text"))
    return slim.mapInPandas(cut, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def pack(cut: DataFrame, capacity: int = SEQUENCE, seed: int = 11, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """The pieces with sequence_id and offset.

    Pieces of the full capacity have a sequence of their own (numbered by place, so that nothing has to be counted for
    it). Repeated rows are pieces like any others, each placed once; no rows give no rows. cut is settled first: the
    groups are dealt by place, which a repeated task must find again.
    """
    placed = settle(cut.withColumn("place", F.monotonically_increasing_id()), "pieces")
    full = placed.where(F.col("length") == capacity).select("*", (F.col("place") + FULL_FROM).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rests = placed.where(F.col("length") < capacity)
    groups = max(1, round(rests.count() / group_pieces))
    dealt = rests.withColumn("pack_group", F.pmod(F.xxhash64(F.lit(seed), "place"), F.lit(groups)))
    columns = placed.columns

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("place", ignore_index=True)
        bins, offsets = first_fit_decreasing(group["length"].to_numpy(), capacity)
        return group[columns].assign(sequence_id=group["pack_group"].to_numpy() * GROUP_BINS + bins, offset=offsets)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in placed.schema) + ", sequence_id long, offset long"
    packed = dealt.groupBy("pack_group").applyInPandas(fit, schema)
    return packed.unionByName(full).drop("place")


def pack_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = WORD_BPE, capacity: int = SEQUENCE) -> DataFrame:
    """One row per piece of every row of df. Null and empty texts are a piece of the end id alone."""
    return pack(pieces(df, id_col, text_col, path, capacity), capacity)


def sequences(packed: DataFrame, capacity: int = SEQUENCE) -> DataFrame:
    """sequence_id, filled, padded_to (the capacity, or filled where that is a power of two) and its padding."""
    filled = packed.groupBy("sequence_id").agg(F.sum("length").alias("filled"), F.count("*").alias("pieces"))
    power = F.col("filled").bitwiseAND(F.col("filled") - 1) == 0
    return filled.withColumn("padded_to", F.when(power, F.col("filled")).otherwise(capacity)).withColumn("padding", F.col("padded_to") - F.col("filled"))


def op5_packing(spark, folder: str) -> DataFrame:
    return pack_documents(documents(spark, folder))
