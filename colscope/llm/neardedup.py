"""Near duplicates: SuperMinHash signatures, banding, verification on full sets, components of the links.

Documents with the same shingle set are one node, so exact copies cost nothing beyond one aggregation. Signatures of
128 places are cut into 32 bands of 4; two nodes of similarity 0.75 share no band with a probability of about
5e-6. In each bucket (nodes with the same band) the nodes are compared with the bucket's centre (the node with the most
company in all its buckets), not with each other; links make components, and only buckets that still hold more than one component are looked at again: with other centres
while that would leave many open pairs, and then pair by pair across components, so that no link is lost and the pairs
of a large group are never all made. Pairs with a centre whose signatures agree in fewer than 72 of 128 places, and pairs across components that
agree in fewer than 1,712 of 2,048 places of one bit, are not verified: a pair of similarity 0.75 fails either less often than the banding. The bits are
compared inside the join, so a bucket's pairs that are far apart never leave it, and so are the bands: a pair leaves the first
bucket that it shares, and no other.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colscope.llm.common import documents, filled, free_name, settle, whole_text
from colscope.llm.components import components
from colscope.llm.suffixtree import bit_map
from colscope.llm.superminhash import PLACES, WordHashes, shingles, signatures, similar
from colscope.llm.tokens import portions

BANDS = 32
PERCENT = 75
#: Open pairs for each node of an open bucket up to which they are compared pair by pair.
OPEN_PAIRS = 20
#: Places of two signatures that must agree for a pair to be verified.
AGREE = 72
#: Places of the one-bit signatures of nodes in open buckets, and how many may differ: at a similarity of 0.75 256 do on average, with a
#: deviation of 15, at 0.65 358 and at 0.5 512.
WIDE, WIDE_APART = 2048, 336


def sketches(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """pos, doc_id, thash, n, digest (of the shingle set) and signature of every row, settled."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = WordHashes()
        for b in batches:
            at = 0
            for some in portions(b["text"]):
                sets = [shingles(t, known) for t in some]
                marks = signatures(sets)
                part = b.iloc[at: at + len(some)]
                at += len(some)
                yield pd.DataFrame({
                    "pos": part["pos"].to_numpy(), "doc_id": part["doc_id"].astype("Int64").array, "thash": part["thash"].to_numpy(),
                    "n": [len(s) for s in sets], "digest": [xxhash.xxh3_128_digest(s) for s in sets],
                    "signature": [m.tobytes() for m in marks]})

    slim = df.select(F.monotonically_increasing_id().alias("pos"), F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text")
                     ).withColumn("thash", F.xxhash64("text"))
    return settle(slim.mapInPandas(run, "pos long, doc_id long, thash long, n long, digest binary, signature binary"), "sketches")


BIT_WORDS = [f"w{i}" for i in range(WIDE // 64)]
BAND_WORDS = [f"g{i}" for i in range(BANDS)]


def wide_bits(grams: DataFrame) -> DataFrame:
    """node, one bit of each of WIDE places and the bands as 64-bit numbers, settled. grams: node, grams and signature of the nodes in open buckets."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), 256):
                part = b.iloc[at: at + 256]
                marks = signatures([np.frombuffer(g, np.uint64) for g in part["grams"]], WIDE)
                packed = np.packbits((marks & 1).astype(bool), axis=1).view(np.int64)
                bands = np.frombuffer(b"".join(part["signature"]), np.int64).reshape(len(part), BANDS)
                yield pd.DataFrame({"node": part["node"].to_numpy(), **{w: packed[:, i] for i, w in enumerate(BIT_WORDS)}, **{g: bands[:, i] for i, g in enumerate(BAND_WORDS)}})

    return settle(grams.mapInPandas(run, "node long, " + ", ".join(f"{w} long" for w in BIT_WORDS + BAND_WORDS)), "wide")


def band_keys(nodes: DataFrame) -> DataFrame:
    """key, band, node for each band of each node."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                rows = np.frombuffer(b"".join(b["signature"]), np.uint64).reshape(len(b), BANDS)
                mixed = rows * np.uint64(0x9E3779B97F4A7C15) + np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
                mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
                yield pd.DataFrame({"key": (mixed ^ (mixed >> np.uint64(32))).view(np.int64).reshape(-1), "band": np.tile(np.arange(BANDS, dtype=np.int32), len(b)),
                                    "node": np.repeat(b["node"].to_numpy(), BANDS)})

    return nodes.select("node", "signature").mapInPandas(run, "key long, band int, node long")


def shingle_sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """node and its sorted shingle hashes as bytes, settled: made once, however many pairs a node is in. wanted: node, doc_id, thash.

    Texts are not shuffled: a bit map tells nearly all rows that aren't wanted where they are read, and the join drops the others.
    """
    key = F.xxhash64("thash", "doc_id").alias("key")
    wanted = settle(wanted.select("node", "doc_id", "thash", key), "wanted")
    shared = docs.sparkSession.sparkContext.broadcast(bit_map(wanted))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = WordHashes()
        for b in filled(batches):
            b = b[shared.value.holds(b["key"].to_numpy())]
            at = 0
            for some in portions(b["text"]):
                part = b.iloc[at: at + len(some)]
                at += len(some)
                yield pd.DataFrame({"doc_id": part["doc_id"].astype("Int64").array, "thash": part["thash"].to_numpy(), "grams": [shingles(t, known).tobytes() for t in some]})

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text")).withColumn("thash", F.xxhash64("text"))
    sets = slim.select("doc_id", "thash", "text", key).mapInPandas(run, "doc_id long, thash long, grams binary")
    found = sets.alias("d").join(wanted.alias("w"), (F.col("d.thash") == F.col("w.thash")) & F.col("d.doc_id").eqNullSafe(F.col("w.doc_id")))
    # of rows that repeat identifier and text, any is as good
    grams = settle(found.select("node", "grams").dropDuplicates(["node"]), "grams")
    shared.unpersist()
    return grams


def verified(pairs: DataFrame, grams: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets are similar enough. Sets are read where they lie in the batch, without copies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, two = batch.column("grams_a"), batch.column("grams_b")
            keep = [similar(np.frombuffer(one[k].as_buffer(), np.uint64), np.frombuffer(two[k].as_buffer(), np.uint64), percent) for k in range(batch.num_rows)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = pairs.join(grams.select(F.col("node").alias("b"), F.col("grams").alias("grams_b")), "b")
    both = left.join(grams.select(F.col("node").alias("a"), F.col("grams").alias("grams_a")), "a")
    return settle(both.select("a", "b", "grams_a", "grams_b").mapInArrow(run, "a long, b long"), "verified")


def open_pairs(parts: DataFrame, nodes: DataFrame, bits: DataFrame, percent: int) -> DataFrame:
    """node_x, node_y of the pairs across components that share a bucket and are near by size and bits: each once, from the first band it shares.

    parts: key, band, node, root of open buckets; any bucket that a pair across components shares is open.
    """
    known = parts.join(nodes.select("node", "n"), "node").join(bits, "node")
    one, two = (known.select("key", *[F.col(c).alias(f"{c}_{side}") for c in ("band", "node", "root", "n", *BIT_WORDS, *BAND_WORDS)]) for side in "xy")
    apart = reduce(Column.__add__, [F.bit_count(F.col(f"{w}_x").bitwiseXOR(F.col(f"{w}_y"))) for w in BIT_WORDS])
    size = 100 * F.least("n_x", "n_y") >= percent * F.greatest("n_x", "n_y")
    first = reduce(lambda found, i: found.when(F.col(f"{BAND_WORDS[i]}_x") == F.col(f"{BAND_WORDS[i]}_y"), i), range(BANDS), F)
    near = (F.col("root_x") < F.col("root_y")) & size & (apart <= WIDE_APART) & (first == F.col("band_x"))
    return one.join(two, (one["key"] == two["key"]) & near).select("node_x", "node_y")


def links_of(nodes: DataFrame, docs: DataFrame, id_col: str, text_col: str, percent: int) -> DataFrame:
    """node, root of every linked node but the roots. nodes: node, doc_id, thash, n, signature."""
    keys = band_keys(nodes)
    buckets = keys.groupBy("key").agg(F.count("*").alias("held")).where("held > 1")
    shared = settle(keys.join(buckets, "key").select("key", "band", "node", "held"), "shared")
    # the text that a group's copies were made from shares the most bands with them: it is the centre that most of them are linked with
    weights = shared.groupBy("node").agg(F.sum("held").alias("weight"))
    weighted = shared.select("key", "node").join(weights, "node")
    hubs = weighted.groupBy("key").agg(F.max(F.struct("weight", (-F.col("node")).alias("m"))).alias("hub")).select("key", (-F.col("hub.m")).alias("centre"))
    members = settle(shared.select("key", "band", "node").join(hubs, "key"), "members")
    wanted = nodes.join(members.select("node").distinct(), "node").select("node", "doc_id", "thash")
    grams = shingle_sets(docs, wanted, id_col, text_col)
    sizes = nodes.select("node", "n", "signature")

    @F.pandas_udf("boolean")
    def alike(one: pd.Series, two: pd.Series) -> pd.Series:
        if not len(one):
            return pd.Series([], dtype=bool)
        x, y = (np.frombuffer(b"".join(s), np.uint16).reshape(len(s), -1) for s in (one, two))
        return pd.Series((x == y).sum(axis=1) >= AGREE)

    def likely(pairs: DataFrame) -> DataFrame:
        a, b = (sizes.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("signature").alias(f"s_{c}")) for c in "ab")
        near = (100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
        return pairs.join(a, "a").join(b, "b").where(near).where(alike("s_a", "s_b")).select("a", "b")

    def as_pairs(one: str, two: str):
        return F.least(one, two).alias("a"), F.greatest(one, two).alias("b")

    tried = settle(members.where("node != centre").select(*as_pairs("centre", "node")).distinct(), "pairs")
    found = verified(likely(tried), grams, percent)
    turn, before = 0, None
    while True:
        roots = components(found)
        labelled = members.select("key", "band", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        split = labelled.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low != high").select("key")
        parts = labelled.join(split, "key")
        parts = settle(parts, "open")
        counted = parts.groupBy("key", "root").count().groupBy("key").agg(F.sum("count").alias("s"), F.sum(F.col("count") * F.col("count")).alias("q"))
        nodes_open, pairs_open = counted.agg(F.sum("s"), F.sum((F.col("s") * F.col("s") - F.col("q")) / 2)).first()
        if not nodes_open:
            return roots
        if pairs_open <= OPEN_PAIRS * nodes_open or (before is not None and pairs_open > 0.9 * before):
            bits = wide_bits(grams.join(parts.select("node").distinct(), "node", "left_semi").join(nodes.select("node", "signature"), "node"))
            rest = open_pairs(parts, nodes, bits, percent).select(*as_pairs("node_x", "node_y")).join(tried, ["a", "b"], "left_anti")
            found = settle(found.union(verified(rest, grams, percent)), "found")
            return components(found)
        before, turn = pairs_open, turn + 1
        centres = parts.groupBy("key").agg(F.min_by(F.struct("node", "root"), F.xxhash64(F.lit(turn), "node")).alias("centre"))
        across = parts.join(centres, "key").where(F.col("root") != F.col("centre.root"))
        more = across.select(*as_pairs("centre.node", "node")).distinct().join(tried, ["a", "b"], "left_anti")
        more = settle(more, "pairs")
        found = settle(found.union(verified(likely(more), grams, percent)), "found")
        tried = tried.union(more)


def near_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """pos, doc_id, thash, n_shingles, component_id, kept for every row of df.

    Two rows are linked when 100 * intersection >= percent * union of their sets of five words in a row. Null and empty
    texts and texts without words have an empty set and are linked with nothing: each is its own component. A
    component's id is the smallest doc_id in it; a row is kept if that is its own. Null identifiers count as larger than
    any other. Rows that repeat a doc_id are rows of their own with the same id; an empty table gives no rows.
    """
    rows = sketches(df, id_col, text_col)
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "pos")
    sets = settle(rows.where("n > 0").groupBy("digest").agg(F.min(F.struct(order.alias("o"), "thash", "n", "signature")).alias("m")).select(
        "digest", F.col("m.o.pos").alias("node"), F.col("m.o.doc_id").alias("doc_id"), F.col("m.thash").alias("thash"),
        F.col("m.n").alias("n"), F.col("m.signature").alias("signature")), "sets")
    roots = links_of(sets.drop("digest"), df, id_col, text_col, percent)
    grouped = sets.select("digest", "node", "doc_id").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    smallest = grouped.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    of_set = grouped.join(smallest, "root").select("digest", "component_id")
    # a set of a third of all rows meets its component run by run
    runs = rows.withColumn("run", F.shiftright("pos", 33))
    of_run = runs.select("run", "digest").distinct().join(of_set, "digest", "left")
    done = runs.join(of_run, ["run", "digest"])
    own = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return done.select("pos", "doc_id", "thash", F.col("n").alias("n_shingles"), own.alias("component_id"), F.col("doc_id").eqNullSafe(own).alias("kept"))


def drop_near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """The rows of df of which one stays for each component, with their columns; of rows that repeat identifier and text, one."""
    kept = near_groups(df, id_col, text_col, percent).where("kept").select(F.col("doc_id").alias("kept_id"), F.col("thash").alias("kept_hash")).distinct()
    key, mark = free_name(df, "near_id"), free_name(df, "near_hash")
    marked = df.withColumn(key, F.col(id_col).cast("long")).withColumn(mark, F.xxhash64(whole_text(text_col)))
    found = marked.join(kept, marked[key].eqNullSafe(kept["kept_id"]) & (marked[mark] == kept["kept_hash"]), "left_semi")
    return found.dropDuplicates([key, mark]).select(*df.columns)


def op4_near(spark, folder: str) -> DataFrame:
    return near_groups(documents(spark, folder)).select("doc_id", "n_shingles", "component_id", "kept")


ORACLE = r"""
with recursive words as (
  select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
sets as (
  select doc_id, case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
    else list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) end as s from words),
items as (select doc_id, unnest(s) as x from sets),
common as (select a.doc_id as a, b.doc_id as b, count(*) as n from items a join items b on a.x = b.x and a.doc_id <> b.doc_id group by 1, 2),
links as (
  select a, b from common join sets p on p.doc_id = a join sets q on q.doc_id = b
  where 100 * n >= 75 * (len(p.s) + len(q.s) - n)),
reach as (select a, b from links union select r.a, l.b from reach r join links l on r.b = l.a)
select doc_id, len(s) as n_shingles, least(doc_id, coalesce((select min(b) from reach where a = doc_id), doc_id)) as component_id,
       doc_id = least(doc_id, coalesce((select min(b) from reach where a = doc_id), doc_id)) as kept
from sets
"""
