"""Hard negatives: for an anchor and each of its positives the best rows of other labels within a window of scores.

Fagin's threshold algorithm. Candidates come in blocks (one Arrow batch each, at most spark.sql.execution.arrow.maxRecordsPerBatch rows);
a block holds one sorted list of its rows per dimension. For an anchor the lists are read in step, from the top where its
component is positive and from the bottom where it is negative. Rows that turn up are scored by random access, in whole
numbers. The threshold, the score that the last entries read would add up to, bounds every row not seen yet; reading
stops once it is strictly below the k-th score of each window (or below the window itself), so ties are never missed. A task carries each
window's best scores from block to block, so later blocks stop earlier.

Anchors are a fraction of all rows, so they grow with the table: they are sent to the tasks in slices of at most
SLICE_BYTES, one pass over the candidates for each. A task returns at most k rows per window; the best of all tasks are taken by rank.
First pass: the positives (same label). Second pass: the windows that their scores span.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colscope.llm.common import documents, settle
from colscope.llm.vectors import largest, list_column, matrix, sound_vector

SCALE = 256
#: Anchors of one pass: so many bytes of 64-bit components at most.
SLICE_BYTES = 32 << 20
#: First depth of sorted access as a part of the block; it doubles from round to round.
FIRST = 256
#: Stands for a null identifier, which comes last among equal scores.
NO_ID = 2 ** 63 - 1
#: Ends of the score column; a score beyond them is given as the end.
LONG = 2 ** 63 - 1


@dataclass
class Anchors:
    """A slice of anchors: identifiers, labels, scaled vectors, and per anchor its windows as (place, low, high)."""

    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    windows: list[list[tuple[int, int | None, int | None]]]


def exact(a: np.ndarray, bound: int) -> np.ndarray:
    """The same whole numbers in the narrowest type whose sums of products up to `bound` are exact."""
    if bound < 2 ** 24:
        return a.astype(np.float32)
    return a.astype(np.float64) if bound < 2 ** 53 else a.astype(object)


class Block:
    """Rows of one batch with a sorted list per dimension."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, anchors: Anchors):
        bound = max(1, x.shape[1]) * largest(x) * largest(anchors.vectors)
        self.ids, self.labels, self.n = ids, labels, len(ids)
        self.x, self.a = exact(x, bound), exact(anchors.vectors, bound)
        self.order = np.argsort(x, axis=0, kind="stable").T  # ascending, one list per dimension
        listed = np.take_along_axis(x.T, self.order, axis=1)
        depth, self.depths = max(1, self.n // FIRST), []
        while depth < self.n:
            self.depths.append(depth)
            depth *= 2
        self.depths.append(self.n)
        low = exact(listed[:, [d - 1 for d in self.depths]], bound)
        high = exact(listed[:, [self.n - d for d in self.depths]], bound)
        #: thresholds[anchor, round]: what the last entries read of all lists add up to
        self.thresholds = np.maximum(self.a, 0) @ high + np.minimum(self.a, 0) @ low

    def rounds(self, i: int) -> Iterator[tuple[np.ndarray, float]]:
        """Rows that turn up in each round of sorted access for anchor i, and the threshold after it."""
        a = self.a[i]
        up, down = np.flatnonzero(a > 0), np.flatnonzero(a < 0)
        seen, before = np.zeros(self.n, bool), 0
        for r, depth in enumerate(self.depths):
            turned = np.zeros(self.n, bool)
            turned[self.order[up, self.n - depth: self.n - before]] = True
            turned[self.order[down, before: depth]] = True
            if depth == self.n:
                turned[:] = True  # lists of weight 0 are never read; the last round leaves no row out
            turned &= ~seen
            seen |= turned
            before = depth
            yield turned, self.thresholds[i, r]


def best_of(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best by score, then smaller identifier."""
    if len(scores) > 4 * k:
        keep = scores >= np.partition(scores, len(scores) - k)[len(scores) - k]
        scores, ids = scores[keep], ids[keep]
    order = np.lexsort((ids, -scores))[:k]
    return scores[order], ids[order]


def threshold_search(block: Block, anchors: Anchors, i: int, same: bool, k: int, best: list) -> None:
    """Carry the k best of each of anchor i's windows (`best`, a pair of arrays or None each) over one block."""
    allowed = (block.labels == anchors.labels[i]) == same
    if same:
        allowed &= block.ids != anchors.ids[i]
    windows = anchors.windows[i]
    for turned, threshold in block.rounds(i):
        rows = np.flatnonzero(turned & allowed)
        scores = block.x[rows] @ block.a[i]
        ids = block.ids[rows]
        open_windows = False
        for j, (_, low, high) in enumerate(windows):
            fits = np.ones(len(scores), bool) if high is None else (scores <= high) & (scores >= low)
            if best[j] is not None and len(best[j][0]) == k:
                fits &= scores >= best[j][0][-1]
            if fits.any():
                found, names = scores[fits], ids[fits]
                if best[j] is not None:
                    found, names = np.concatenate((found, best[j][0])), np.concatenate((names, best[j][1]))
                best[j] = best_of(found, names, k)
            full = best[j] is not None and len(best[j][0]) == k
            if not (full and threshold < best[j][0][-1] or low is not None and threshold < low):
                open_windows = True
        if not open_windows:
            return


def search(rows: DataFrame, anchors: Anchors, same: bool, k: int) -> DataFrame:
    """(anchor_id, place, other_id, score): per window and task the k best rows."""
    sent = rows.sparkSession.sparkContext.broadcast(anchors)
    shape = pa.schema([("anchor_id", pa.int64()), ("place", pa.int32()), ("other_id", pa.int64()), ("score", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = sent.value
        best = [[None] * len(w) for w in wanted.windows]
        for b in batches:
            if not b.num_rows:
                continue
            ids = b.column("vec_id").to_numpy(zero_copy_only=False)
            block = Block(ids, b.column("label").to_numpy(zero_copy_only=False), matrix(b.column("vector"), SCALE, wanted.vectors.shape[1]), wanted)
            for i in range(len(wanted.ids)):
                if wanted.windows[i]:
                    threshold_search(block, wanted, i, same, k, best[i])
        out = [(int(wanted.ids[i]), w[0], int(name), max(-LONG, min(LONG, int(score))))
               for i, found in enumerate(best) for w, pair in zip(wanted.windows[i], found) if pair is not None for score, name in zip(*pair)]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out) if out else [[]] * 4, shape)], schema=shape)

    return rows.mapInArrow(run, "anchor_id long, place int, other_id long, score long")


def ranked(df: DataFrame, keys: list[str], k: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.desc("score"), "other_id")
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def sound_rows(df: DataFrame, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, label, vector) of the rows that take part; a null identifier becomes NO_ID."""
    return df.where(F.col(label_col).isNotNull() & sound_vector(vector_col)).select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("vec_id"), F.col(label_col).cast("long").alias("label"), list_column(df, vector_col).alias("vector"))


def mine(rows: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 3, window: tuple[int, int] = (50, 95)) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for every anchor.

    rows and anchors: (vec_id, label, vector) as of sound_rows. An anchor's own identifier is no other row; of anchors with the same
    identifier the one of the smallest label, then vector, counts. Other rows that share an identifier all count. `window`: a negative's score in per cent
    of the positive's. Vectors of another length than the anchor's end in zeros.
    """
    spark = rows.sparkSession
    rows = settle(rows, "candidates")
    single = anchors.groupBy("vec_id").agg(F.min(F.struct("label", "vector")).alias("m")).select("vec_id", "m.label", "m.vector")
    single = settle(single, "anchors")
    size = single.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vector")).alias("width")).first()
    width = size["width"] or 0
    slices = max(1, -(-size["n"] * 8 * max(1, width) // SLICE_BYTES))
    single = single.withColumn("slice", F.pmod(F.xxhash64("vec_id"), F.lit(slices)))

    def slice_of(number: int, windows: DataFrame | None) -> Anchors:
        part = single.where(F.col("slice") == number)
        if windows is not None:
            part = part.join(windows, part["vec_id"] == windows["anchor_id"]).drop("anchor_id")
        # a slice: at most about SLICE_BYTES
        t = part.orderBy("vec_id").toArrow().combine_chunks()
        low, high = window
        spans = [[(0, None, None)]] * t.num_rows if windows is None else [
            [(w["place"], -(-low * w["score"] // 100), high * w["score"] // 100) for w in sorted(row, key=lambda w: w["place"])] for row in t.column("windows").to_pylist()]
        vector = t.column("vector")
        vector = vector.combine_chunks() if isinstance(vector, pa.ChunkedArray) else vector
        return Anchors(t.column("vec_id").to_numpy(), t.column("label").to_numpy(), matrix(vector, SCALE, width), spans)

    def all_slices(same: bool, k: int, windows: DataFrame | None = None) -> DataFrame:
        return reduce(DataFrame.unionAll, [search(rows, slice_of(s, windows), same, k) for s in range(slices)])

    first = ranked(all_slices(True, positives), ["anchor_id"], positives)
    chosen = settle(first.select("anchor_id", F.col("rank").alias("place"), F.col("other_id").alias("positive_id"), "score"), "positives")
    windows = chosen.groupBy("anchor_id").agg(F.collect_list(F.struct("place", "score")).alias("windows"))  # at most `positives` each
    second = ranked(all_slices(False, negatives, windows), ["anchor_id", "place"], negatives)
    named = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return second.withColumnsRenamed({"other_id": "negative_id", "score": "negative_score"}).join(
        chosen.withColumnRenamed("score", "positive_score"), ["anchor_id", "place"]).select(
        "anchor_id", named("positive_id").alias("positive_id"), "rank", named("negative_id").alias("negative_id"), "positive_score", "negative_score")


def op12_negatives(spark, folder: str) -> DataFrame:
    """Hard negatives of embeddings: anchors are the rows whose vec_id is divisible by 50.

    Null labels and unsound vectors take no part; rows with a null vec_id can be positives and negatives, last among equals; an
    empty table, or one without anchors, gives an empty result. Anchors without positives, and positives without a row in their window, give none.
    """
    rows = sound_rows(documents(spark, folder, "embeddings"))
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = rows.withColumn("label", F.when(F.col("vec_id") == NO_ID, F.col("label")).otherwise(moved))
    return mine(rows, rows.where((F.col("vec_id") % 50 == 0) & (F.col("vec_id") != NO_ID)))


ORACLE = """
WITH e AS MATERIALIZED (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, e.vec_id AS other_id, a.label = e.label AS same, list_inner_product(a.v, e.v)::BIGINT AS score
  FROM e a JOIN e ON a.vec_id <> e.vec_id WHERE a.vec_id % 50 = 0),
p AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5),
n AS (
  SELECT p.anchor_id, positive_id, other_id AS negative_id, positive_score, score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other_id) AS rank
  FROM p JOIN s ON p.anchor_id = s.anchor_id
  WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score)
SELECT anchor_id, positive_id, rank::INT AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""
