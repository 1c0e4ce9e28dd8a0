"""Vector codes: each of four parts of a vector is named by its nearest codebook entry.

Slice and intersect. For every dimension of a part the codebook's coordinates are sorted, and a bit mask of the entries stands beside
each sorted place: the entries up to there. A radius cuts a range out of each dimension, which is the difference of
two such masks; the masks of all dimensions, ANDed as 64-bit words, leave the entries inside the box. Any entry within the radius lies in the box,
so once the best of the box is no farther than the radius it is the nearest of all, and ties are complete. Vectors whose box holds none that near are
looked up again, with the best distance found as radius, or twice the radius where the box was empty.

Learning. Each round is one pass: tasks look up their rows, add up parts per entry, and the sums (a row per part, entry and
position, at most 256 times the number of dimensions) come to the driver, which makes the next codebooks. All sums are whole numbers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colscope.llm.common import documents, settle
from colscope.llm.vectors import largest, list_column, matrix, sound_vector

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
#: Rows looked up at a time: their candidate differences are at most AT_ONCE x 256 x (dimensions of a part) numbers.
AT_ONCE = 512
#: Salts of the join with the sums per label, so that a label of a third of all rows is many keys.
SALTS = 32
LONG = 2 ** 63 - 1


class Slices:
    """Masks over one part's codebook (entries x dimensions, whole numbers)."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        k, d = entries.shape
        words = -(-k // 64)
        order = np.argsort(entries, axis=0, kind="stable")
        self.sorted = [np.ascontiguousarray(entries[order[:, j], j]) for j in range(d)]
        bit = np.zeros((k, words), np.uint64)
        bit[np.arange(k), np.arange(k) // 64] = np.left_shift(np.uint64(1), (np.arange(k) % 64).astype(np.uint64))
        #: prefix[j][i]: the first i entries in the order of dimension j
        self.prefix = [np.vstack((np.zeros((1, words), np.uint64), np.bitwise_or.accumulate(bit[order[:, j]], axis=0))) for j in range(d)]
        self.words = words
        self.radius = self.usual_radius()

    def usual_radius(self) -> int:
        """The median distance of an entry from its nearest other one, at least 1: where the search begins. It changes no result."""
        e = self.entries.astype(np.float64)
        if len(e) < 2:
            return 1
        squares = (e ** 2).sum(1)
        d2 = squares[:, None] + squares[None, :] - 2 * e @ e.T
        np.fill_diagonal(d2, np.inf)
        return max(1, int(min(np.sqrt(np.maximum(np.median(d2.min(1)), 0)), 2.0 ** 61)))

    def box(self, x: np.ndarray, radius: np.ndarray) -> np.ndarray:
        """Masks (rows x words) of the entries whose every coordinate is within the row's radius."""
        mask = np.full((len(x), self.words), ~np.uint64(0))
        for j, (values, prefix) in enumerate(zip(self.sorted, self.prefix)):
            low = np.searchsorted(values, x[:, j] - radius, "left")
            high = np.searchsorted(values, x[:, j] + radius, "right")
            mask &= prefix[high] & ~prefix[low]
        return mask

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry, squared distance) of every row: the nearest entry, of equally near ones the lowest."""
        k, d = self.entries.shape
        if not d:
            return np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
        span = largest(x) + largest(self.entries)
        wide = d * span * span * (k + 1) >= 2 ** 62  # then in Python's whole numbers
        number = object if wide else np.int64
        rows, entries = x.astype(number), self.entries.astype(number)
        entry, distance = np.zeros(len(x), np.int64), np.zeros(len(x), number)
        for start in range(0, len(x), AT_ONCE):
            left = np.arange(start, min(start + AT_ONCE, len(x)))
            radius = np.full(len(left), self.radius, np.int64)
            while len(left):
                bits = np.unpackbits(self.box(x[left], radius).view(np.uint8), axis=1, bitorder="little")[:, :k]
                row, candidate = np.nonzero(bits)
                found = np.zeros(len(left), bool)
                at = left[row]
                d2 = ((rows[at] - entries[candidate]) ** 2).sum(1)
                key = d2 * k + candidate
                if len(row):
                    first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
                    least = np.minimum.reduceat(key, first)
                    who = row[first]
                    entry[left[who]] = (least % k).astype(np.int64)
                    distance[left[who]] = least // k
                    found[who] = True
                settled = found & np.array(distance[left].astype(object) <= radius.astype(object) ** 2, bool)
                again = ~settled
                # a box around the best so far holds all that are as near; an empty box is doubled
                root = np.ceil(np.sqrt(distance[left].astype(np.float64))) + 1
                radius = np.minimum(np.where(found, root, 2.0 * radius), 2.0 ** 61).astype(np.int64)[again]
                left = left[again]
        return entry, distance


def parts_of(width: int) -> list[slice]:
    """Four consecutive parts, equal where the width allows it, else the first ones longer by one."""
    ends = np.cumsum([0, *(len(p) for p in np.array_split(np.arange(width), PARTS))])
    return [slice(int(a), int(b)) for a, b in zip(ends, ends[1:])]


def sound_rows(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, label, vector) of the rows whose vector is whole and finite."""
    return df.where(sound_vector(vector_col)).select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), list_column(df, vector_col).alias("vector"))


def first_codebooks(rows: DataFrame, width: int) -> list[np.ndarray]:
    """The parts of the rows with the smallest identifiers; null ones come last, equal ones go by their vector."""
    t = rows.orderBy(F.asc_nulls_last("vec_id"), "vector").limit(ENTRIES).select("vector").toArrow().combine_chunks()
    vector = t.column("vector")
    x = matrix(vector.combine_chunks() if isinstance(vector, pa.ChunkedArray) else vector, SCALE, width)
    return [x[:, p] for p in parts_of(width)]


def learn(rows: DataFrame, width: int, rounds: int = ROUNDS) -> list[np.ndarray]:
    """The codebooks after so many rounds."""
    books = first_codebooks(rows, width)
    parts = parts_of(width)
    shape = pa.schema([("part", pa.int32()), ("entry", pa.int32()), ("place", pa.int32()), ("n", pa.int64()), ("total", pa.int64())])
    for _ in range(rounds):
        sent = rows.sparkSession.sparkContext.broadcast(books)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            slices = [Slices(b) for b in sent.value]
            for b in batches:
                if not b.num_rows:
                    continue
                x = matrix(b.column("vector"), SCALE, width)
                for number, (p, s) in enumerate(zip(parts, slices)):
                    entry, _ = s.nearest(x[:, p])
                    order = np.argsort(entry, kind="stable")
                    which, first, n = np.unique(entry[order], return_index=True, return_counts=True)
                    # per batch, so a sum of 64 bits holds 10,000 rows of the largest components
                    total = np.add.reduceat(x[order, p], first, axis=0)
                    d = total.shape[1]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(which) * d, number, np.int32)), pa.array(np.repeat(which, d).astype(np.int32)),
                        pa.array(np.tile(np.arange(d, dtype=np.int32), len(which))), pa.array(np.repeat(n, d)), pa.array(total.ravel())], schema=shape)

        sums = rows.mapInArrow(run, "part int, entry int, place int, n long, total long").groupBy("part", "entry", "place").agg(
            F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(20,0)")).alias("total"))
        books = [b.copy() for b in books]
        for r in sums.collect():  # at most 256 x width rows
            books[r["part"]][r["entry"], r["place"]] = int(r["total"]) // r["n"]
    return books


def encode(rows: DataFrame, books: list[np.ndarray], width: int) -> DataFrame:
    """(vec_id, label, code, error): two hexadecimal digits per part, and the squared distances added up."""
    parts = parts_of(width)
    sent = rows.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slices = [Slices(b) for b in sent.value]
        for b in batches:
            if not b.num_rows:
                continue
            x = matrix(b.column("vector"), SCALE, width)
            found = [s.nearest(x[:, p]) for p, s in zip(parts, slices)]
            codes = np.column_stack([e for e, _ in found]).astype(np.uint8)
            error = [min(LONG, e) for e in sum(d.astype(object) for _, d in found)]
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), pa.array([c.tobytes().hex() for c in codes]), pa.array(error, pa.int64())],
                                             names=["vec_id", "label", "code", "error"])

    return rows.mapInArrow(run, f"vec_id long, label {rows.schema['label'].dataType.simpleString()}, code string, error long")


def digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(int(v)) for b in books for v in b.ravel()).encode()).hexdigest()


def with_label_error(coded: DataFrame) -> DataFrame:
    """coded with label_error, the errors of equal labels added up; nulls are one label."""
    spark = coded.sparkSession
    sums = coded.groupBy("label").agg(F.least(F.sum(F.col("error").cast("decimal(20,0)")), F.lit(LONG).cast("decimal(38,0)")).cast("long").alias("label_error"))
    salted = sums.select(F.col("label").alias("of"), "label_error", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt_of"))
    left = coded.withColumn("salt", F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)).cast("int"))
    return left.join(salted, F.col("label").eqNullSafe(F.col("of")) & (F.col("salt") == F.col("salt_of"))).drop("of", "salt", "salt_of")


def compress(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, list[np.ndarray]]:
    """(vec_id, label, code, error, label_error) of the sound rows, and the final codebooks.

    The width is that of the longest vector; shorter ones end in zeros. Repeated rows each count. With fewer than 256 rows a codebook
    has as many entries. An empty table gives an empty result and empty codebooks.
    """
    rows = settle(sound_rows(df, id_col, vector_col, label_col), "vectors")
    width = rows.agg(F.max(F.size("vector"))).first()[0] or 0
    books = learn(rows, width)
    coded = settle(encode(rows, books, width), "codes")
    return with_label_error(coded), books


def op13_codes(spark, folder: str) -> DataFrame:
    """Codes of embeddings. Rows with a null vec_id are coded like others; null labels are one label."""
    coded, books = compress(documents(spark, folder, "embeddings"))
    return coded.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _oracle() -> str:
    """DuckDB SQL: plain distances to all entries, round by round."""
    steps = ["""e AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS c FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
             """v AS MATERIALIZED (SELECT vec_id, p, list_slice(c, p * (len(c) // 4) + 1, (p + 1) * (len(c) // 4)) AS x FROM e, range(4) t(p))""",
             """b0 AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS k, x AS y FROM v
  QUALIFY row_number() OVER (PARTITION BY p ORDER BY vec_id) <= 256)"""]
    for r in range(ROUNDS + 1):
        steps.append(f"""a{r} AS MATERIALIZED (SELECT vec_id, v.p, any_value(x) AS x,
  min({{'d': list_inner_product(x, x) - 2 * list_inner_product(x, y) + list_inner_product(y, y), 'k': k}}) AS m
  FROM v JOIN b{r} b ON v.p = b.p GROUP BY vec_id, v.p)""")
        if r < ROUNDS:
            steps.append(f"""u{r} AS (SELECT p, k, list(z ORDER BY i) AS y FROM (SELECT p, m.k AS k, i, floor(sum(x[i]) / count(*)) AS z
  FROM a{r}, LATERAL (SELECT unnest(range(1, len(x) + 1)) AS i) GROUP BY ALL) GROUP BY p, k)""")
            steps.append(f"""b{r + 1} AS MATERIALIZED (SELECT b.p, b.k, coalesce(u.y, b.y) AS y FROM b{r} b LEFT JOIN u{r} u ON b.p = u.p AND b.k = u.k)""")
    return "WITH " + ",\n".join(steps) + f""",
h AS (SELECT sha256(string_agg(z::BIGINT::VARCHAR, ',' ORDER BY p, k, i)) AS s FROM (SELECT p, k, unnest(y) AS z, unnest(range(1, len(y) + 1)) AS i FROM b{ROUNDS})),
f AS (SELECT vec_id, string_agg(printf('%02x', m.k), '' ORDER BY p) AS code, sum(m.d)::BIGINT AS error FROM a{ROUNDS} GROUP BY vec_id)
SELECT f.vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, s AS codebooks_sha256
FROM f JOIN e ON f.vec_id = e.vec_id, h"""


ORACLE = _oracle()
