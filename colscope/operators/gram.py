"""Sums of all column pairs in one read: over the whole table, inside groups, and above each column's median (ST4, ST10, ST14).

Each task turns its Arrow batches into matrices (presence, shifted values, squares) and adds up their products, so pairwise
deletion costs no more than complete data. What leaves a task is tiles: the sums of TILE x TILE column pairs as one binary
value, keyed by (kind, by, value, bi, bj), so 2,000 columns leave some hundred rows rather than two million. Tiles of one key are added
as a stream of sorted rows; a task of that step holds one tile, however many tasks fed it.

The matrices of a task stay under PASS_BYTES. Where columns times levels need more, the table is read once for every band of
columns that fits; rows and scan parallelism are the same at any width.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colscope.functions import numeric as N
from colscope.functions.session import local_table
from colscope.operators.longform import ColumnInfo, by_position, pos

TILE = 64
PASS_BYTES = 256 << 20
#: Cells of a batch that are turned into matrices at a time.
CELLS = 1 << 21
SUMS = ("n", "inf", "sx", "sy", "sxx", "syy", "sxy")
#: Kinds that hold every ordered pair: rows at or above, and below, the median of the first.
SIDES = ("high", "low")
SUMS_DDL = "kind string, by int, value string, i int, j int, " + ", ".join(f"{s} double" for s in SUMS)
_TILES = pa.schema([("kind", pa.string()), ("by", pa.int32()), ("value", pa.string()), ("bi", pa.int32()), ("bj", pa.int32()), ("tile", pa.binary())])
_TILES_DDL = "kind string, by int, value string, bi int, bj int, tile binary"
_KEYS = ["kind", "by", "value", "bi", "bj"]


class _Sums:
    """The seven sums of a band of columns (rows) with all columns; SUMS order."""

    def __init__(self, rows: int, columns: int):
        self.m = np.zeros((len(SUMS), rows, columns))

    def add(self, x: tuple, y: tuple) -> None:
        """x, y: presence, shifted values, squares and infinity of the band and of all columns; x counts only where its presence is 1."""
        here_x, z_x, q_x, inf_x = x
        here_y, z_y, q_y, inf_y = y
        self.m[0] += here_x.T @ here_y
        if inf_x is not None:
            self.m[1] += inf_x.T @ here_y + here_x.T @ inf_y
        self.m[2] += z_x.T @ here_y
        self.m[3] += here_x.T @ z_y
        self.m[4] += q_x.T @ here_y
        self.m[5] += here_x.T @ q_y
        self.m[6] += z_x.T @ z_y


def _bands(p: int, levels: int) -> list[tuple[int, int]]:
    """Bands of whole tiles whose sums on all levels stay under PASS_BYTES (one tile at least)."""
    tiles = -(-p // TILE)
    each = max(1, PASS_BYTES // (levels * len(SUMS) * 8 * TILE * max(1, p)))
    return [(a * TILE, min(p, (a + each) * TILE)) for a in range(0, tiles, each)]


def _tiles_of(wide: DataFrame, p: int, band: tuple[int, int], by: list[int], shift: np.ndarray, high: np.ndarray | None) -> DataFrame:
    first, last = band

    def parts(z, q, here, infinite, rows=slice(None), mask=None):
        """Matrices of some rows; a mask takes cells of the band out."""
        def band_of(a):
            b = a[rows][:, first:last]
            return b if mask is None else b * mask[rows][:, first:last]

        return ((band_of(here), band_of(z), band_of(q), None if infinite is None else band_of(infinite)),
                (here[rows], z[rows], q[rows], None if infinite is None else infinite[rows]))

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc: dict[tuple, _Sums] = {}

        def level(*key) -> _Sums:
            if key not in acc:
                acc[key] = _Sums(last - first, p)
            return acc[key]

        for batch in batches:
            step = max(64, CELLS // max(1, p))
            for start in range(0, batch.num_rows, step):
                part = batch.slice(start, step)
                x = np.column_stack([part.column(k).to_numpy(zero_copy_only=False).astype("float64") for k in range(p)])
                inf = np.isinf(x)
                present = ~np.isnan(x)
                z = np.where(present & ~inf, x - shift, 0.0)
                here = present.astype("float64")
                infinite = inf.astype("float64") if inf.any() else None
                q = z * z
                level("pair", -1, "").add(*parts(z, q, here, infinite))
                if high is not None:
                    above = np.where(present, x, -np.inf) >= high
                    for side, cells in (("high", present & above), ("low", present & ~above)):
                        level(side, -1, "").add(*parts(z, q, here, infinite, mask=cells.astype("float64")))
                for k, ordinal in enumerate(by):
                    codes = part.column(p + k).dictionary_encode()
                    at = codes.indices.to_numpy(zero_copy_only=False)
                    for code, value in enumerate(codes.dictionary.to_pylist()):
                        level("group", ordinal, value).add(*parts(z, q, here, infinite, np.flatnonzero(at == code)))
        rows = []
        for (kind, ordinal, value), sums in acc.items():
            for a in range(first, last, TILE):
                # the other half of a symmetric matrix is the same pairs again
                for b in range(0 if kind in SIDES else a, p, TILE):
                    rows.append((kind, ordinal, value, a // TILE, b // TILE, sums.m[:, a - first: a - first + TILE, b: b + TILE].tobytes()))
        for row in rows:
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, _TILES)], schema=_TILES)

    return wide.mapInArrow(products, _TILES_DDL)


def _added(tiles: DataFrame, p: int) -> DataFrame:
    """One row per pair: equal keys, which come one after the other, are added."""
    shape = pa.schema([("kind", pa.string()), ("by", pa.int32()), ("value", pa.string()), ("i", pa.int32()), ("j", pa.int32()),
                       *[(s, pa.float64()) for s in SUMS]])

    def pairs(key, m) -> pa.RecordBatch:
        kind, by, value, bi, bj = key
        i, j = np.meshgrid(np.arange(m.shape[1]) + bi * TILE, np.arange(m.shape[2]) + bj * TILE, indexing="ij")
        keep = i != j if kind in SIDES else i < j
        n = int(keep.sum())
        return pa.RecordBatch.from_arrays([pa.array([kind] * n, pa.string()), pa.array([by] * n, pa.int32()), pa.array([value] * n, pa.string()),
                                           pa.array(i[keep].astype("int32")), pa.array(j[keep].astype("int32")), *[pa.array(a[keep]) for a in m]], schema=shape)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, total = None, None
        for b in batches:
            for row in b.to_pylist():
                key = tuple(row[k] for k in _KEYS)
                rows, columns = min(TILE, p - row["bi"] * TILE), min(TILE, p - row["bj"] * TILE)
                m = np.frombuffer(row["tile"]).reshape(len(SUMS), rows, columns)
                if key == current:
                    total = total + m
                    continue
                if current is not None:
                    yield pairs(current, total)
                current, total = key, m
        if current is not None:
            yield pairs(current, total)

    return tiles.repartition(*_KEYS).sortWithinPartitions(*_KEYS).mapInArrow(run, SUMS_DDL)


def gram_sums(df: DataFrame, cols: list[ColumnInfo], centers: dict[int, float] | None = None, by: list[tuple[ColumnInfo, int]] = (),
              medians: dict[int, float] | None = None) -> DataFrame:
    """(kind, by, value, i, j, SUMS): i and j are ordinals of the table.

    kind `pair`: i < j over all rows where both are present. kind `group`, one for each value of each column of `by` (given with
    its number of different values, which bounds the memory): the same inside the group; rows without a value are in none. kinds `high` and `low`,
    with `medians`: every ordered pair over the rows where i is at or above, and below, its median (each summed by itself, as one outlier
    on one side would swallow the digits of the other in a difference). Values are shifted by `centers`.
    """
    spark, p = df.sparkSession, len(cols)
    if p < 2:
        return local_table(spark, [], SUMS_DDL)
    shift = np.array([float((centers or {}).get(c.ordinal) or 0.0) for c in cols])
    high = None if medians is None else np.array([np.inf if medians.get(c.ordinal) is None else float(medians[c.ordinal]) for c in cols])
    wide = by_position(df).select(*[N.as_double(pos(c), c.dtype).alias(f"c{c.ordinal}") for c in cols],
                                  *[pos(c).cast("string").alias(f"g{c.ordinal}") for c, _ in by])
    levels = 1 + 2 * (high is not None) + sum(n for _, n in by)
    parts = [_tiles_of(wide, p, band, [c.ordinal for c, _ in by], shift, high) for band in _bands(p, levels)]
    sums = _added(reduce(DataFrame.unionAll, parts), p)
    ordinals = F.array(*[F.lit(c.ordinal) for c in cols])
    return sums.withColumns({"i": ordinals[F.col("i")], "j": ordinals[F.col("j")]})


# ---------------------------------------------------------------- what follows from the sums


def _n() -> Column:
    return F.nullif(F.col("n"), F.lit(0.0))


def central(xx: str, x: str, y: str | None = None) -> Column:
    """Sum of squares (or products) about the mean."""
    return F.col(xx) - F.col(x) * F.col(y or x) / _n()


def pearson() -> Column:
    """Pearson r; null when undefined. A spread below rounding noise counts as none."""
    vx, vy, cov = central("sxx", "sx"), central("syy", "sy"), central("sxy", "sx", "sy")
    spread = (vx > F.col("sxx") * 1e-13) & (vy > F.col("syy") * 1e-13)
    r = cov / F.nullif(F.sqrt(F.greatest(vx, F.lit(0.0))) * F.sqrt(F.greatest(vy, F.lit(0.0))), F.lit(0.0))
    return F.when((F.col("n") >= 3) & (F.col("inf") == 0) & spread, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r)))


def group_correlations(sums: DataFrame) -> DataFrame:
    """(i, j, by, value, n, group_r, overall_r): every pair inside every group, beside its overall correlation."""
    inside = sums.where("kind = 'group'").select("i", "j", "by", "value", F.col("n").cast("bigint").alias("n"), pearson().alias("group_r"))
    whole = sums.where("kind = 'pair'").select("i", "j", pearson().alias("overall_r"))
    return inside.join(whole, ["i", "j"])


#: Residual variance below this part of the variance of y is rounding noise: sums of squares carry some 14 digits.
NOISE = 1e-10


def residual_spreads(sums: DataFrame) -> DataFrame:
    """(i, j, n, n_low, n_high, ratio) of every ordered pair: residual variance of j's trend on i, at or above i's median over below it.

    The line is that of all rows where both are present. Null ratio: no line (under 30 rows, no spread, infinities), an empty side, or
    residuals that are rounding noise on both sides.
    """
    whole = sums.where("kind = 'pair'").select("i", "j", *SUMS)
    turned = whole.select(F.col("j").alias("i"), F.col("i").alias("j"), "n", "inf", F.col("sy").alias("sx"), F.col("sx").alias("sy"),
                          F.col("syy").alias("sxx"), F.col("sxx").alias("syy"), "sxy")
    vx, vy = central("sxx", "sx"), central("syy", "sy")
    line = (F.col("n") >= 30) & (F.col("inf") == 0) & (vx > F.col("sxx") * 1e-13)
    fit = whole.unionByName(turned).select("i", "j", F.col("n").cast("bigint").alias("n_both"), F.when(line, central("sxy", "sx", "sy") / vx).alias("slope"), (vy / _n()).alias("total"))
    b = F.col("slope")
    residual = F.greatest((vy - 2 * b * central("sxy", "sx", "sy") + b * b * vx) / _n(), F.lit(0.0))
    each = sums.where(F.col("kind").isin(*SIDES)).join(fit, ["i", "j"]).select("i", "j", "n_both", "total", "kind", "n", residual.alias("v"))
    at = lambda side, c: F.max(F.when(F.col("kind") == side, F.col(c)))
    both = each.groupBy("i", "j").agg(F.first("n_both").alias("n"), F.first("total").alias("total"), at("low", "n").cast("bigint").alias("n_low"),
                                      at("high", "n").cast("bigint").alias("n_high"), at("low", "v").alias("v_low"), at("high", "v").alias("v_high"))
    return both.select("i", "j", "n", "n_low", "n_high",
                       F.when((F.greatest("v_high", "v_low") > NOISE * F.col("total")) & (F.col("n_low") > 0) & (F.col("n_high") > 0),
                              F.col("v_high") / (F.col("v_low") + 1e-10)).alias("ratio"))
