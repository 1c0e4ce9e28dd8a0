"""Exact order statistics without sorting a table.

Sketches bracket every wanted rank of every column in one aggregation; a second one counts the rows
below and inside each bracket. A bracket that still holds more than SPAN_ROWS rows is narrowed
again (each pass keeps a few ten-thousandths of the rows), so what is finally ordered has a checked
bound, whatever the size of the table or the weight of a single value.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colscope.functions.session import local_table
from colscope.operators.longform import ColumnInfo, columns_of, long_numeric

ACCURACY = 10_000
SPAN_ROWS = 1_000_000
QUANTILE_SCHEMA = "dataset string, ordinal int, name string, q double, nn bigint, value double"


def nearest_rank(q: float, nn: int) -> int:
    """0-based rank q*(nn-1), halves rounded up."""
    return int(math.floor(q * (nn - 1) + 0.5))


@dataclass(frozen=True)
class Span:
    """Open interval of values known to hold a wanted rank; None means unbounded."""

    lo: float | None
    hi: float | None
    below: int  # rows at or under lo
    rows: int  # rows strictly inside


def select_ranks(long: DataFrame, ranks_of, sizes: dict[str, int] | None = None) -> dict[tuple[str, str], tuple[int, float]]:
    """Values at exact ranks of each column of a long (o, v) table.

    `ranks_of(nn)` maps a non-null count to {tag: 0-based rank}. Returns {(o, tag): (nn, value)}.
    Only counts and bounds (a few numbers per column) come back to the driver. Non-null counts that
    are known already (`sizes`) save one pass.
    """
    if sizes is None:
        sizes = {r["o"]: r["nn"] for r in long.groupBy("o").agg(F.count("v").alias("nn")).collect()}
    sizes = {o: nn for o, nn in sizes.items() if nn > 0}
    ranks = {(o, tag): rank for o, nn in sizes.items() for tag, rank in ranks_of(nn).items()}
    spans = {k: Span(None, None, 0, sizes[k[0]]) for k in ranks}
    values: dict[tuple[str, str], float] = {}
    while wide := {k: s for k, s in spans.items() if s.rows > SPAN_ROWS}:
        for k, step in _narrow(long, wide, ranks).items():
            if isinstance(step, Span):
                spans[k] = step
            else:
                values[k] = step
                del spans[k]
    if spans:
        values |= _pick(long, spans, ranks)
    return {k: (sizes[k[0]], v) for k, v in values.items()}


def _inside(long: DataFrame, spans: DataFrame) -> DataFrame:
    """Rows of the long table that lie in a span; the span table is one row per wanted rank."""
    lo, hi, v = F.col("lo"), F.col("hi"), F.col("v")
    return long.join(F.broadcast(spans), "o").where(
        v.isNotNull() & (lo.isNull() | (v > lo)) & (hi.isNull() | (v < hi))
    )


def _table(long: DataFrame, rows, schema: str) -> DataFrame:
    return local_table(long.sparkSession, rows, schema)


def _narrow(long, wide, ranks):
    """A sketch pass for bounds around each rank, then a counting pass that proves them.

    Every step leaves a span that holds a few ten-thousandths of the rows it had.
    """
    eps = 2.0 / ACCURACY
    around = {}
    for k, s in wide.items():
        p = (ranks[k] - s.below) / max(s.rows - 1, 1)
        around[k] = (max(0.0, math.floor((p - eps) * ACCURACY) / ACCURACY),
                     min(1.0, math.ceil((p + eps) * ACCURACY) / ACCURACY))
    grid = sorted({p for pair in around.values() for p in pair})
    distinct = sorted({(o, s.lo, s.hi) for (o, _), s in wide.items()}, key=str)
    ids = {d: i for i, d in enumerate(distinct)}
    sketches = {
        r["i"]: r["at"]
        for r in _inside(long, _table(long, [(o, i, lo, hi) for (o, lo, hi), i in ids.items()],
                                      "o string, i int, lo double, hi double"))
        .groupBy("i")
        .agg(F.percentile_approx("v", F.array(*[F.lit(p) for p in grid]), F.lit(ACCURACY)).alias("at"))
        .collect()
    }
    bounds = {}
    for k, s in wide.items():
        at = sketches[ids[(k[0], s.lo, s.hi)]]
        bounds[k] = (at[grid.index(around[k][0])], at[grid.index(around[k][1])])
    v, lo, hi = F.col("v"), F.col("lo"), F.col("hi")
    trial = _table(long, [(o, tag, float(a), float(b)) for (o, tag), (a, b) in bounds.items()],
                   "o string, tag string, lo double, hi double")
    out = {}
    counts = long.join(F.broadcast(trial), "o").where(v <= hi).groupBy("o", "tag").agg(
        F.count_if(v < lo).alias("under"),
        F.count_if(v == lo).alias("at_lo"),
        F.count_if((v > lo) & (v < hi)).alias("between"),
        F.count_if((v == hi) & (lo < hi)).alias("at_hi"),
    )
    for r in counts.collect():
        k = (r["o"], r["tag"])
        rank, old, (a, b) = ranks[k], wide[k], bounds[k]
        up_to_lo = r["under"] + r["at_lo"]
        up_to_mid = up_to_lo + r["between"]
        up_to_hi = up_to_mid + r["at_hi"]
        if rank < r["under"]:
            out[k] = Span(old.lo, a, old.below, r["under"] - old.below)
        elif rank < up_to_lo:
            out[k] = a
        elif rank < up_to_mid:
            out[k] = Span(a, b, up_to_lo, r["between"])
        elif rank < up_to_hi:
            out[k] = b
        else:
            out[k] = Span(b, old.hi, up_to_hi, old.below + old.rows - up_to_hi)
    return out


def _pick(long, spans, ranks):
    """Order what is left inside the spans, as distinct values with counts.

    Columns are counted once per distinct span; ranks that share one reuse the counts.
    """
    distinct = sorted({(o, s.lo, s.hi) for (o, _), s in spans.items()}, key=str)
    ids = {d: i for i, d in enumerate(distinct)}
    span_rows = _table(long, [(o, i, lo, hi) for (o, lo, hi), i in ids.items()],
                       "o string, i int, lo double, hi double")
    wanted = _table(long, [(ids[(o, s.lo, s.hi)], o, tag, s.below, ranks[(o, tag)]) for (o, tag), s in spans.items()],
                    "i int, o string, tag string, below bigint, rank bigint")
    counted = _inside(long, span_rows).groupBy("i", "v").agg(F.count(F.lit(1)).alias("cnt"))
    running = Window.partitionBy("i").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    upto = F.col("below") + F.col("upto")
    hit = (
        counted.withColumn("upto", F.sum("cnt").over(running))
        .join(F.broadcast(wanted), "i")
        .where((upto > F.col("rank")) & (upto - F.col("cnt") <= F.col("rank")))
    )
    return {(r["o"], r["tag"]): r["v"] for r in hit.select("o", "tag", "v").collect()}


def nearest_quantiles(df: DataFrame, qs, columns=None, *, dataset: str = "",
                      cols: list[ColumnInfo] | None = None) -> DataFrame:
    """PR9: quantile by nearest rank of every numeric column, infinities included, nulls left out."""
    cols = cols if cols is not None else [c for c in columns_of(df, columns) if c.numeric]
    if not cols:
        return local_table(df.sparkSession, [], QUANTILE_SCHEMA)
    found = select_ranks(long_numeric(df, cols), lambda nn: {repr(q): nearest_rank(q, nn) for q in qs})
    names = {f"c{c.ordinal}": c for c in cols}
    rows = [(dataset, names[o].ordinal, names[o].name, float(tag), nn, v) for (o, tag), (nn, v) in found.items()]
    return local_table(df.sparkSession, rows, QUANTILE_SCHEMA)


def order_statistics(df: DataFrame, qs=(), median: bool = True, *, columns=None, dataset: str = "",
                     cols: list[ColumnInfo] | None = None, sizes: dict[int, int] | None = None) -> DataFrame:
    """One row per numeric column: interpolated median and nearest-rank quantiles, from one selection.

    Quantile columns are named q01, q25, ... after the percent. `sizes` are known non-null counts
    per ordinal.
    """
    cols = cols if cols is not None else [c for c in columns_of(df, columns) if c.numeric]
    spark = df.sparkSession
    qcols = [f"q{round(q * 100):02d}" for q in qs]
    schema = "dataset string, ordinal int, name string, nn bigint, median double" + "".join(
        f", {c} double" for c in qcols)
    if not cols:
        return local_table(spark, [], schema)

    def ranks(nn):
        out = {c: nearest_rank(q, nn) for c, q in zip(qcols, qs)}
        if median:
            out |= {"mlo": (nn - 1) // 2, "mhi": nn // 2}
        return out

    known = None if sizes is None else {f"c{c.ordinal}": sizes[c.ordinal] for c in cols}
    found = select_ranks(long_numeric(df, cols), ranks, known)
    rows = []
    for c in cols:
        mine = {tag: v for (o, tag), (_, v) in found.items() if o == f"c{c.ordinal}"}
        nn = next((n for (o, _), (n, _) in found.items() if o == f"c{c.ordinal}"), 0)
        mid = (mine["mlo"] + mine["mhi"]) / 2 if "mlo" in mine else None
        if mid is not None and math.isnan(mid):
            mid = None
        rows.append((dataset, c.ordinal, c.name, nn, mid, *[mine.get(q) for q in qcols]))
    return local_table(spark, rows, schema)
