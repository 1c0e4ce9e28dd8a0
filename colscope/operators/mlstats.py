"""Standardising, principal components and clusters (ST19-ST22), on the engine's own PCA and k-means."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from colscope.functions import numeric as N
from colscope.functions.session import local_table, settle, side_by_side
from colscope.operators.longform import by_position, columns_of, pos

PCA_DDL = "dataset string, component int, ratio double, cumulative double, n_components int, n_features int"
ELBOW_DDL = "dataset string, k int, inertia double, drop double, chosen boolean"
POINTS_DDL = "dataset string, pc1 double, pc2 double, label int, n_clusters int, pc1_var double, pc2_var double"
K_RANGE = range(2, 7)
#: Starts of each number of clusters on the way, and of the final model.
STARTS, RESTARTS = 4, 10


def complete_rows(df: DataFrame, columns=None) -> tuple[DataFrame, list]:
    """Numeric columns as doubles, rows with a null or an infinity dropped."""
    cols = [c for c in columns_of(df, columns) if c.numeric]
    wide = by_position(df).select(*[N.finite(N.as_double(pos(c), c.dtype)).alias(f"c{c.ordinal}") for c in cols])
    return wide.dropna(), cols


def scaling(complete: DataFrame) -> dict[str, tuple[float, float]]:
    """Mean and population standard deviation per column (1 where a column is constant)."""
    names = complete.columns
    aggs = [a for n in names for a in (F.avg(n).alias(f"{n}_m"), F.stddev_pop(n).alias(f"{n}_s"))]
    row = complete.agg(F.count(F.lit(1)).alias("rows"), *aggs).first()
    out = {n: (row[f"{n}_m"], row[f"{n}_s"] or 1.0) for n in names}
    return out | {"rows": row["rows"]}


def _scaled(complete: DataFrame, scale) -> DataFrame:
    return complete.select(*[((F.col(n) - F.lit(scale[n][0])) / F.lit(scale[n][1])).alias(n) for n in complete.columns])


def standardize(df: DataFrame, columns=None) -> DataFrame:
    """ST19: z-scores with the population deviation over complete rows; constant columns become 0."""
    complete, cols = complete_rows(df, columns)
    scale = scaling(complete)
    if not scale["rows"]:
        return complete.toDF(*[c.name for c in cols])
    return _scaled(complete, scale).toDF(*[c.name for c in cols])


def _vectors(scaled: DataFrame, keep: list[str]) -> DataFrame:
    names = [c for c in scaled.columns if c not in keep]
    return scaled.select(array_to_vector(F.array(*names)).alias("features"), *keep)


def pca_summary(df: DataFrame, columns=None, dataset: str = "") -> DataFrame:
    """ST20: explained-variance ratios of up to 10 components; needs 3 columns and 30 complete rows."""
    spark = df.sparkSession
    complete, cols = complete_rows(df, columns)
    if len(cols) < 3:
        return local_table(spark, [], PCA_DDL)
    scale = scaling(complete)
    if scale["rows"] < 30:
        return local_table(spark, [], PCA_DDL)
    k = min(10, len(cols))
    ratios = PCA(k=k, inputCol="features", outputCol="scores").fit(_vectors(_scaled(complete, scale), [])).explainedVariance.toArray()
    rows, total = [], 0.0
    for i, r in enumerate(ratios):
        total += float(r)
        rows.append((dataset, i + 1, round(float(r), 4), round(total, 4), k, len(cols)))
    return local_table(spark, rows, PCA_DDL)


def _prepared(df: DataFrame, columns, keep: list[str]):
    """Standardised vectors of the complete rows, cached, or None with fewer than 3 columns or 50 rows."""
    cols = [c for c in columns_of(df, columns) if c.numeric]
    if len(cols) < 3:
        return None
    wide = by_position(df).select(*[N.finite(N.as_double(pos(c), c.dtype)).alias(f"c{c.ordinal}") for c in cols],
                                  *[pos(c).alias(c.name) for c in columns_of(df) if c.name in keep]).dropna(subset=[f"c{c.ordinal}" for c in cols])
    names = [f"c{c.ordinal}" for c in cols]
    scale = scaling(wide.select(*names))
    if scale["rows"] < 50:
        return None
    scaled = wide.select(*[((F.col(n) - F.lit(scale[n][0])) / F.lit(scale[n][1])).alias(n) for n in names], *keep)
    return _vectors(scaled, keep).persist(StorageLevel.MEMORY_AND_DISK), scale["rows"]


def _fit(vectors: DataFrame, k: int, max_iter: int, seed: int):
    model = KMeans(k=k, seed=seed, maxIter=max_iter).fit(vectors)
    return model, float(model.summary.trainingCost)


def _best(vectors: DataFrame, k: int, max_iter: int, starts: int):
    """The model of least cost from several starts, and its cost; the starts run side by side."""
    return min(side_by_side([lambda i=i: _fit(vectors, k, max_iter, 42 + i) for i in range(starts)]), key=lambda m: m[1])


def _elbow(vectors: DataFrame, rows: int, max_iter: int):
    """(k, inertia, drop) for every k, and the k with the largest drop (2 when there is none)."""
    ks = [k for k in K_RANGE if k < rows]
    vectors.count()  # cached once, before the fits read it side by side
    costs = side_by_side([lambda k=k, i=i: _fit(vectors, k, max_iter, 42 + i)[1] for k in ks for i in range(STARTS)])
    best_cost = {k: min(costs[n * STARTS: (n + 1) * STARTS]) for n, k in enumerate(ks)}
    found = [(k, best_cost[k], None if k == ks[0] else best_cost[k - 1] - best_cost[k]) for k in ks]
    best = max((f for f in found if f[2] is not None and f[2] > 0), key=lambda f: (f[2], -f[0]), default=found[0])[0]
    return found, best


def kmeans_elbow(df: DataFrame, columns=None, dataset: str = "", max_iter: int = 100) -> DataFrame:
    """ST21: inertia for 2 to 6 clusters; the largest drop against one cluster fewer is chosen."""
    spark = df.sparkSession
    ready = _prepared(df, columns, [])
    if ready is None:
        return local_table(spark, [], ELBOW_DDL)
    vectors, rows = ready
    try:
        found, best = _elbow(vectors, rows, max_iter)
    finally:
        vectors.unpersist()
    return local_table(spark, [(dataset, k, cost, drop, k == best) for k, cost, drop in found], ELBOW_DDL)


def cluster_preview(df: DataFrame, columns=None, dataset: str = "", max_iter: int = 100, restarts: int = RESTARTS,
                    keep: list[str] | None = None) -> DataFrame:
    """ST22: cluster label and the first two component scores of every complete row, with the `keep` columns.

    The chosen number of clusters is fitted again from several starts. Clusters are numbered by their centres' coordinates.
    """
    spark = df.sparkSession
    keep = keep or []
    ready = _prepared(df, columns, keep)
    if ready is None:
        return local_table(spark, [], POINTS_DDL)
    vectors, rows = ready
    try:
        _, best = _elbow(vectors, rows, max_iter)
        model = _best(vectors, best, max_iter, restarts)[0]
        order = sorted(range(best), key=lambda i: tuple(model.clusterCenters()[i]))
        names = F.create_map(*[F.lit(x) for at, i in enumerate(order) for x in (i, at)])
        pca = PCA(k=2, inputCol="features", outputCol="scores").fit(vectors)
        loads, share = pca.pc.toArray(), pca.explainedVariance.toArray()
        signs = [1.0 if loads[abs(loads[:, c]).argmax(), c] >= 0 else -1.0 for c in (0, 1)]
        labelled = pca.transform(model.transform(vectors)).withColumn("s", vector_to_array("scores"))
        return settle(labelled.select(
            F.lit(dataset).alias("dataset"), *keep, *[F.round(F.col("s")[c] * signs[c], 4).alias(f"pc{c + 1}") for c in (0, 1)],
            names[F.col("prediction")].alias("label"), F.lit(best).alias("n_clusters"),
            *[F.lit(round(float(share[c]), 4)).alias(f"pc{c + 1}_var") for c in (0, 1)]))
    finally:
        vectors.unpersist()
