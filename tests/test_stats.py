"""Statistics against numpy, and the properties of sampling, components and clusters."""

import numpy as np
import pytest

from colscope.operators import mlstats as ML
from colscope.operators import stats as ST


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(1e6, 3, 400)
    y = 2 * x + rng.normal(0, 1, 400)
    z = rng.exponential(5, 400)
    data = [[None if rng.random() < 0.1 else float(v) for v in row] for row in np.column_stack([x, y, z])]
    data = [(*r, 4.2, float("inf") if i == 7 else float(i)) for i, r in enumerate(data)]
    return spark.createDataFrame(data, "x double, y double, z double, same double, inf double"), data


def test_pearson_pairwise_deletion(frame):
    df, data = frame
    got = {(r["col_a"], r["col_b"]): r for r in ST.pearson_pairs(df).collect()}
    arr = np.array([[np.nan if v is None else v for v in r] for r in data])
    for (i, a), (j, b) in [((0, "x"), (1, "y")), ((0, "x"), (2, "z")), ((1, "y"), (2, "z"))]:
        both = ~(np.isnan(arr[:, i]) | np.isnan(arr[:, j]))
        assert got[(a, b)]["n"] == both.sum()
        assert got[(a, b)]["r"] == pytest.approx(np.corrcoef(arr[both, i], arr[both, j])[0, 1], abs=1e-9)
    assert got[("x", "same")]["r"] is None
    assert got[("x", "inf")]["r"] is None or arr[7, 0] != arr[7, 0]


def test_too_few_pairs_is_undefined(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, None), (None, 3.0), (4.0, 5.0)], "a double, b double")
    assert ST.pearson_pairs(df).first()["r"] is None


def test_sample_is_a_subset_of_bounded_size(spark):
    df = spark.range(5000)
    got = [r["id"] for r in ST.row_sample(df, 1000).collect()]
    assert len(got) == 1000 == len(set(got)) and set(got) <= set(range(5000))
    assert sorted(got) == sorted(r["id"] for r in ST.row_sample(df, 1000).collect())
    assert ST.row_sample(df, 10_000).count() == 5000


def test_scrub_has_two_sources(spark):
    rows = [(float(i), -999.0 if i % 20 == 0 else float(i)) for i in range(400)]
    df = spark.createDataFrame(rows, "a double, b double")
    clean, log = ST.sentinel_scrub(df)
    entry = log.first()
    assert entry["source"] == "blueprint"
    assert (entry["column"], entry["values"], entry["cells_replaced"]) == ("b", [-999.0], 20)
    assert clean.where("b is null").count() == 20
    known = ST.quality.sentinel_candidates(df, columns=["a"])  # finds nothing, so b is left to the second scan
    assert ST.sentinel_scrub(df, known)[1].first()["source"] == "safety_net"


def test_heteroscedasticity_needs_spread_and_rows(spark):
    df = spark.createDataFrame([(1.0, float(i)) for i in range(50)], "x double, y double")
    assert ST.residual_spread(df, "x", "y").count() == 0
    few = spark.createDataFrame([(float(i), float(i)) for i in range(10)], "x double, y double")
    assert ST.residual_spread(few, "x", "y").count() == 0


def test_pca_matches_numpy(spark, frame):
    df, data = frame
    got = [r["ratio"] for r in ML.pca_summary(df, ["x", "y", "z"]).orderBy("component").collect()]
    arr = np.array([r[:3] for r in data if None not in r[:3]], dtype=float)
    z = (arr - arr.mean(0)) / arr.std(0)
    want = np.sort(np.linalg.eigvalsh(np.cov(z.T)))[::-1]
    assert got == pytest.approx(list(want / want.sum()), abs=1e-4)
    assert sum(got) <= 1.0001 and got == sorted(got, reverse=True)


def test_clusters_find_separate_groups(spark):
    rng = np.random.default_rng(1)
    centers = np.array([[0, 0, 0], [20, 0, 0], [0, 20, 0]])
    rows = [tuple(float(v) for v in centers[i % 3] + rng.normal(0, 0.5, 3)) for i in range(300)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    elbow = ML.kmeans_elbow(df, max_iter=20).collect()
    assert [r["k"] for r in elbow] == [2, 3, 4, 5, 6]
    assert [r["k"] for r in elbow if r["chosen"]] == [3]
    points = ML.cluster_preview(df, max_iter=20, restarts=2).groupBy("label").count().collect()
    assert sorted((r["label"], r["count"]) for r in points) == [(0, 100), (1, 100), (2, 100)]


def test_too_small_for_components(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3.0)] * 10, "a double, b double, c double")
    assert ML.pca_summary(df).count() == 0 and ML.kmeans_elbow(df).count() == 0


def test_triples_scan(spark):
    rows = [(float(i % 50 + 200 * g), float(-(i % 50) + 200 * g + i % 7), "abc"[g]) for g in range(3) for i in range(100)]
    df = spark.createDataFrame(rows, "x double, y double, g string")
    assert ST.all_triples(df, ["x", "y"], ["g"]).first()["columns"] == ["x", "y", "g"]


def test_pair_without_the_outlier_keeps_its_digits(spark):
    """The one huge value is missing from the pair, so the column's mean is far from what is left."""
    rng = np.random.default_rng(3)
    x, y = rng.integers(0, 13, 2000).astype(float), rng.integers(0, 100, 2000).astype(float)
    rows = [(1e9 if i == 7 else float(x[i]), None if i % 5 == 2 else float(y[i])) for i in range(2000)]
    df = spark.createDataFrame(rows, "x double, y double")
    keep = [i for i in range(2000) if i % 5 != 2]
    want = np.corrcoef(x[keep], y[keep])[0, 1]
    assert ST.pearson_pairs(df).first()["r"] == pytest.approx(want, abs=1e-10)


def gram_of(df, by=(), medians=True):
    from colscope.operators.gram import gram_sums
    from colscope.operators.longform import columns_of

    cols = [c for c in columns_of(df) if c.numeric]
    middle = {c.ordinal: df.approxQuantile(c.name, [0.5], 0.0)[0] for c in cols} if medians else None
    return gram_sums(df, cols, {}, [(c, 9) for c in columns_of(df) if c.name in by], middle)


def test_pairs_groups_and_sides_from_one_scan(spark, tmp_path):
    rng = np.random.default_rng(8)
    x = rng.normal(0, 1, (900, 5))
    x[:, 1] = 3 * x[:, 0] + rng.normal(0, 1, 900) * np.where(x[:, 0] > 0, 4, 1)
    x[rng.random((900, 5)) < 0.1] = np.nan
    g = [[None, "a", "b", ""][i % 4] for i in range(900)]
    rows = [(*[None if np.isnan(v) else float(v) for v in r], k) for r, k in zip(x, g)]
    spark.createDataFrame(rows, "a double, b double, c double, d double, e double, g string").repartition(5).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    sums = gram_of(df, by=("g",))
    assert sums._jdf.queryExecution().executedPlan().toString().count("Scan parquet") == 1
    sums = sums.cache()
    got = {(r["i"], r["j"], r["value"]): r for r in ST.group_correlations(sums).collect()}
    assert len(got) == 10 * 3
    values = np.array([v if v is not None else "-" for v in g])
    for (i, j, value), r in got.items():
        both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
        inside = both & (values == value)
        assert r["n"] == inside.sum()
        assert r["group_r"] == pytest.approx(np.corrcoef(x[inside, i], x[inside, j])[0, 1], abs=1e-9)
        assert r["overall_r"] == pytest.approx(np.corrcoef(x[both, i], x[both, j])[0, 1], abs=1e-9)
    spreads = {(r["i"], r["j"]): r for r in ST.residual_spreads(sums).collect()}
    assert len(spreads) == 20
    for (i, j), r in spreads.items():
        both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
        slope, base = np.polyfit(x[both, i], x[both, j], 1)
        res = x[:, j] - slope * x[:, i] - base
        high = both & (x[:, i] >= df.approxQuantile("abcde"[i], [0.5], 0.0)[0])
        low = both & ~high
        assert (r["n"], r["n_low"], r["n_high"]) == (both.sum(), low.sum(), high.sum())
        assert r["ratio"] == pytest.approx(res[high].var() / (res[low].var() + 1e-10), rel=1e-8)
    assert spreads[(0, 1)]["ratio"] > 4


def test_bands_of_tiles_give_the_same_sums(spark, monkeypatch):
    from colscope.operators import gram

    rng = np.random.default_rng(9)
    x = rng.normal(0, 1, (200, 23))
    df = spark.createDataFrame([(*map(float, r), "uv"[i % 2]) for i, r in enumerate(x)], ", ".join(f"c{i} double" for i in range(23)) + ", g string").repartition(3)
    key = lambda r: (r["kind"], r["by"], r["value"], r["i"], r["j"])
    whole = {key(r): r for r in gram_of(df, by=("g",)).collect()}
    monkeypatch.setattr(gram, "TILE", 4)
    monkeypatch.setattr(gram, "PASS_BYTES", 30_000)
    monkeypatch.setattr(gram, "CELLS", 700)
    parts = gram_of(df, by=("g",)).collect()
    assert len(parts) == len(whole) == 253 * 3 + 2 * 23 * 22
    for r in parts:
        assert [r[s] for s in gram.SUMS] == pytest.approx([whole[key(r)][s] for s in gram.SUMS], abs=1e-9)


def test_wide_tables_keep_their_tasks(spark):
    """300 columns: some tiles leave each task, and no task is merged away before the scan."""
    wide = spark.range(0, 400, numPartitions=7).selectExpr("id", *[f"cast(sin(id * {k + 1}) as double) as c{k}" for k in range(300)]).drop("id")
    sums = gram_of(wide, medians=False)
    plan = sums._jdf.queryExecution().executedPlan().toString()
    assert "Coalesce" not in plan
    assert sums.count() == 300 * 299 // 2
