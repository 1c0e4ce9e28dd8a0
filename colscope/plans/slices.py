"""Many datasets in one plan: whole tables, and tables cut into a dataset for each value of some columns.

Where `Catalogue` runs an analysis for each table, here the long forms of all tables are one union keyed by dataset, and each step
is one job over it, whether there are fourteen datasets or fourteen thousand. Values collapse per (dataset, column) in each task
before a shuffle, so a dataset that holds a third of all rows is as harmless as a small one. The rules then run once for all.

Quartiles come from mergeable sketches (ranks within 1/10,000; exact for datasets of fewer rows), and numbers are judged as they
stand: placeholder values (QI4), reversals (ST14) and residual spreads (ST10) are left to `Analysis`. A table without rows has no datasets.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colscope.functions import numeric as N
from colscope.functions.session import local_table, settle, side_by_side
from colscope.operators import findings as FN, profile as P, quality as QI, recommend as RC, stats as ST, targets as TG
from colscope.operators.gram import PASS_BYTES, SUMS, TILE, gram_sums, pearson
from colscope.operators.longform import ColumnInfo, by_position, columns_of, ordinal_of, pos, typed_cell
from colscope.plans.analysis import CLASS_LIMIT
from colscope.schemas import union_all

KEY = ["t", "dataset", "o"]
ACCURACY = 10_000
#: Rows of bounds that are sent to all tasks.
SENT_ROWS = 200_000


class Slices:
    """`tables` by name; `by` names the columns whose values cut a table into datasets, called `table/value/value`."""

    def __init__(self, tables: dict[str, DataFrame], by: dict[str, tuple[str, ...]] | None = None):
        self.tables = list(tables.items())
        self.by = {name: tuple((by or {}).get(name, ())) for name in tables}

    def _dataset(self, name: str, df: DataFrame) -> Column:
        cut = {c.name: c for c in columns_of(df)}
        return F.concat_ws("/", F.lit(name), *[F.coalesce(pos(cut[b]).cast("string"), F.lit("None")) for b in self.by[name]])

    def _columns(self, name: str, df: DataFrame) -> list[ColumnInfo]:
        """Columns that cut a table are the same all over a dataset, so they are none of its columns."""
        return [c for c in columns_of(df) if c.name not in self.by[name]]

    def _parts(self, cell: Callable[[ColumnInfo], Column], keep: Callable[[ColumnInfo], bool], only: set[tuple[int, int]] | None = None) -> dict[int, DataFrame]:
        """(dataset, o, v) rows of each table that has such columns: one Expand. only: the (t, ordinal) that are read."""
        parts = {}
        for t, (name, df) in enumerate(self.tables):
            cols = [c for c in self._columns(name, df) if keep(c) and (only is None or (t, c.ordinal) in only)]
            if cols:
                wide = by_position(df).select(self._dataset(name, df).alias("dataset"), *[cell(c).alias(f"c{c.ordinal}") for c in cols])
                parts[t] = wide.unpivot(["dataset"], [f"c{c.ordinal}" for c in cols], "o", "v")
        return parts

    def _union(self, parts: dict[int, DataFrame], empty: str) -> DataFrame:
        """One union of what was made of each table, with t."""
        parts = [part.select(F.lit(t).alias("t"), *part.columns) for t, part in parts.items()]
        return reduce(DataFrame.unionAll, parts) if parts else local_table(self.tables[0][1].sparkSession, [], empty)

    def _long(self, cell: Callable[[ColumnInfo], Column], keep: Callable[[ColumnInfo], bool], empty: str) -> DataFrame:
        """(t, dataset, o, v) rows of all tables."""
        return self._union(self._parts(cell, keep), f"t int, dataset string, o string, v {empty}")

    def _numbers(self) -> dict[int, DataFrame]:
        return self._parts(lambda c: N.as_double(pos(c), c.dtype), lambda c: c.numeric)

    @cached_property
    def _names(self) -> DataFrame:
        """Columns of the tables; bounded by their schemas."""
        rows = [(t, c.ordinal, c.name, c.dtype.simpleString(), c.family) for t, (name, df) in enumerate(self.tables) for c in self._columns(name, df)]
        return F.broadcast(local_table(self.tables[0][1].sparkSession, rows, "t int, ordinal int, name string, dtype string, family string"))

    def _named(self, stats: DataFrame) -> DataFrame:
        return stats.withColumn("ordinal", ordinal_of(F.col("o"))).drop("o").join(self._names.drop("dtype", "family"), ["t", "ordinal"])

    # ---- one job each

    def _value_counts(self, only: set[tuple[int, int]] | None = None) -> DataFrame:
        """Tables are aggregated before their union, so that cells are made and added up in the same generated code."""
        key = ["dataset", "o", "value_int", "value_dbl", "value_str"]
        parts = self._parts(typed_cell, lambda c: True, only).items()
        return self._union({t: part.select("dataset", "o", "v.*").groupBy(*key).agg(F.count(F.lit(1)).alias("cnt")) for t, part in parts},
                           "t int, dataset string, o string, value_int bigint, value_dbl double, value_str string, cnt bigint")

    @cached_property
    def _counts(self) -> DataFrame:
        return settle(self._named(self._value_counts().groupBy(*KEY).agg(*P.count_sums())))

    @cached_property
    def counts(self) -> DataFrame:
        return P.with_shares(self._counts)

    @cached_property
    def schema(self) -> DataFrame:
        return self._counts.select("t", "dataset", "ordinal").join(self._names, ["t", "ordinal"]).select("dataset", "ordinal", "name", "dtype", "family")

    @cached_property
    def _measures(self) -> DataFrame:
        """Moments and quartile sketches. Sketches are objects, which would take the moments' aggregation out of generated code."""
        points = F.percentile_approx("v", F.array(*[F.lit(q) for q in (0.01, 0.25, 0.5, 0.75, 0.99)]), F.lit(ACCURACY))
        by = {t: part.groupBy("dataset", "o") for t, part in self._numbers().items()}
        if not by:
            by = {0: local_table(self.tables[0][1].sparkSession, [], "dataset string, o string, v double").groupBy("dataset", "o")}
        sums, sketches = (self._union({t: some.agg(*wanted) for t, some in by.items()}, "") for wanted in (P.moment_sums(), [points.alias("points")]))
        return settle(P.finite_moments(self._named(sums.join(sketches, KEY))))

    @cached_property
    def moments(self) -> DataFrame:
        return self._measures.drop("t", "points")

    @cached_property
    def order_stats(self) -> DataFrame:
        return self._measures.select("dataset", "ordinal", "name", "nn", *[
            F.get("points", F.lit(k)).alias(c) for k, c in enumerate(("q01", "q25", "median", "q75", "q99"))])

    @cached_property
    def text(self) -> DataFrame:
        texts = self._long(lambda c: pos(c).cast("string"), lambda c: c.family == "text", "string")
        return settle(P.judged_text(self._named(texts.groupBy(*KEY).agg(*P.text_sums()))).drop("t"))

    @cached_property
    def duplicates(self) -> DataFrame:
        """Rows with a copy in their dataset, told by 192 bits of hashes; no column of a row is shuffled."""
        parts = []
        for name, df in self.tables:
            cols = columns_of(df)
            plain = by_position(df).select(self._dataset(name, df).alias("dataset"), *[
                (N.as_double(pos(c), c.dtype) if c.family == "float" else F.to_json(F.struct(pos(c))) if "map<" in c.dtype.simpleString() else pos(c)).alias(f"c{c.ordinal}")
                for c in cols])
            # nulls are skipped by the hash, so each has its own sign
            values = [x for c in cols for x in (F.col(f"c{c.ordinal}").isNull(), F.col(f"c{c.ordinal}"))]
            parts.append(plain.select("dataset", *[F.xxhash64(F.lit(seed), *values).alias(f"h{k}") for k, seed in enumerate((3, 7919, 104729))]))
        groups = reduce(DataFrame.unionAll, parts).groupBy("dataset", "h0", "h1", "h2").agg(F.count(F.lit(1)).alias("n"))
        return settle(groups.groupBy("dataset").agg(F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)).alias("duplicate_rows")))

    @cached_property
    def outliers(self) -> DataFrame:
        iqr = F.col("q75") - F.col("q25")
        bounds = self._measures.select("t", "dataset", F.concat(F.lit("c"), F.col("ordinal").cast("string")).alias("o"), F.col("nn").alias("known"),
                                       F.get("points", F.lit(1)).alias("q25"), F.get("points", F.lit(3)).alias("q75")).where((F.col("known") >= 10) & (iqr != 0))
        v = F.col("v")

        def beyond(width):
            return F.count_if((v < F.col("q25") - iqr * width) | (v > F.col("q75") + iqr * width))

        # a row of bounds for each dataset and column; sent to all tasks unless they are very many, so that no cell is shuffled
        bounds = F.broadcast(bounds) if self._measures.count() <= SENT_ROWS else bounds
        numbers = self._union(self._numbers(), "t int, dataset string, o string, v double")
        stats = numbers.where("v is not null").join(bounds, KEY).groupBy(*KEY).agg(
            F.count(v).alias("nn"), beyond(1.5).alias("mild"), beyond(3.0).alias("extreme"))
        return settle(self._named(stats).join(self.features.where("role = 'numeric'").select("dataset", "ordinal"), ["dataset", "ordinal"], "left_semi").select(
            "dataset", "ordinal", "name", "nn", "mild", "extreme"))

    @cached_property
    def pairs(self) -> DataFrame:
        """Correlations of all pairs in every dataset.

        A table is read once for all of its datasets, as long as their sums fit PASS_BYTES in a task; otherwise once for each band of datasets that fits.
        """
        middle, sizes = {}, {}
        for r in self._measures.groupBy("t", "ordinal").agg(F.avg("mean").alias("mean"), F.count_distinct("dataset").alias("n")).collect():
            middle.setdefault(r["t"], {})[r["ordinal"]], sizes[r["t"]] = r["mean"], r["n"]
        parts = []
        for t, (name, df) in enumerate(self.tables):
            cols = [c for c in self._columns(name, df) if c.numeric]
            if len(cols) < 2 or t not in sizes:
                continue
            last = len(df.columns)
            keyed = by_position(df).withColumn(str(last), self._dataset(name, df))
            cut = next(c for c in columns_of(keyed) if c.ordinal == last)
            label = F.array(*[F.lit(n) for n in df.columns])
            bands = -(-sizes[t] * len(SUMS) * 8 * min(TILE, len(cols)) * len(cols) // PASS_BYTES)
            for band in range(bands):
                some = keyed if bands == 1 else keyed.where(F.pmod(F.hash(F.col(f"`{last}`")), F.lit(bands)) == band)
                parts.append(gram_sums(some, cols, middle[t], [(cut, -(-sizes[t] // bands))]).where("kind = 'group'").select(
                    F.col("value").alias("dataset"), "i", "j", label[F.col("i")].alias("col_a"), label[F.col("j")].alias("col_b"),
                    F.col("n").cast("bigint").alias("n"), pearson().alias("r")))
        empty = local_table(self.tables[0][1].sparkSession, [], ST.PAIR_DDL)
        found = reduce(DataFrame.unionByName, parts) if parts else empty
        numeric = self.features.where("role = 'numeric'").select("dataset", "ordinal")
        for side in ("i", "j"):
            found = found.join(numeric.withColumnRenamed("ordinal", side), ["dataset", side], "left_semi")
        return settle(found.select(*empty.columns))

    @cached_property
    def class_counts(self) -> DataFrame:
        """Class sizes of the columns that may be targets; no other column is counted again."""
        few = self.target_scores.where((F.col("score") >= 2) & (F.col("n_classes") <= CLASS_LIMIT)).select("dataset", "ordinal")
        read = {tuple(r) for r in self._counts.join(few, ["dataset", "ordinal"], "left_semi").select("t", "ordinal").distinct().collect()}  # by the schemas
        label = F.coalesce(F.col("value_int").cast("string"), F.col("value_dbl").cast("string"), F.col("value_str"))
        return settle(self._named(self._value_counts(read)).join(few, ["dataset", "ordinal"], "left_semi").select(
            "dataset", "ordinal", "name", label.alias("value"), "cnt"))

    # ---- rules, once for all datasets

    def gather(self) -> None:
        """Independent jobs side by side, then those that need them."""
        side_by_side([lambda s=s: getattr(self, s) for s in ("_counts", "_measures", "text", "duplicates")])
        _ = self.features, self.target_scores
        side_by_side([lambda s=s: getattr(self, s) for s in ("pairs", "outliers", "class_counts")])

    @cached_property
    def info(self) -> DataFrame:
        return settle(P.basic_info(self.counts))

    @cached_property
    def ids(self) -> DataFrame:
        return P.id_columns(self.schema, self.counts)

    @cached_property
    def structure(self) -> DataFrame:
        return settle(P.structure_type(self.schema, self.ids, self.text))

    @cached_property
    def features(self) -> DataFrame:
        return settle(ST.feature_columns(self.schema, self.ids))

    @cached_property
    def target_scores(self) -> DataFrame:
        return settle(TG.score_targets(self.schema, self.counts))

    @cached_property
    def targets(self) -> DataFrame:
        return settle(TG.suggest_targets(self.target_scores, TG.imbalance_ratio(self.class_counts)))

    @cached_property
    def _feature_moments(self) -> DataFrame:
        return self.moments.join(self.features.where("role = 'numeric'").select("dataset", "ordinal"), ["dataset", "ordinal"], "left_semi")

    @cached_property
    def all_findings(self) -> DataFrame:
        self.gather()
        none = local_table(self.tables[0][1].sparkSession, [], QI.SENTINEL_DDL)
        quality = QI.quality_issues(self.schema, self.counts, self.text, self.moments, none, self.duplicates, self.info)
        red = union_all([ST.class_imbalance(self.targets, self.class_counts), ST.leakage_by_name(self.schema, self.targets)])
        warnings = union_all([
            ST.multicollinearity(self.pairs), ST.high_correlation(self.pairs), ST.high_outliers(self.outliers),
            ST.near_zero_variance(self._feature_moments, self.counts), ST.extreme_skewness(self._feature_moments, self.order_stats)])
        return settle(FN.all_findings(quality, red, warnings))

    @cached_property
    def traits(self) -> DataFrame:
        patterns = ST.patterns(self.info, self.schema, self.features, self._feature_moments)
        return settle(RC.characteristics(self.info, self.all_findings, patterns))

    @cached_property
    def tasks(self) -> DataFrame:
        return settle(RC.task_type(self.info, self.targets))

    @cached_property
    def recommendation(self) -> DataFrame:
        return settle(RC.recommend(self.traits, self.tasks, self.structure))

    @cached_property
    def findings(self) -> DataFrame:
        return settle(FN.headlines(FN.relevance_adjust(FN.aggregate_findings(self.all_findings), self.recommendation)))

    @cached_property
    def split(self) -> DataFrame:
        return settle(FN.severity_split(self.findings, self.info))

    @cached_property
    def health(self) -> DataFrame:
        return FN.health_points(self.split, self.info, self.duplicates)

    @cached_property
    def summary(self) -> DataFrame:
        return FN.executive_summary(self.info, self.duplicates, self.split, self.health, ST.top_correlations(self.pairs), self.findings, self.recommendation)
