"""The analysis of one table, step by step, each step a small DataFrame computed once.

Data-sized work (histogram, moments, order statistics, text scan, pair sums, ...) happens in the
operators. Their results have one row per column, pair or finding; `settle` writes those few rows
to the checkpoint folder, so the rules after them never touch the data again.
"""

from __future__ import annotations

from concurrent.futures import Future, ThreadPoolExecutor
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colscope.functions.session import inheriting, settle
from colscope.operators import charts, findings as FN, mlstats, profile as P, quality as QI, recommend as RC
from colscope.operators import stats as ST
from colscope.operators import targets as TG
from colscope.operators.gram import gram_sums
from colscope.operators.longform import columns_of, schema_table
from colscope.operators.quantiles import order_statistics
from colscope.schemas import union_all

CLASS_LIMIT = 20
#: Steps that run jobs on the data, and the steps that each waits for.
NEEDS = {
    "counts": (), "moments": (), "text": (), "sentinels": (), "duplicates": (), "top_values": (), "samples": (),
    "order_stats": ("moments",), "info": ("counts",), "target_scores": ("counts",), "features": ("counts",), "structure": ("counts", "text"),
    "class_counts": ("target_scores",), "targets": ("class_counts",), "scrub_log": ("sentinels",),
    "clean_moments": ("moments", "features", "scrub_log"), "clean_order_stats": ("order_stats", "clean_moments"),
    "gram": ("counts", "clean_order_stats"), "pairs": ("gram",), "outliers": ("clean_order_stats",),
    "patterns": ("info", "features", "clean_moments"), "quality": ("counts", "text", "moments", "sentinels", "duplicates", "info"),
}


class Analysis:
    """Profile, checks, recommendation and findings of one table. Every step is computed on first use."""

    def __init__(self, df: DataFrame, dataset: str = "", target: str | None = None):
        self.df, self.dataset, self.target = df, dataset, target

    def gather(self, *wanted: str) -> None:
        """Compute steps and all that they need, independent ones side by side: the wait is that of the longest chain."""
        order: list[str] = []

        def visit(step: str) -> None:
            if step not in order and step not in self.__dict__:
                for before in NEEDS[step]:
                    visit(before)
                order.append(step)

        for step in wanted:
            visit(step)
        if not order:
            return
        running: dict[str, Future] = {}

        def run(step: str):
            for before in NEEDS[step]:
                if before in running:
                    running[before].result()
            return getattr(self, step)

        with ThreadPoolExecutor(len(order)) as pool:
            for step in order:
                running[step] = pool.submit(inheriting(run), step)
            for future in running.values():
                future.result()

    # ---- profile

    @cached_property
    def schema(self) -> DataFrame:
        return schema_table(self.df, self.dataset)

    @cached_property
    def counts(self) -> DataFrame:
        return settle(P.column_counts(self.df, self.dataset))

    @cached_property
    def moments(self) -> DataFrame:
        return settle(P.moments(self.df, self.dataset))

    @cached_property
    def order_stats(self) -> DataFrame:
        sizes = {r["ordinal"]: r["nn"] for r in self.moments.select("ordinal", "nn").collect()}
        return order_statistics(self.df, (0.01, 0.25, 0.75, 0.99), dataset=self.dataset, sizes=sizes)

    @cached_property
    def text(self) -> DataFrame:
        return settle(P.text_profile(self.df, self.dataset))

    @cached_property
    def top_values(self) -> DataFrame:
        return settle(P.top_values(self.df, self.dataset))

    @cached_property
    def samples(self) -> DataFrame:
        return settle(P.sample_values(self.df, self.dataset))

    @cached_property
    def duplicates(self) -> DataFrame:
        return settle(P.duplicate_rows(self.df, self.dataset))

    @cached_property
    def info(self) -> DataFrame:
        return settle(P.basic_info(self.counts))

    @cached_property
    def ids(self) -> DataFrame:
        return P.id_columns(self.schema, self.counts)

    @cached_property
    def kinds(self) -> DataFrame:
        return P.column_kinds(self.schema, self.counts, self.text)

    @cached_property
    def structure(self) -> DataFrame:
        return settle(P.structure_type(self.schema, self.ids, self.text))

    @cached_property
    def profile(self) -> DataFrame:
        self.gather("counts", "moments", "order_stats", "text", "top_values", "samples")
        return settle(P.column_profile(self.schema, self.counts, self.kinds, self.moments, self.order_stats, self.text,
                                       self.top_values, self.samples))

    # ---- quality and targets

    @cached_property
    def sentinels(self) -> DataFrame:
        return settle(QI.sentinel_candidates(self.df, self.dataset))

    @cached_property
    def quality(self) -> DataFrame:
        self.gather(*NEEDS["quality"])
        return settle(QI.quality_issues(self.schema, self.counts, self.text, self.moments, self.sentinels,
                                        self.duplicates, self.info))

    @cached_property
    def target_scores(self) -> DataFrame:
        return settle(TG.score_targets(self.schema, self.counts))

    @cached_property
    def class_counts(self) -> DataFrame:
        """Class sizes of the columns that may serve as a classification target."""
        rows = self.target_scores.where(F.col("n_classes") <= CLASS_LIMIT).where(
            (F.col("score") >= 2) | (F.col("name") == F.lit(self.target or "")))
        names = [r["name"] for r in rows.select("name").collect()]
        return settle(TG.class_counts(self.df, names, self.dataset))

    @cached_property
    def targets(self) -> DataFrame:
        ratios = TG.imbalance_ratio(self.class_counts)
        found = TG.suggest_targets(self.target_scores, ratios)
        if self.target in self.df.columns:
            found = TG.explicit_target(found, self.target_scores, ratios, self.target)
        return settle(found)

    # ---- statistics on scrubbed data

    @cached_property
    def _scrub(self):
        return ST.sentinel_scrub(self.df, self.sentinels, self.dataset, rescan=False)

    @property
    def clean(self) -> DataFrame:
        return self._scrub[0]

    @cached_property
    def scrub_log(self) -> DataFrame:
        return settle(self._scrub[1])

    @cached_property
    def features(self) -> DataFrame:
        return settle(ST.feature_columns(self.schema, self.ids))

    @cached_property
    def numeric_features(self) -> list[str]:
        return [r["name"] for r in self.features.where("role = 'numeric'").orderBy("ordinal").collect()]

    @cached_property
    def text_columns(self) -> list[str]:
        return [r["name"] for r in self.features.where("role = 'text'").orderBy("ordinal").collect()]

    @cached_property
    def scrubbed_columns(self) -> list[str]:
        return [r["column"] for r in self.scrub_log.select("column").collect()]

    @cached_property
    def clean_moments(self) -> DataFrame:
        """Moments of the scrubbed table; only scrubbed columns are computed again."""
        keep = self.moments.where(F.col("name").isin(*self.numeric_features))
        if not self.scrubbed_columns:
            return keep
        columns = [c for c in self.scrubbed_columns if c in self.numeric_features]
        again = P.moments(self.clean, self.dataset, columns)
        return settle(keep.where(~F.col("name").isin(*self.scrubbed_columns)).unionByName(again))

    @cached_property
    def clean_order_stats(self) -> DataFrame:
        keep = self.order_stats.where(F.col("name").isin(*self.numeric_features))
        if not self.scrubbed_columns:
            return keep
        sizes = {r["ordinal"]: r["nn"] for r in self.clean_moments.select("ordinal", "nn").collect()}
        columns = [c for c in self.scrubbed_columns if c in self.numeric_features]
        again = order_statistics(self.clean, (0.01, 0.25, 0.75, 0.99), columns=columns, dataset=self.dataset, sizes=sizes)
        return keep.where(~F.col("name").isin(*self.scrubbed_columns)).unionByName(again)

    @cached_property
    def groupings(self) -> dict[int, int]:
        """Text columns of 2 to 10 values, as ordinal and number of values."""
        few = self.counts.where(F.col("name").isin(*self.text_columns) & F.col("unique_count").between(2, 10))
        return {r["ordinal"]: r["unique_count"] for r in few.select("ordinal", "unique_count").collect()}

    @cached_property
    def gram(self) -> DataFrame:
        """Sums of all pairs of numeric features: overall, inside the groups of every grouping, and above each median; one read."""
        middle = self.clean_moments.select("ordinal", "mean").join(self.clean_order_stats.select("ordinal", "median"), "ordinal", "left").collect()
        cols = [c for c in columns_of(self.clean, self.numeric_features) if c.numeric]
        by = [(c, self.groupings[c.ordinal]) for c in columns_of(self.clean) if c.ordinal in self.groupings]
        return settle(gram_sums(self.clean, cols, {r["ordinal"]: r["mean"] if r["median"] is None else r["median"] for r in middle}, by,
                                {r["ordinal"]: r["median"] for r in middle}))

    @cached_property
    def pairs(self) -> DataFrame:
        return settle(ST.pair_correlations(self.gram, self.clean.columns, self.dataset))

    @cached_property
    def correlations(self) -> DataFrame:
        return settle(ST.top_correlations(self.pairs))

    @cached_property
    def outliers(self) -> DataFrame:
        return settle(ST.outlier_counts(self.clean, self.clean_order_stats, self.numeric_features, self.dataset))

    @cached_property
    def outlier_summary(self) -> DataFrame:
        return ST.outlier_summary(self.outliers, self.features)

    @cached_property
    def shapes(self) -> DataFrame:
        return ST.distribution_summary(self.clean_moments, self.features)

    @cached_property
    def patterns(self) -> DataFrame:
        return settle(ST.patterns(self.info, self.schema, self.features, self.clean_moments))

    @cached_property
    def reversals(self) -> DataFrame:
        """Every pair inside every group of every grouping, beside its overall correlation."""
        return ST.pair_reversals(self.gram, self.clean.columns, self.groupings, self.dataset)

    @cached_property
    def reversal(self) -> DataFrame:
        return ST.simpsons_paradox(self.reversals)

    @cached_property
    def spreads(self) -> DataFrame:
        """Residual spread of every ordered pair."""
        return ST.pair_spreads(self.gram, self.clean.columns, self.dataset)

    @cached_property
    def spread(self) -> DataFrame:
        return ST.heteroscedasticity(self.spreads)

    @cached_property
    def red_flags(self) -> DataFrame:
        return settle(union_all([
            ST.class_imbalance(self.targets, self.class_counts), self.reversal,
            ST.leakage_by_name(self.schema, self.targets)]))

    @cached_property
    def warnings(self) -> DataFrame:
        return settle(union_all([
            ST.multicollinearity(self.pairs), ST.high_correlation(self.pairs), ST.high_outliers(self.outliers), self.spread,
            ST.near_zero_variance(self.clean_moments, self.counts),
            ST.extreme_skewness(self.clean_moments, self.clean_order_stats)]))

    # ---- recommendation and findings

    @cached_property
    def all_findings(self) -> DataFrame:
        self.gather("quality", "targets", "pairs", "outliers", "patterns")
        return settle(FN.all_findings(self.quality, self.red_flags, self.warnings))

    @cached_property
    def traits(self) -> DataFrame:
        flagged = self.red_flags.unionByName(self.warnings)
        return settle(RC.characteristics(self.info, flagged, self.patterns))

    @cached_property
    def tasks(self) -> DataFrame:
        return settle(RC.task_type(self.info, self.targets))

    @cached_property
    def model_scores(self) -> DataFrame:
        return settle(RC.model_scores(self.traits, self.tasks))

    @cached_property
    def recommendation(self) -> DataFrame:
        return settle(RC.recommend(self.traits, self.tasks, self.structure))

    @cached_property
    def grouped(self) -> DataFrame:
        return settle(FN.aggregate_findings(self.all_findings))

    @cached_property
    def findings(self) -> DataFrame:
        """Grouped findings with priority, note and headline for the recommended model."""
        return settle(FN.headlines(FN.relevance_adjust(self.grouped, self.recommendation)))

    @cached_property
    def split(self) -> DataFrame:
        return settle(FN.severity_split(self.findings, self.info))

    @cached_property
    def health(self) -> DataFrame:
        return FN.health_points(self.split, self.info, self.duplicates)

    @cached_property
    def summary(self) -> DataFrame:
        return FN.executive_summary(self.info, self.duplicates, self.split, self.health, self.correlations, self.findings,
                                    self.recommendation)

    @cached_property
    def relationships(self) -> DataFrame:
        return FN.column_relationships(ST.known_correlations(self.pairs), self.all_findings)

    @cached_property
    def quartiles(self) -> DataFrame:
        return P.quartiles(self.order_stats, self.moments)

    @cached_property
    def distribution(self) -> DataFrame:
        return TG.class_distribution(self.top_values, self.counts)

    @cached_property
    def radar(self) -> DataFrame:
        return charts.health_radar(self.info, self.duplicates, self.outlier_summary, self.shapes, self.all_findings, self.split)

    @cached_property
    def digest(self) -> DataFrame:
        return FN.digest(self.info, self.structure, self.quality, self.profile, self.correlations, self.outlier_summary,
                         self.shapes, self.recommendation, self.targets, self.traits)

    @cached_property
    def pca(self) -> DataFrame:
        return mlstats.pca_summary(self.clean, self.numeric_features, self.dataset)

    def documents(self) -> dict[str, DataFrame]:
        """The result tables under the names they are stored by."""
        return {
            "dataset_info": self.info, "column_profiles": self.profile, "findings": self.findings,
            "correlations": self.correlations, "recommendation": self.recommendation,
        }


def analyze(df: DataFrame, dataset: str = "", target: str | None = None) -> Analysis:
    return Analysis(df, dataset, target)
