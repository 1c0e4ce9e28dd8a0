"""Analyses of many tables: small results are unioned, and the rules run once for all of them."""

from __future__ import annotations

from pyspark.sql import DataFrame

from colscope.functions.session import side_by_side
from colscope.operators import findings as FN
from colscope.operators import profile as P
from colscope.operators import recommend as RC
from colscope.plans.analysis import Analysis
from colscope.schemas import union_all


class Catalogue:
    def __init__(self, tables: dict[str, DataFrame]):
        self.analyses = {name: Analysis(df, name) for name, df in tables.items()}

    def stack(self, step: str) -> DataFrame:
        """One step of every analysis in one relation."""
        return union_all(side_by_side([lambda a=a: getattr(a, step) for a in self.analyses.values()], at_once=4))

    def overview(self) -> DataFrame:
        """Rows, columns and gaps per table."""
        return P.basic_info(self.stack("counts"))

    def recommendations(self) -> DataFrame:
        """The recommendation rules of all tables as one job."""
        return RC.recommend(self.stack("traits"), self.stack("tasks"), self.stack("structure"))

    def findings(self) -> DataFrame:
        """Grouping, relevance and headlines of all tables as one job."""
        grouped = FN.aggregate_findings(self.stack("all_findings"))
        return FN.headlines(FN.relevance_adjust(grouped, self.recommendations()))
