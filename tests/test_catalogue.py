"""Several tables in one catalogue give the same answers as one analysis each."""

from colscope.plans.analysis import Analysis
from colscope.plans.catalogue import Catalogue
from colscope.sources.tables import read_table


def test_catalogue_equals_single_analyses(spark, folder):
    tables = {t: read_table(spark, folder, t) for t in ("customer", "supplier")}
    both = Catalogue(tables)
    rows = {r["dataset"]: r for r in both.recommendations().collect()}
    found = {}
    for r in both.findings().collect():
        found.setdefault(r["dataset"], set()).add((r["type"], r["column"], r["severity"], r["action_priority"]))
    for name, df in tables.items():
        a = Analysis(df, name)
        assert rows[name]["primary_model"] == a.recommendation.first()["primary_model"]
        assert found.get(name, set()) == {(r["type"], r["column"], r["severity"], r["action_priority"]) for r in a.findings.collect()}
    assert {r["dataset"]: r["rows"] for r in both.overview().collect()} == {t: df.count() for t, df in tables.items()}


def test_digest_document(spark, folder):
    import json

    doc = json.loads(Analysis(read_table(spark, folder, "part"), "part").digest.first()["document"])
    assert doc["rows"] == 200 and len(doc["column_digest"]) == 6


def test_steps_side_by_side_equal_steps_in_turn(spark, folder):
    """Every step is computed once, whatever the order in which the threads finish."""
    from checks.queries import dirty
    from colscope.plans.analysis import NEEDS, Analysis

    df = dirty(spark, folder)
    together, in_turn = Analysis(df, "dirty"), Analysis(df, "dirty")
    together.gather("quality", "outliers")
    assert {"quality", "outliers", "clean_order_stats", "duplicates"} <= set(together.__dict__) & set(NEEDS)
    for step in ("outliers", "quality"):
        assert sorted(map(str, getattr(together, step).collect())) == sorted(map(str, getattr(in_turn, step).collect())), step
    before = dict(together.__dict__)
    together.gather("quality", "outliers")
    assert together.__dict__ == before
