"""The small mixed frame (510 rows, 10 of them repeated) and what the rules say about it."""

import pytest

from colscope.plans.analysis import Analysis


@pytest.fixture(scope="module")
def analysis(spark):
    rows = []
    for i in range(500):
        rows.append((
            18 + (i * 7) % 52, None if i % 25 in (3, 11, 19) else float(1000 + (i * i * 37) % 90000), 0.5 + ((i * 31) % 100 - 50) / 300,
            None if 20 <= i < 50 else "AAAAAAABBC"[i % 10], ("North", "South", "East", "West")[(i * 3) % 4], 1 if i % 10 == 0 else 0, 1.0))
    rows += rows[:10]
    return Analysis(spark.createDataFrame(
        rows, "age int, income double, score double, category string, region string, churn int, duplicate_flag double"), "frame")


def test_duplicates_count_all_copies(analysis):
    assert analysis.duplicates.first()["duplicate_rows"] == 20


def test_constant_column(analysis):
    assert [r["column"] for r in analysis.quality.where("type = 'constant_column'").collect()] == ["duplicate_flag"]


def test_targets_in_order(analysis):
    got = [(r["column"], r["score"]) for r in analysis.targets.orderBy("rank").collect()]
    assert got == [("category", 5), ("churn", 5), ("score", 3)]


def test_no_imbalance_on_first_target(analysis):
    assert analysis.red_flags.where("type = 'class_imbalance'").count() == 0


def test_explicit_target(spark, analysis):
    a = Analysis(analysis.df, "frame", target="churn")
    first = a.targets.orderBy("rank").first()
    assert (first["column"], first["score"], first["n_classes"]) == ("churn", 999, 2)
    assert a.targets.where("column = 'churn'").count() == 1
    assert a.red_flags.where("type = 'class_imbalance'").first()["majority_pct"] == pytest.approx(90.0, abs=0.3)


def test_recommendation_and_findings(analysis):
    rec = analysis.recommendation.first()
    assert rec["task_type"] == "classification"
    assert len(rec["alternatives"]) == 2 and 0 < rec["confidence"] <= 1
    assert analysis.findings.where("action_priority is null or headline is null").count() == 0
    assert "510 rows" in analysis.summary.first()["summary"]


def test_documents_round_trip(spark, analysis, tmp_path):
    from colscope.sources.csvfiles import result_sink

    paths = result_sink(analysis.documents(), str(tmp_path / "out"), fmt="json")
    assert spark.read.json(paths["column_profiles"]).count() == 7
