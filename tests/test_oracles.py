"""Every registered query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry_module
from checks.compare import compare
from checks.queries import ORACLES, QUERIES, fresh


@pytest.mark.parametrize("key", list(ORACLES))
def test_matches_sql(spark, con, folder, key):
    ok, note = compare(spark, con, key, folder)
    assert ok, note
    assert "TYPES" not in note


def test_entry_points(spark):
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())
    assert set(QUERIES) <= set(entry_module.queries())
    assert entry_module.entry(spark).count() == 11


def test_fresh_forgets(spark, folder):
    from checks.queries import A

    first = A(spark, folder)
    assert A(spark, folder) is first
    fresh()
    assert A(spark, folder) is not first
