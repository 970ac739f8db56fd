"""Every registered query against DuckDB on the smallest tables."""

from pathlib import Path

import pytest

import __spark_entry__ as entry
from compare import connect, differences

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="driver tables are not here")


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_matches_sql(spark, con, name):
    found = entry.queries()[name](spark, FOLDER)
    assert differences(found, con, entry.oracle_sql()[name], tolerance=0.0) == []


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["holdout_score", "feature_importance", "model_grid"])
def test_model_queries_run(spark, name):
    assert entry.queries()[name](spark, FOLDER).count() > 0
