"""Every registered query against its SQL in DuckDB."""

import pytest
from compare import differences, duck
from conftest import SF_DIR

import __spark_entry__ as entry_point
from leaderstream.plans.registry import QUERIES


@pytest.fixture(scope="module")
def oracle():
    return duck(SF_DIR)


def test_every_query_has_sql():
    assert set(QUERIES) <= set(entry_point.oracle_sql())
    assert set(QUERIES) <= set(entry_point.queries())


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, oracle, name):
    frame = entry_point.queries()[name](spark, SF_DIR)
    assert differences(frame, oracle, entry_point.oracle_sql()[name]) is None


def test_entry(spark):
    assert entry_point.entry(spark).columns == ["table_name", "Name", "Team", "Cl", "Position", "Value", "Rank"]
