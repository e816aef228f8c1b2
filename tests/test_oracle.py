import pytest

import __spark_entry__ as entry
from quarry.plans.queries import ORACLE_SQL, QUERIES
from tests.oracle import assert_same


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_sql(spark, sf, name):
    assert_same(QUERIES[name](spark, sf), ORACLE_SQL[name], sf)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE_SQL)


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == 1 and rows[0]["files"] == rows[0]["read"] + rows[0]["not_accessible"] + rows[0]["error"]


def test_registry():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(QUERIES) <= set(entry.queries())
