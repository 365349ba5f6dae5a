"""Every query against its SQL, and the driver contract."""

from __future__ import annotations

import pytest
from oracle import difference, duck

import __spark_entry__ as entry_points
from webweave.catalog import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sf_dir, con, name):
    ours = QUERIES[name](spark, sf_dir).toPandas()
    assert difference(ours, con.execute(ORACLES[name]).df()) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_gives_rows(spark, sf_dir, name):
    assert len(QUERIES[name](spark, sf_dir).toPandas()) > 0


def test_contract(spark):
    assert entry_points.entry(spark).count() > 0
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())
