"""Every query with SQL against that SQL, on the smallest tables."""

from __future__ import annotations

import pytest

from statloom.plans import catalogue, more  # noqa: F401
from tests.helpers import duck, same

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_equals_sql(spark, con, name):
    same(catalogue.QUERIES[name](spark, SF), con, catalogue.ORACLE_SQL[name])


def test_queries_without_sql_are_tested_elsewhere():
    assert set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL) == {"slugs", "changepoint_forecasts", "recurrent_forecasts", "backtest_grid", "forecast_figures", "feature_shares", "weak_spot_list", "quarterly_forecasts"}  # tests/test_extra.py, tests/test_forecasters.py


def test_entry():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
