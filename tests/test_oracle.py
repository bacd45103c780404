"""A slice of the registered queries against DuckDB on the small tables; tests/check.py runs them all."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from check import compare, connect

NAMES = (
    "performance", "scan_panel", "cs_rank", "bucketed_quantiles", "liquidity_decile", "cs_unit_norm", "rolling_splits",
    "return_model_by_year", "ewma_covariance", "persistence", "method_differences", "portfolio_variance",
    "ledger_grid", "select_cumulative", "policy_beta", "mechanisms", "trading_speed", "static_factored", "static_star_factored", "carry_positions", "scale_to_volatility", "check_lookahead", "parse_params",
)


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, sf_dir, con, name):
    assert compare(entry.queries()[name](spark, sf_dir), con, entry.oracle_sql()[name]) is None


def test_registry():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries)
    own = {n for n in queries if n != "pipeline" and not n.startswith("op")}
    assert own <= set(sql)


def test_entry(spark):
    assert entry.entry(spark).count() == 4
