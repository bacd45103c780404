"""Registered queries: performance and ledger."""

from __future__ import annotations

from crosspanel.operators import performance
from crosspanel.plans import base
from crosspanel.plans.registry import register
from crosspanel.plans.sqltext import returns_ctes

METRICS = (
    "n_months annualized_gross_return:8 annualized_trading_cost:8 annualized_net_return:8 "
    "annualized_volatility:8 annualized_gross_volatility:8 gross_sharpe:6 net_sharpe:6 average_turnover:8 "
    "average_leverage:8 empirical_utility:6 annualized_ex_ante_utility_flow:6 max_drawdown:8"
)


def metrics_sql(by: str, source: str = "rets", gamma: str = "1e1") -> str:
    """Annualised metrics with a recursive-free drawdown: wealth by product, peak by running maximum."""
    return f"""
  SELECT {by}, count(*) AS n_months, 12 * avg(gross_return) AS annualized_gross_return,
    12 * avg(trading_cost) AS annualized_trading_cost, 12 * avg(net_return) AS annualized_net_return,
    sqrt(12) * stddev_samp(net_return) AS annualized_volatility,
    sqrt(12) * stddev_samp(gross_return) AS annualized_gross_volatility,
    CASE WHEN stddev_samp(gross_return) > 0 THEN 12 * avg(gross_return) / (sqrt(12) * stddev_samp(gross_return)) END AS gross_sharpe,
    CASE WHEN stddev_samp(net_return) > 0 THEN 12 * avg(net_return) / (sqrt(12) * stddev_samp(net_return)) END AS net_sharpe,
    avg(turnover) AS average_turnover, avg(leverage) AS average_leverage,
    12 * avg(net_return) - 0.5 * {gamma} * 12 * var_samp(net_return) AS empirical_utility,
    12 * avg(utility_flow) AS annualized_ex_ante_utility_flow, min(dd) AS max_drawdown
  FROM (SELECT *, wealth / max(wealth) OVER (PARTITION BY {by} ORDER BY eom) - 1 AS dd FROM (
    SELECT *, product(1 + greatest(net_return, -0.999999e0)) OVER (PARTITION BY {by} ORDER BY eom) AS wealth FROM {source}))
  GROUP BY {by}"""


@register("performance", f"method {METRICS}", metrics_sql("method"), returns_ctes())
def performance_plan(spark, sf_dir):
    """Net performance of every policy: panel, weights, positions, costs, metrics."""
    return performance.performance(base.returns(spark, sf_dir))
