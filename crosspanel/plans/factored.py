"""Registered queries: inherited-position policies under factored risk and their ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from crosspanel.operators import factored, ledger, risk
from crosspanel.plans import base
from crosspanel.plans.models import monthly_covariance
from crosspanel.plans.policies import AUM, GRID_KEYS, GRID_OUT, STAR, STATIC, STATIC_METHODS
from crosspanel.plans.registry import register
from crosspanel.plans.riskplans import EXPOSE, TWO, factored_universe
from crosspanel.plans.sqltext import growth_ctes, pricing_ctes

CANDIDATES = [factored.Candidate(STATIC_METHODS[0], name, s, 1.0 / phi) for name, phi, s in STATIC] + [
    factored.Candidate(STATIC_METHODS[1], name, u, k, v) for name, u, v, k in STAR
]

_values = ", ".join(f"('{c.method}', '{c.name}', {c.scale!r}e0, {c.cost!r}e0, {c.shrinkage!r}e0)" for c in CANDIDATES)
# A month's solve needs sums over its names, so the recursion runs month by month over all names at once.
FACTORED = f"""{EXPOSE},{growth_ctes()},
two AS MATERIALIZED (
  SELECT r.*, t, growth, b1*b1*fdd + b2*b2*ftt + 2*b1*b2*fdt + idio_variance AS own, (1e0 + coalesce(ret_exc_lead1m, 0e0)) / growth AS lift
  FROM risk_rows r JOIN growth USING (eom)),
steps AS MATERIALIZED (
  SELECT method, candidate, entity, eom, t, b1, b2, fdd, fdt, ftt, lift, idio_variance, scale * mu AS pm, 1e5 * cost * lambda_adv AS pull, 1e1 * (idio_variance + shrinkage * own + 1e-8) + 1e5 * cost * lambda_adv AS d
  FROM two CROSS JOIN (VALUES {_values}) v(method, candidate, scale, cost, shrinkage)),
coupled AS (
  SELECT DISTINCT method, candidate, CAST(-1 AS BIGINT) AS entity, DATE '1900-01-01' AS eom, 0 AS t, 0e0 AS weight, 0e0 AS inherited, 0e0 AS lift FROM steps
  UNION ALL
  SELECT method, candidate, entity, eom, t, (rhs - b1*(q1*m22 - q2*m12)/(m11*m22 - m12*m21) - b2*(q2*m11 - q1*m21)/(m11*m22 - m12*m21))/d, inherited, lift
  FROM (SELECT *, 1 + c11*a11 + c12*a12 AS m11, c11*a12 + c12*a22 AS m12, c12*a11 + c22*a12 AS m21, 1 + c12*a12 + c22*a22 AS m22, c11*r1 + c12*r2 AS q1, c12*r1 + c22*r2 AS q2
    FROM (SELECT *, 1e1*fdd AS c11, 1e1*fdt AS c12, 1e1*ftt AS c22, sum(b1*b1/d) OVER m AS a11, sum(b1*b2/d) OVER m AS a12, sum(b2*b2/d) OVER m AS a22, sum(b1*rhs/d) OVER m AS r1, sum(b2*rhs/d) OVER m AS r2
      FROM (SELECT n.*, coalesce(p.weight * p.lift, 0e0) AS inherited, pm + pull * coalesce(p.weight * p.lift, 0e0) AS rhs
        FROM steps n JOIN (SELECT max(t) AS last FROM coupled) l ON n.t = l.last + 1
        LEFT JOIN coupled p ON p.method = n.method AND p.candidate = n.candidate AND p.entity = n.entity)
      WINDOW m AS (PARTITION BY method, candidate)))),
held AS MATERIALIZED (SELECT * FROM coupled WHERE t > 0),
held_risk AS (SELECT h.*, b1, b2, idio_variance, fdd, fdt, ftt FROM held h JOIN two USING (eom, entity)),
held_variance AS (
  SELECT method, candidate, eom, greatest(x1*x1*fdd + x2*x2*ftt + 2*x1*x2*fdt, 0e0) + idio AS total
  FROM (SELECT method, candidate, eom, sum(weight*b1) AS x1, sum(weight*b2) AS x2, sum(weight*weight*idio_variance) AS idio, max(fdd) AS fdd, max(fdt) AS fdt, max(ftt) AS ftt FROM held_risk GROUP BY 1, 2, 3))"""
_WEIGHTS = "(SELECT method, candidate, eom, entity, weight, 0e0 AS variance FROM held)"
FACTORED_LEDGER = f"{FACTORED},{pricing_ctes(_WEIGHTS, keys='method, candidate')}"


def small_matrices(spark, sf_dir) -> DataFrame:
    return risk.covariance_matrices(monthly_covariance(spark, sf_dir), TWO)


def risk_rows(spark, sf_dir) -> DataFrame:
    """The universe with two loadings, the idiosyncratic and the total variance."""

    def build():
        rows = factored_universe(spark, sf_dir, TWO)
        return risk.entity_variance(rows, small_matrices(spark, sf_dir))

    return base.shared(spark, sf_dir, "two_factor_rows", build)


def paths(spark, sf_dir) -> DataFrame:
    return base.shared(
        spark, sf_dir, "factored_paths",
        lambda: factored.entity_paths(risk_rows(spark, sf_dir), base.stats(spark, sf_dir)),
    )


def solved(spark, sf_dir) -> factored.FactorPath:
    stats = base.stats(spark, sf_dir)
    months = stats.agg(F.max("t")).first()[0] or 0
    return factored.solve_path(
        paths(spark, sf_dir), factored.month_covariances(small_matrices(spark, sf_dir), stats), months, CANDIDATES, aum=AUM
    )


def held(spark, sf_dir) -> DataFrame:
    """Positions of all candidates, by month."""

    def build():
        rows = factored.positions(paths(spark, sf_dir), solved(spark, sf_dir), CANDIDATES, aum=AUM)
        return rows.join(F.broadcast(base.stats(spark, sf_dir).select("eom", "t")), "t").drop("t")

    return base.shared(spark, sf_dir, "factored_positions", build)


def variances(spark, sf_dir) -> DataFrame:
    loads = risk_rows(spark, sf_dir).select("eom", "entity", "loadings", "idio_variance")
    rows = held(spark, sf_dir).join(loads, ["eom", "entity"])
    return risk.portfolio_variance(rows, small_matrices(spark, sf_dir), TWO, ("eom", *GRID_KEYS)).select(
        "eom", *GRID_KEYS, "ex_ante_monthly_variance"
    )


@register(
    "factored_policies",
    "method candidate eom entity weight:8 inherited:8",
    "SELECT method, candidate, eom, entity, weight, inherited FROM held",
    FACTORED,
)
def factored_policies(spark, sf_dir):
    """Static policies of eight candidates under factored risk, each from the position carried into the month."""
    return held(spark, sf_dir)


@register(
    "factored_ledger",
    GRID_OUT,
    "SELECT r.* EXCLUDE (ex_ante_monthly_variance, utility_flow), total AS ex_ante_monthly_variance, net_return - 5e0 * total AS utility_flow FROM rets r JOIN held_variance USING (method, candidate, eom)",
    FACTORED_LEDGER,
)
def factored_ledger(spark, sf_dir):
    """The ledger of those positions, with the portfolio variance of the factored model."""
    returns = base.universe(spark, sf_dir).select("eom", "entity", "ret_exc_lead1m", "lambda_adv")
    rows = held(spark, sf_dir).drop("inherited").join(returns, ["eom", "entity"])
    return ledger.ledger(rows, base.stats(spark, sf_dir), GRID_KEYS, aum=AUM, variance=variances(spark, sf_dir))
