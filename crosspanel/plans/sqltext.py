"""Shared SQL for the DuckDB side of every check: the derived panel and the ledger built on it."""

from __future__ import annotations

import re

FEATURES = ("discount", "tax", "qty", "returned", "size", "momentum")


#: CTEs that later ones read several times; without a copy each reader runs the chain anew.
KEPT = ("panel", "panel_base", "panel_rets", "uni", "uni_ranked", "weights", "growth", "priced", "carried", "rets")


def pct_rank(column: str, by: str = "eom") -> str:
    """Average-tie percentile rank inside ``by`` with null read as 0.5."""
    return (
        f"coalesce(CASE WHEN {column} IS NOT NULL THEN "
        f"(rank() OVER (PARTITION BY {by} ORDER BY {column} ASC NULLS LAST) - 1 "
        f"+ (count({column}) OVER (PARTITION BY {by}, {column}) + 1) / 2e0) "
        f"/ count({column}) OVER (PARTITION BY {by}) END, 0.5e0)"
    )


def panel_ctes(entity: str = "l_suppkey") -> str:
    planted = "entity % 17 = 0 AND month_index % 5 = 0"
    raws = {
        "discount": "discount_points / (lines * 100e0)",
        "tax": "tax_points / (lines * 100e0)",
        "qty": "units / lines::DOUBLE",
        "returned": "returned_lines / lines::DOUBLE",
        "size": "ln(cents / 100e0)",
    }
    raw_sql = ", ".join(f"{v} AS raw_{k}" for k, v in raws.items())
    nulled = ", ".join(
        f"CASE WHEN NOT ({planted}) THEN raw_{f} END AS raw_{f}" for f in FEATURES
    )
    rank_sql = ", ".join(f"{pct_rank('raw_' + f)} AS rank_{f}" for f in FEATURES)
    return f"""
month_sums AS (
  SELECT {entity} AS entity, CAST(last_day(l_shipdate) AS DATE) AS eom,
    CAST(year(l_shipdate) * 12 + month(l_shipdate) AS INTEGER) AS month_index,
    CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS cents,
    CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS units,
    CAST(sum(CAST(round(l_discount * 100) AS BIGINT)) AS BIGINT) AS discount_points,
    CAST(sum(CAST(round(l_tax * 100) AS BIGINT)) AS BIGINT) AS tax_points,
    CAST(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS BIGINT) AS returned_lines,
    count(*) AS lines
  FROM lineitem GROUP BY 1, 2, 3),
panel_base AS (
  SELECT entity, eom, month_index, cents, cents / 100e0 / units AS price, cents / 100e0 AS mktcap, {raw_sql}
  FROM month_sums),
panel_lags AS (
  SELECT *, month_index - lag(month_index) OVER m AS gap, lead(month_index) OVER m - month_index AS ahead,
    month_index - lag(month_index, 6) OVER m AS six,
    lag(mktcap) OVER m AS mktcap_1, lag(price) OVER m AS price_1, lead(price) OVER m AS price_next,
    lag(price, 6) OVER m AS price_6,
    (sum(cents) OVER t)::DOUBLE / (count(cents) OVER t) / 100e0 / 21e0 AS adv_6m
  FROM panel_base
  WINDOW m AS (PARTITION BY entity ORDER BY month_index),
    t AS (PARTITION BY entity ORDER BY month_index RANGE BETWEEN 5 PRECEDING AND CURRENT ROW)),
panel_rets AS (
  SELECT * EXCLUDE (gap, ahead, six, mktcap_1, price_1, price_next, price_6, cents),
    CASE WHEN gap = 1 THEN mktcap_1 END AS lag_mktcap,
    CASE WHEN gap = 1 THEN price / price_1 - 1 END AS ret_1m,
    CASE WHEN ahead = 1 THEN price_next / price - 1 END AS ret_exc_lead1m,
    CASE WHEN six = 6 THEN price / price_6 - 1 END AS raw_momentum,
    0.2e0 / adv_6m AS lambda_adv
  FROM panel_lags),
panel_vol AS (
  SELECT * EXCLUDE ({", ".join("raw_" + f for f in FEATURES)}), {nulled},
    stddev_samp(ret_1m) OVER (PARTITION BY entity ORDER BY month_index RANGE BETWEEN 11 PRECEDING AND CURRENT ROW) AS vol_12m,
    CAST(row_number() OVER (PARTITION BY eom ORDER BY lag_mktcap IS NULL, lag_mktcap DESC, entity) AS INTEGER) AS universe_rank,
    count(*) OVER (PARTITION BY eom) AS names
  FROM panel_rets),
panel AS (
  SELECT *, universe_rank / names::DOUBLE <= 0.2e0 AS in_small, universe_rank / names::DOUBLE <= 0.6e0 AS in_mid,
    universe_rank / names::DOUBLE <= 1e0 AS in_large, {rank_sql}
  FROM panel_vol)"""


def final(body: str, *columns: str, ctes: str = "") -> str:
    """``SELECT`` the named columns of ``body``.

    ``name`` keeps the column, ``name:8`` rounds a double to 8 places (and turns -0.0 into 0.0),
    ``name:int`` / ``name:bigint`` casts.
    """
    parts = []
    for column in columns:
        name, _, kind = column.partition(":")
        if not kind:
            parts.append(name)
        elif re.fullmatch(r"\d+", kind):
            parts.append(f"round(CAST({name} AS DOUBLE), {kind}) + 0e0 AS {name}")
        else:
            parts.append(f"CAST({name} AS {kind.upper()}) AS {name}")
    ctes = re.sub(rf"(?m)^({'|'.join(KEPT)}) AS \(", r"\1 AS MATERIALIZED (", ctes)
    with_ = f"WITH RECURSIVE {ctes}\n" if ctes else ""
    return f"{with_}SELECT {', '.join(parts)} FROM ({body}) AS result"


def growth_ctes(source: str = "uni", tag: str = "") -> str:
    """Month numbers and the growth that carries holdings forward."""
    return f"""
months{tag} AS (
  SELECT eom, CAST(row_number() OVER (ORDER BY eom) AS INTEGER) AS t FROM {source} GROUP BY eom HAVING count(ret_exc_lead1m) > 0),
growth_raw{tag} AS (
  SELECT m.eom, m.t, CASE WHEN sum(CASE WHEN ok THEN lag_mktcap END) > 0 THEN
    greatest(1e0 + sum(CASE WHEN ok THEN lag_mktcap * ret_exc_lead1m END) / sum(CASE WHEN ok THEN lag_mktcap END), 0.1e0) END AS g
  FROM (SELECT *, lag_mktcap > 0 AND ret_exc_lead1m IS NOT NULL AS ok FROM {source}) u JOIN months{tag} m USING (eom) GROUP BY m.eom, m.t),
growth{tag} AS (
  SELECT eom, t, coalesce(last_value(g IGNORE NULLS) OVER (ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 1e0) AS growth
  FROM growth_raw{tag})"""


def pricing_ctes(
    weights: str, keys: str = "method", source: str = "uni", aum: str = "1e5", gamma: str = "1e1", tag: str = "", gtag: str = ""
) -> str:
    """Price the CTE ``weights``(keys, eom, entity, weight, variance) into monthly rows ``rets``."""
    k = [c.strip() for c in keys.split(",")]
    kl = ", ".join(k)
    on = " AND ".join(f"c.{c} = p.{c}" for c in k)
    ck = ", ".join(f"coalesce(c.{c}, p.{c}) AS {c}" for c in k)
    return f"""
priced{tag} AS (
  SELECT w.*, g.t, g.growth, u.ret_exc_lead1m, u.lambda_adv
  FROM {weights} w JOIN growth{gtag} g USING (eom) JOIN {source} u USING (eom, entity)),
carried{tag} AS (
  SELECT {ck}, coalesce(c.entity, p.entity) AS entity, coalesce(c.t, p.t + 1) AS t, c.weight, c.variance,
    c.ret_exc_lead1m, c.lambda_adv, p.lambda_adv AS prior_lambda,
    coalesce(p.weight * (1e0 + coalesce(p.ret_exc_lead1m, 0e0)) / p.growth, 0e0) AS inherited,
    c.weight IS NULL AS dropped
  FROM priced{tag} c FULL OUTER JOIN priced{tag} p ON {on} AND c.entity = p.entity AND c.t = p.t + 1),
medians{tag} AS (SELECT eom, median(lambda_adv) AS median_lambda FROM {source} GROUP BY eom),
wealth{tag} AS (SELECT eom, t, lag(growth, 1, 1e0) OVER (ORDER BY t) AS wealth_growth FROM growth{gtag}),
rets_raw{tag} AS (
  SELECT eom, t, {kl},
    sum(CASE WHEN NOT dropped THEN weight * coalesce(ret_exc_lead1m, 0e0) END) AS gross_return,
    sum(CASE WHEN NOT dropped THEN lambda_adv * pow(weight - inherited, 2) END) AS trade_sq,
    coalesce(sum(CASE WHEN dropped THEN coalesce(prior_lambda, median_lambda) * pow(inherited, 2) END), 0e0) AS exit_sq,
    sum(abs(CASE WHEN dropped THEN inherited ELSE weight - inherited END)) AS turnover,
    sum(abs(weight)) AS leverage, sum(greatest(weight, 0e0)) FILTER (WHERE weight IS NOT NULL) AS long_exposure,
    sum(greatest(-weight, 0e0)) FILTER (WHERE weight IS NOT NULL) AS short_exposure,
    count(*) FILTER (WHERE weight <> 0) AS n_names, count(*) FILTER (WHERE dropped) AS dropped_names,
    sum(abs(weight) * lambda_adv) AS weighted_lambda, max(lambda_adv) AS max_lambda_adv, max(wealth_growth) AS wealth_growth,
    sum(weight * weight * variance) AS ex_ante_monthly_variance, max(abs(weight)) AS max_abs_weight
  FROM carried{tag} JOIN wealth{tag} USING (t) JOIN medians{tag} USING (eom) GROUP BY eom, t, {kl}
  HAVING sum(abs(weight)) IS NOT NULL),
rets{tag} AS (
  SELECT *, {aum} / 2 * exit_sq AS exit_cost, {aum} / 2 * trade_sq + {aum} / 2 * exit_sq AS trading_cost,
    gross_return - ({aum} / 2 * trade_sq + {aum} / 2 * exit_sq) AS net_return,
    gross_return - ({aum} / 2 * trade_sq + {aum} / 2 * exit_sq) - 0.5e0 * {gamma} * ex_ante_monthly_variance AS utility_flow,
    CASE WHEN leverage > 0 THEN weighted_lambda / leverage ELSE 0e0 END AS weighted_lambda_exposure,
    CAST(year(eom) AS INTEGER) AS test_year
  FROM rets_raw{tag})"""


def ledger_ctes(weights: str, keys: str = "method", source: str = "uni", aum: str = "1e5", gamma: str = "1e1", tag: str = "") -> str:
    return growth_ctes(source, tag) + "," + pricing_ctes(weights, keys, source, aum, gamma, tag, tag)


def scan_ctes(terms: str, keys: str, out: str = "positions") -> str:
    """Positions x = a + b * lifted previous x of the CTE ``terms``(keys, entity, eom, t, a, b, lift)."""
    k = [c.strip() for c in keys.split(",")]
    kl = ", ".join(k)
    join = " AND ".join(f"n.{c} = p.{c}" for c in [*k, "entity"])
    return f"""
{out}_marked AS (SELECT *, coalesce(lag(t) OVER (PARTITION BY {kl}, entity ORDER BY t) = t - 1, false) AS follows FROM {terms}),
{out} AS (
  SELECT {kl}, entity, eom, t, variance, a AS weight, lift FROM {out}_marked WHERE NOT follows
  UNION ALL SELECT {", ".join("n." + c for c in k)}, n.entity, n.eom, n.t, n.variance, n.a + n.b * (p.weight * p.lift), n.lift
  FROM {out} p JOIN {out}_marked n ON {join} AND n.t = p.t + 1 AND n.follows)"""


UNIVERSE = """
uni_base AS (SELECT * FROM panel WHERE in_mid),
uni_median AS (SELECT eom, median(CASE WHEN vol_12m > 0 THEN vol_12m END) AS med FROM uni_base GROUP BY eom),
uni AS (
  SELECT u.*, greatest(pow(coalesce(CASE WHEN vol_12m > 0 THEN vol_12m END, med, 1e-3), 2), 1e-6) AS variance,
    0.01e0 * (rank_momentum - 0.5e0) AS mu
  FROM uni_base u JOIN uni_median m USING (eom))"""

WEIGHTS = """
uni_ranked AS (
  SELECT *, count(*) OVER (PARTITION BY eom) AS n,
    row_number() OVER (PARTITION BY eom ORDER BY rank_momentum, entity) AS rn_mom,
    row_number() OVER (PARTITION BY eom ORDER BY rank_discount, entity) AS rn_disc,
    mu / (1e1 * (variance + 1e-8)) AS mv FROM uni),
uni_lev AS (SELECT *, sum(abs(mv)) OVER (PARTITION BY eom) AS mv_lev FROM uni_ranked),
weights AS (
  SELECT 'equal_weight' AS method, eom, entity, variance, 1e0 / n AS weight FROM uni_ranked
  UNION ALL SELECT 'rank_long_short', eom, entity, variance,
    CASE WHEN n > 1 THEN (rn_mom - (n + 1) / 2e0) * (1e0 / (floor(n * n / 2e0) / 2e0)) ELSE 0e0 END FROM uni_ranked
  UNION ALL SELECT 'top_bottom', eom, entity, variance,
    CASE WHEN rn_disc > n - greatest(1, floor(n * 0.1e0)) THEN 0.5e0 / greatest(1, floor(n * 0.1e0))
      WHEN rn_disc <= greatest(1, floor(n * 0.1e0)) THEN -0.5e0 / greatest(1, floor(n * 0.1e0)) ELSE 0e0 END FROM uni_ranked
  UNION ALL SELECT 'markowitz', eom, entity, variance, mv * CASE WHEN mv_lev > 2 THEN 2e0 / mv_lev ELSE 1e0 END FROM uni_lev)"""


def returns_ctes() -> str:
    return ",".join([panel_ctes(), UNIVERSE, WEIGHTS, ledger_ctes("weights")])
