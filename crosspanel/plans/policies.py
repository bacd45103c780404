"""Registered queries: ledgers, inherited-weight policies, portfolio policy, selection, scenarios."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from crosspanel import settings as S
from crosspanel.operators import joins, ledger, performance, policy, portfolio_ml, ranks, regress, scaling, selection, windows
from crosspanel.plans import base
from crosspanel.plans.portfolio import METRICS, metrics_sql
from crosspanel.plans.registry import register
from crosspanel.plans.riskplans import NAMES, matrices, risk_rows
from crosspanel.plans.sqltext import (
    UNIVERSE, WEIGHTS, growth_ctes, ledger_ctes, panel_ctes, pricing_ctes, returns_ctes, scan_ctes,
)
from crosspanel.sources.panel import read

AUM = base.AUM
PANEL = panel_ctes()
RETURNS = returns_ctes()
UNI = f"{PANEL},{UNIVERSE},{growth_ctes()}"
EVALUATION = (
    "eom method gross_return:8 trading_cost:8 exit_cost:8 net_return:8 utility_flow:8 turnover:8 leverage:8 long_exposure:8 "
    "short_exposure:8 n_names:bigint dropped_names:bigint wealth_growth:8 weighted_lambda_exposure:10 max_lambda_adv:10 ex_ante_monthly_variance:10"
)


@register("evaluate", EVALUATION, "SELECT * FROM rets", RETURNS)
def evaluate(spark, sf_dir):
    """The monthly return table of four policies: one pass over the holdings."""
    return base.returns(spark, sf_dir)


@register(
    "carry_positions",
    "eom method entity inherited:10 trade:10 dropped",
    "SELECT eom, method, entity, inherited, weight - inherited AS trade, dropped FROM carried JOIN months USING (t)",
    RETURNS,
)
def carry_positions(spark, sf_dir):
    return ledger.carry_positions(base.held(spark, sf_dir), base.stats(spark, sf_dir))


@register(
    "dropped_positions",
    "eom method entity inherited:10",
    "SELECT eom, method, entity, inherited FROM carried JOIN months USING (t) WHERE dropped",
    RETURNS,
)
def dropped_positions(spark, sf_dir):
    return ledger.dropped(ledger.carry_positions(base.held(spark, sf_dir), base.stats(spark, sf_dir)))


@register("market_growth", "eom t growth:10", "SELECT * FROM growth", UNI)
def market_growth(spark, sf_dir):
    return ledger.market_growth(base.universe(spark, sf_dir))


@register("valid_months", "eom t", "SELECT * FROM months", UNI)
def valid_months(spark, sf_dir):
    return ledger.valid_months(base.universe(spark, sf_dir))


@register(
    "grown_holdings",
    "method months:bigint grown_sum:8",
    "SELECT method, count(DISTINCT eom) AS months, sum(weight * (1e0 + coalesce(ret_exc_lead1m, 0e0)) / growth) AS grown_sum FROM priced GROUP BY 1",
    RETURNS,
)
def grown_holdings(spark, sf_dir):
    rows = ranks.attach(base.held(spark, sf_dir), base.stats(spark, sf_dir), ["eom"], "inner")
    grown = ledger.grow(F.col("weight"), F.col("ret_exc_lead1m"), F.col("growth"))
    return rows.groupBy("method").agg(F.count_distinct("eom").alias("months"), F.sum(grown).alias("grown_sum"))


@register(
    "affine_scan",
    "entity month_index x:8",
    """SELECT entity, month_index, x FROM scan""",
    f"""{PANEL},
terms AS (SELECT entity, month_index, rank_tax AS a, rank_discount / 3e0 AS b, coalesce(lag(month_index) OVER (PARTITION BY entity ORDER BY month_index) = month_index - 1, false) AS follows FROM panel),
scan AS (SELECT entity, month_index, a AS x FROM terms WHERE NOT follows UNION ALL SELECT n.entity, n.month_index, n.a + n.b * p.x FROM scan p JOIN terms n ON n.entity = p.entity AND n.month_index = p.month_index + 1 AND n.follows)""",
)
def affine_scan(spark, sf_dir):
    """x = a + b * previous x along each entity's months, reset on a gap."""
    rows = base.panel(spark, sf_dir).withColumns({"a": F.col("rank_tax"), "b": F.col("rank_discount") / 3.0})
    return ledger.affine_scan(rows, ["entity"], "month_index", "a", "b", "x")


# Static policies over a grid ----------------------------------------------------------------------

STATIC = [("phi=1 s=0.1", 1.0, 0.1), ("phi=1 s=0.5", 1.0, 0.5), ("phi=6 s=0.1", 6.0, 0.1), ("phi=6 s=0.5", 6.0, 0.5)]
STAR = [("u=0.25 v=0 k=1", 0.25, 0.0, 1.0), ("u=0.25 v=0.5 k=1", 0.25, 0.5, 1.0), ("u=0.5 v=0 k=2", 0.5, 0.0, 2.0), ("u=0.5 v=0.5 k=2", 0.5, 0.5, 2.0)]
STATIC_METHODS = ["static_ml", "static_ml_star"]
GRID_KEYS = ["method", "candidate"]

_static_values = ", ".join(f"('{c}', {phi}e0, {s}e0)" for c, phi, s in STATIC)
_star_values = ", ".join(f"('{c}', {u}e0, {v}e0, {k}e0)" for c, u, v, k in STAR)
TERMS = f"""
terms AS (
  SELECT 'static_ml' AS method, candidate, entity, u.eom, t, variance, s * mu / (1e1 * (variance + 1e-8) + 1e5 / phi * lambda_adv) AS a, 1e5 / phi * lambda_adv / (1e1 * (variance + 1e-8) + 1e5 / phi * lambda_adv) AS b,
    (1e0 + coalesce(ret_exc_lead1m, 0e0)) / growth AS lift FROM uni u JOIN growth USING (eom) CROSS JOIN (VALUES {_static_values}) c(candidate, phi, s)
  UNION ALL SELECT 'static_ml_star', candidate, entity, u.eom, t, variance, cu * mu / (1e1 * (variance * (1 + cv) + 1e-8) + 1e5 * ck * lambda_adv), 1e5 * ck * lambda_adv / (1e1 * (variance * (1 + cv) + 1e-8) + 1e5 * ck * lambda_adv),
    (1e0 + coalesce(ret_exc_lead1m, 0e0)) / growth FROM uni u JOIN growth USING (eom) CROSS JOIN (VALUES {_star_values}) c(candidate, cu, cv, ck))"""
GRID = f"{UNI},{TERMS},{scan_ctes('terms', 'method, candidate')},{pricing_ctes('(SELECT method, candidate, eom, entity, weight, variance FROM positions)', keys='method, candidate')}"


def static_terms(rows: DataFrame, size: int) -> DataFrame:
    """Scan terms of every static candidate, from one pass over the universe (``size`` rows at most)."""
    rows = ranks.by_entity(rows, size, len(STATIC) + len(STAR))
    mu, var, lam = F.col("mu"), F.col("variance"), F.col("lambda_adv")
    items = []
    for name, phi, s in STATIC:
        a, b = policy.static_terms(mu, var, lam, S.GAMMA, AUM, phi, s)
        items.append(F.struct(F.lit("static_ml").alias("method"), F.lit(name).alias("candidate"), a.alias("a"), b.alias("b")))
    for name, u, v, k in STAR:
        a, b = policy.static_star_terms(mu, var, lam, S.GAMMA, AUM, u, v, k)
        items.append(F.struct(F.lit("static_ml_star").alias("method"), F.lit(name).alias("candidate"), a.alias("a"), b.alias("b")))
    return rows.select("eom", "entity", "ret_exc_lead1m", "lambda_adv", "variance", F.inline(F.array(*items)))


def grid_returns(spark, sf_dir) -> DataFrame:
    return base.shared(
        spark, sf_dir, "grid_returns",
        lambda: ledger.grid_ledger(
            static_terms(base.universe(spark, sf_dir), base.rows(spark, sf_dir)), base.stats(spark, sf_dir), GRID_KEYS, aum=AUM
        ),
    )


@register(
    "static_policies",
    "method candidate eom entity weight:8",
    "SELECT * FROM positions",
    f"{UNI},{TERMS},{scan_ctes('terms', 'method, candidate')}",
)
def static_policies(spark, sf_dir):
    """Inherited-weight positions of eight candidates, all months, as one scan per candidate and name."""
    return ledger.inherited_weights(
        static_terms(base.universe(spark, sf_dir), base.rows(spark, sf_dir)), base.stats(spark, sf_dir), GRID_KEYS
    )


GRID_OUT = "method candidate eom gross_return:8 trading_cost:8 exit_cost:8 net_return:8 utility_flow:8 turnover:8 leverage:8 ex_ante_monthly_variance:10"


@register("ledger_grid", GRID_OUT, "SELECT * FROM rets", GRID)
def ledger_grid(spark, sf_dir):
    return grid_returns(spark, sf_dir)


@register("resumed_ledger", GRID_OUT, "SELECT * FROM rets", GRID)
def resumed_ledger(spark, sf_dir):
    """The same ledger in two runs: the second starts from the saved state of the first."""
    rows = base.universe(spark, sf_dir)
    bound, size = base.bound(spark, sf_dir), base.rows(spark, sf_dir)
    early, late = rows.where("eom <= date'1998-06-30'"), rows.where("eom > date'1998-06-30'")
    stats = ledger.month_stats(early, bound)
    held = ledger.inherited_weights(static_terms(early, size), stats, GRID_KEYS).drop("t")
    state = ledger.last_state(held, stats, GRID_KEYS)
    first = ledger.ledger(held, stats, GRID_KEYS, aum=AUM)
    second = ledger.grid_ledger(
        static_terms(late, size), ledger.month_stats(late, bound), GRID_KEYS, aum=AUM, state=state
    )
    return first.unionByName(second)


SELECT_SQL = """
cumulative AS (
  SELECT m.method, m.candidate, y.test_year, coalesce(avg(r.gross_return) - avg(r.trading_cost) - 5e0 * (avg(r.gross_return * r.gross_return) - pow(avg(r.gross_return), 2)), '-inf'::DOUBLE) AS score, count(DISTINCT r.eom) AS validation_months, count(DISTINCT r.test_year) AS validation_years, max(r.test_year) AS latest_validation_year
  FROM (SELECT DISTINCT method, candidate FROM rets) m CROSS JOIN (SELECT DISTINCT test_year FROM rets WHERE test_year > (SELECT min(test_year) FROM rets)) y LEFT JOIN rets r ON r.method = m.method AND r.candidate = m.candidate AND r.test_year < y.test_year GROUP BY 1, 2, 3),
chosen AS (SELECT *, row_number() OVER (PARTITION BY method, test_year ORDER BY score DESC, candidate) = 1 AS selected, coalesce(latest_validation_year >= test_year, false) AS future_information_used FROM cumulative)"""


def selected(spark, sf_dir) -> DataFrame:
    return base.shared(
        spark, sf_dir, "selected",
        lambda: selection.select_cumulative(grid_returns(spark, sf_dir), STATIC_METHODS),
    )


@register(
    "select_cumulative",
    "method candidate test_year score:10 validation_months:bigint validation_years:bigint latest_validation_year selected future_information_used",
    "SELECT * FROM chosen",
    f"{GRID},{SELECT_SQL}",
)
def select_cumulative(spark, sf_dir):
    return selected(spark, sf_dir)


@register(
    "select_split",
    "method candidate test_year validation_utility:8 selected",
    "SELECT *, row_number() OVER (PARTITION BY method, test_year ORDER BY validation_utility DESC, candidate) = 1 AS selected FROM (SELECT method, candidate, y.test_year, 12 * avg(net_return) - 0.5 * 1e1 * 12 * var_samp(net_return) AS validation_utility FROM rets r JOIN (SELECT DISTINCT test_year FROM rets WHERE test_year >= 1998) y ON r.test_year BETWEEN y.test_year - 2 AND y.test_year - 1 GROUP BY 1, 2, 3)",
    GRID,
)
def select_split(spark, sf_dir):
    rows = grid_returns(spark, sf_dir)
    years = rows.select("test_year").distinct().where("test_year >= 1998")
    windows_ = joins.rolling_splits(years, "1995-01-01", 2).where("part = 'validation'").drop("part")
    return selection.select_split(rows, windows_)


@register(
    "selection_stability",
    "method rows:bigint unique_values:bigint changes:bigint modal_value modal_share:8 first_value last_value future_information_violations:bigint cutoff_violations:bigint",
    """SELECT method, CAST(sum(n) AS BIGINT) AS rows, count(*) AS unique_values, CAST(sum(chg) AS BIGINT) AS changes, arg_min(candidate, (-n, candidate)) AS modal_value, max(n) / sum(n)::DOUBLE AS modal_share, arg_min(candidate, f) AS first_value, arg_max(candidate, l) AS last_value, CAST(0 AS BIGINT) AS future_information_violations, CAST(0 AS BIGINT) AS cutoff_violations
    FROM (SELECT method, candidate, count(*) AS n, count(*) FILTER (WHERE chg) AS chg, min(test_year) AS f, max(test_year) AS l FROM (SELECT *, candidate <> lag(candidate) OVER (PARTITION BY method ORDER BY test_year) AS chg FROM chosen WHERE selected) GROUP BY 1, 2) GROUP BY 1""",
    f"{GRID},{SELECT_SQL}",
)
def selection_stability(spark, sf_dir):
    return selection.selection_stability(selected(spark, sf_dir))


@register(
    "walk_forward_returns",
    f"method {METRICS}",
    metrics_sql("method", source="(SELECT r.* FROM rets r JOIN chosen c ON selected AND r.method = c.method AND r.candidate = c.candidate AND r.test_year = c.test_year)"),
    f"{GRID},{SELECT_SQL}",
)
def walk_forward_returns(spark, sf_dir):
    """Out-of-sample metrics of each year's chosen candidate."""
    chosen = selected(spark, sf_dir).where("selected").select("method", "candidate", "test_year")
    rows = grid_returns(spark, sf_dir).join(F.broadcast(chosen), ["method", "candidate", "test_year"])
    return performance.performance(rows)


# Scenarios ----------------------------------------------------------------------------------------

_points = ", ".join([f"('gamma', {g}e0, {g}e0, 1e5)" for g in S.GAMMA_GRID] + [f"('aum', {m}e0, 1e1, {m}e0 * 1e5)" for m in S.AUM_MULTIPLIERS])
SCENARIO = f"""{UNI},
scenario AS (SELECT * FROM (VALUES {_points}) s(axis, point, gamma, aum)),
terms AS (
  SELECT axis, point, gamma, aum, 'static_ml' AS method, entity, u.eom, t, variance, 0.5e0 * mu / (gamma * (variance + 1e-8) + aum / 6e0 * lambda_adv) AS a, aum / 6e0 * lambda_adv / (gamma * (variance + 1e-8) + aum / 6e0 * lambda_adv) AS b, (1e0 + coalesce(ret_exc_lead1m, 0e0)) / growth AS lift FROM uni u JOIN growth USING (eom) CROSS JOIN scenario
  UNION ALL SELECT axis, point, gamma, aum, 'markowitz', entity, u.eom, t, variance, mu / (gamma * (variance + 1e-8)), 0e0, (1e0 + coalesce(ret_exc_lead1m, 0e0)) / growth FROM uni u JOIN growth USING (eom) CROSS JOIN scenario),
{scan_ctes('terms', 'axis, point, gamma, aum, method')},{pricing_ctes('(SELECT axis, point, gamma, aum, method, eom, entity, weight, variance FROM positions)', keys='axis, point, gamma, aum, method', aum='aum', gamma='gamma')},
points AS ({metrics_sql('axis, point, method', gamma='max(gamma)')})"""
SCENARIO_KEYS = ["axis", "point", "gamma", "aum", "method"]


def scenario_returns(spark, sf_dir) -> DataFrame:
    def build():
        times = 2 * (len(S.GAMMA_GRID) + len(S.AUM_MULTIPLIERS))
        rows = selection.scenarios(ranks.by_entity(base.universe(spark, sf_dir), base.rows(spark, sf_dir), times), aum=AUM)
        mu, var, lam = F.col("mu"), F.col("variance"), F.col("lambda_adv")
        a, b = policy.static_terms(mu, var, lam, F.col("gamma"), F.col("aum"), 6.0, 0.5)
        plain = mu / (F.col("gamma") * (var + F.lit(S.COVARIANCE_RIDGE)))
        items = F.array(
            F.struct(F.lit("static_ml").alias("method"), a.alias("a"), b.alias("b")),
            F.struct(F.lit("markowitz").alias("method"), plain.alias("a"), F.lit(0.0).alias("b")),
        )
        terms = rows.select(
            "axis", "point", "gamma", "aum", "eom", "entity", "ret_exc_lead1m", "lambda_adv", "variance", F.inline(items)
        )
        return ledger.grid_ledger(terms, base.stats(spark, sf_dir), SCENARIO_KEYS, aum="aum", gamma="gamma")

    return base.shared(spark, sf_dir, "scenario_returns", build)


def points(spark, sf_dir) -> DataFrame:
    return base.shared(
        spark, sf_dir, "scenario_points", lambda: selection.scenario_points(scenario_returns(spark, sf_dir))
    )


@register(
    "scenarios",
    "segment axis point:4 gamma:4 aum:2",
    f"SELECT segment, s.* FROM (SELECT DISTINCT c_mktsegment AS segment FROM customer) CROSS JOIN (VALUES {_points}) s(axis, point, gamma, aum)",
)
def scenarios(spark, sf_dir):
    """The two scenario axes for each market segment."""
    segments = read(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("segment")).distinct()
    return selection.scenarios(segments, aum=AUM)


POINTS_OUT = "axis point:4 method annualized_net_return:6 annualized_trading_cost:6 annualized_ex_ante_utility_flow:4 average_turnover:6 average_leverage:6 degradation:4"


@register(
    "scenario_points",
    POINTS_OUT,
    "SELECT p.*, CASE WHEN p.axis = 'aum' THEN f.annualized_ex_ante_utility_flow - p.annualized_ex_ante_utility_flow END AS degradation FROM points p LEFT JOIN points f ON f.axis = 'aum' AND f.point = 0 AND f.method = p.method",
    SCENARIO,
)
def scenario_points(spark, sf_dir):
    """Fifteen scenarios of two policies at once: metrics and the loss from the costless point."""
    return points(spark, sf_dir)


@register(
    "check_baseline",
    "column_name max_difference:8 passed",
    f"""SELECT column_name, max(abs(x - y)) AS max_difference, max(abs(x - y)) <= 1e-12 AS passed
    FROM (SELECT * FROM points WHERE axis = 'gamma' AND point = {S.GAMMA}) a JOIN (SELECT * REPLACE (average_turnover + CASE WHEN method = 'markowitz' THEN 1e-6 ELSE 0e0 END AS average_turnover) FROM points WHERE axis = 'aum' AND point = 1) b ON a.method = b.method,
      LATERAL (VALUES ('annualized_net_return', a.annualized_net_return, b.annualized_net_return), ('empirical_utility', a.empirical_utility, b.empirical_utility), ('average_turnover', a.average_turnover, b.average_turnover)) v(column_name, x, y) GROUP BY 1""",
    SCENARIO,
)
def check_baseline(spark, sf_dir):
    """The base point of both axes; one turnover is planted wrong and must be told."""
    wrong = F.expr("axis = 'aum' AND point = 1 AND method = 'markowitz'")
    rows = points(spark, sf_dir).withColumn(
        "average_turnover", F.when(wrong, F.col("average_turnover") + 1e-6).otherwise(F.col("average_turnover"))
    )
    return selection.check_baseline(rows, ["annualized_net_return", "empirical_utility", "average_turnover"])


@register(
    "utility_gaps",
    "axis point:4 markowitz:4 static_ml:4 static_ml_gap:4",
    "SELECT *, static_ml - markowitz AS static_ml_gap FROM (SELECT axis, point, max(CASE WHEN method = 'markowitz' THEN annualized_ex_ante_utility_flow END) AS markowitz, max(CASE WHEN method = 'static_ml' THEN annualized_ex_ante_utility_flow END) AS static_ml FROM points GROUP BY 1, 2)",
    SCENARIO,
)
def utility_gaps(spark, sf_dir):
    return selection.utility_gaps(points(spark, sf_dir), ["markowitz", "static_ml"], "annualized_ex_ante_utility_flow")


# Portfolio policy under diagonal risk -------------------------------------------------------------

X2 = ["rank_discount", "rank_momentum"]
POLICY_PENALTIES = (0.001, 0.1)


def _speed_sql() -> str:
    sql = "SELECT *, (sc + 2 - sqrt(greatest((sc + 2) * (sc + 2) - 4, 0e0))) / 2 AS m0 FROM (SELECT *, 1e1 * variance / (1e5 * lambda_adv) AS sc, 1e0 + variance / pow(1.007e0, 2) AS gv FROM uni)"
    for k in range(S.SPEED_UPDATES):
        sql = f"SELECT *, 1e0 / (sc + 1 + gv - m{k} * gv) AS m{k + 1} FROM ({sql})"
    return f"SELECT *, m{S.SPEED_UPDATES} AS speed FROM ({sql})"


def _z(c: str) -> str:
    return f"CASE WHEN sqrt(sum(c_{c} * c_{c}) OVER (PARTITION BY eom)) > 1e-12 THEN c_{c} / sqrt(sum(c_{c} * c_{c}) OVER (PARTITION BY eom)) ELSE 0e0 END"


DESIGN = f"""{UNI},
speeds AS ({_speed_sql()}),
designed AS (
  SELECT s.*, t, growth, CAST(year(eom) AS INTEGER) AS test_year, {_z('d')} / v AS d1, {_z('m')} / v AS d2, (1e0 + coalesce(ret_exc_lead1m, 0e0)) / growth AS lift FROM
    (SELECT s.*, rank_discount - avg(rank_discount) OVER (PARTITION BY eom) AS c_d, rank_momentum - avg(rank_momentum) OVER (PARTITION BY eom) AS c_m,
      coalesce(CASE WHEN vol_12m >= 0.01e0 THEN vol_12m END, median(CASE WHEN vol_12m >= 0.01e0 THEN vol_12m END) OVER (PARTITION BY eom), 0.05e0) AS v FROM speeds s) s JOIN growth USING (eom)),
marked AS (SELECT *, coalesce(lag(t) OVER (PARTITION BY entity ORDER BY t) = t - 1, false) AS follows, coalesce(lead(t) OVER (PARTITION BY entity ORDER BY t) = t + 1, false) AS stays FROM designed),
bscan AS (
  SELECT entity, t, 0e0 AS i1, 0e0 AS i2, (1 - speed) * d1 AS b1, (1 - speed) * d2 AS b2, lift FROM marked WHERE NOT follows
  UNION ALL SELECT n.entity, n.t, p.b1 * p.lift, p.b2 * p.lift, n.speed * (p.b1 * p.lift) + (1 - n.speed) * n.d1, n.speed * (p.b2 * p.lift) + (1 - n.speed) * n.d2, n.lift FROM bscan p JOIN marked n ON n.entity = p.entity AND n.t = p.t + 1 AND n.follows),
loaded AS (SELECT m.*, b.i1, b.i2, b.b1, b.b2 FROM marked m JOIN bscan b USING (entity, t))"""
STATISTICS = f"""{DESIGN},
ustats AS (
  SELECT k.eom, k.t, s11 + coalesce(e11, 0e0) AS x11, s12 + coalesce(e12, 0e0) AS x12, s22 + coalesce(e22, 0e0) AS x22, r1, r2 FROM (
    SELECT eom, t, sum(1e1 * variance * b1 * b1 + 1e5 * lambda_adv * (b1 - i1) * (b1 - i1)) AS s11, sum(1e1 * variance * b1 * b2 + 1e5 * lambda_adv * (b1 - i1) * (b2 - i2)) AS s12, sum(1e1 * variance * b2 * b2 + 1e5 * lambda_adv * (b2 - i2) * (b2 - i2)) AS s22,
      coalesce(sum(b1 * ret_exc_lead1m), 0e0) AS r1, coalesce(sum(b2 * ret_exc_lead1m), 0e0) AS r2 FROM loaded GROUP BY 1, 2) k
  LEFT JOIN (SELECT t + 1 AS t, sum(1e5 * lambda_adv * b1 * b1 * lift * lift) AS e11, sum(1e5 * lambda_adv * b1 * b2 * lift * lift) AS e12, sum(1e5 * lambda_adv * b2 * b2 * lift * lift) AS e22 FROM loaded WHERE NOT stays GROUP BY 1) e ON e.t = k.t),
training AS (SELECT test_year, count(*) AS n, avg(x11) AS x11, avg(x12) AS x12, avg(x22) AS x22, avg(r1) AS r1, avg(r2) AS r2 FROM ustats JOIN (SELECT DISTINCT CAST(year(eom) AS INTEGER) AS test_year FROM uni) y ON eom <= make_date(test_year - 1, 11, 30) GROUP BY 1),
betas AS (SELECT test_year, n, penalty, (r1 * (x22 + penalty) - r2 * x12) / ((x11 + penalty) * (x22 + penalty) - x12 * x12) AS beta1, (r2 * (x11 + penalty) - r1 * x12) / ((x11 + penalty) * (x22 + penalty) - x12 * x12) AS beta2, x11, x12, x22, r1, r2 FROM training CROSS JOIN (VALUES (0.001e0), (0.1e0)) v(penalty))"""


def designed(spark, sf_dir) -> DataFrame:
    def build():
        rows = portfolio_ml.design(
            base.universe(spark, sf_dir), X2, "vol_12m", constant=False, group_rows=base.bound(spark, sf_dir)
        )
        speed = policy.trading_speed(F.col("variance"), F.col("lambda_adv"), aum=AUM)
        return rows.withColumns({"speed": speed, "test_year": F.year("eom")})

    return base.shared(spark, sf_dir, "designed", build)


def loaded(spark, sf_dir) -> DataFrame:
    return base.shared(
        spark, sf_dir, "loaded", lambda: portfolio_ml.loadings(designed(spark, sf_dir), base.stats(spark, sf_dir))
    )


def betas(spark, sf_dir) -> DataFrame:
    def build():
        monthly = portfolio_ml.utility_statistics(loaded(spark, sf_dir), 2, aum=AUM)
        years = base.stats(spark, sf_dir).select(F.year("eom").alias("test_year")).distinct()
        training = regress.training_moments(monthly, years)
        return portfolio_ml.solve_beta(regress.grid(training, penalty=list(POLICY_PENALTIES)))

    return base.shared(spark, sf_dir, "betas", build)


@register("trading_speed", "eom entity speed:10", "SELECT eom, entity, speed FROM speeds", DESIGN)
def trading_speed(spark, sf_dir):
    speed = policy.trading_speed(F.col("variance"), F.col("lambda_adv"), aum=AUM)
    return base.universe(spark, sf_dir).withColumn("speed", speed)


@register("policy_design", "eom entity d1:8 d2:8", "SELECT eom, entity, d1, d2 FROM designed", DESIGN)
def policy_design(spark, sf_dir):
    rows = designed(spark, sf_dir).join(F.broadcast(base.stats(spark, sf_dir).select("eom")), "eom")
    return rows.select("eom", "entity", F.element_at("design", 1).alias("d1"), F.element_at("design", 2).alias("d2"))


@register(
    "policy_loadings",
    "eom entity b1:8 b2:8 i1:8 i2:8",
    "SELECT eom, entity, b1, b2, i1, i2 FROM loaded",
    DESIGN,
)
def policy_loadings(spark, sf_dir):
    return loaded(spark, sf_dir).where("not dropped").select(
        "eom", "entity", F.element_at("b", 1).alias("b1"), F.element_at("b", 2).alias("b2"),
        F.element_at("inherited_b", 1).alias("i1"), F.element_at("inherited_b", 2).alias("i2"),
    )


@register("policy_statistics", "eom x11:6 x12:6 x22:6 r1:8 r2:8", "SELECT * FROM ustats", STATISTICS)
def policy_statistics(spark, sf_dir):
    m = portfolio_ml.utility_statistics(loaded(spark, sf_dir), 2, aum=AUM)
    return m.select(
        "eom", F.col("xx")[0].alias("x11"), F.col("xx")[1].alias("x12"), F.col("xx")[2].alias("x22"),
        F.col("xy")[0].alias("r1"), F.col("xy")[1].alias("r2"),
    )


@register(
    "policy_beta",
    "test_year penalty:4 n:bigint beta1:8 beta2:8 beta_norm:8 objective:8",
    "SELECT *, sqrt(beta1 * beta1 + beta2 * beta2) AS beta_norm, r1 * beta1 + r2 * beta2 - 0.5e0 * ((x11 + penalty) * beta1 * beta1 + 2 * x12 * beta1 * beta2 + (x22 + penalty) * beta2 * beta2) AS objective FROM betas",
    STATISTICS,
)
def policy_beta(spark, sf_dir):
    """Coefficients of every expanding window and penalty from one pass of month statistics."""
    return betas(spark, sf_dir).withColumns(
        {"beta1": F.element_at("beta", 1), "beta2": F.element_at("beta", 2)}
    )


AIMS = f"""{STATISTICS},
aims AS (SELECT d.*, penalty, d1 * beta1 + d2 * beta2 AS aim FROM designed d JOIN betas b USING (test_year)),
pterms AS (SELECT 'portfolio_ml' AS method, penalty, entity, eom, t, variance, (1 - speed) * aim AS a, speed AS b, lift FROM aims),
{scan_ctes('pterms', 'method, penalty', 'ppos')},{pricing_ctes('(SELECT method, penalty, eom, entity, weight, variance FROM ppos)', keys='method, penalty')}"""


def aims(spark, sf_dir) -> DataFrame:
    rows = designed(spark, sf_dir).join(F.broadcast(base.stats(spark, sf_dir).select("eom")), "eom")
    return portfolio_ml.aim_weights(rows, betas(spark, sf_dir), ["test_year"])


@register("aim_weights", "eom entity penalty:4 aim_weight:8", "SELECT eom, entity, penalty, aim AS aim_weight FROM aims", AIMS)
def aim_weights(spark, sf_dir):
    return aims(spark, sf_dir)


def policy_terms(spark, sf_dir) -> DataFrame:
    rows = portfolio_ml.partial_adjustment(aims(spark, sf_dir)).withColumn("method", F.lit("portfolio_ml"))
    return rows.select(
        "method", "penalty", "eom", "entity", "a", "b", "ret_exc_lead1m", "lambda_adv", "variance", "adv_6m", "aim_weight"
    )


def policy_held(spark, sf_dir) -> DataFrame:
    return base.shared(
        spark, sf_dir, "policy_held",
        lambda: ledger.inherited_weights(policy_terms(spark, sf_dir), base.stats(spark, sf_dir), ["method", "penalty"]).drop("t"),
    )


@register(
    "partial_adjustment",
    "penalty:4 eom entity weight:8",
    "SELECT penalty, eom, entity, weight FROM ppos",
    AIMS,
)
def partial_adjustment(spark, sf_dir):
    """Trade part of the way to the aim each month."""
    return policy_held(spark, sf_dir)


def policy_returns(spark, sf_dir) -> DataFrame:
    return base.shared(
        spark, sf_dir, "policy_returns",
        lambda: ledger.ledger(policy_held(spark, sf_dir), base.stats(spark, sf_dir), ["method", "penalty"], aum=AUM),
    )


@register(
    "portfolio_ml_ledger",
    "penalty:4 eom gross_return:8 trading_cost:8 exit_cost:8 net_return:8 utility_flow:8 turnover:8 leverage:8",
    "SELECT * FROM rets",
    AIMS,
)
def portfolio_ml_ledger(spark, sf_dir):
    return policy_returns(spark, sf_dir)


SETS = {"none": [], "discount": ["rank_discount"], "momentum": ["rank_momentum"]}
NEUTRAL = f"""{STATISTICS},
naims AS (SELECT s.name AS method, d.entity, d.eom, d.t, d.variance, d.speed, d.lift, d1 * beta1 * s.k1 + d2 * beta2 * s.k2 AS aim FROM designed d JOIN betas b USING (test_year) CROSS JOIN (VALUES ('none', 1e0, 1e0), ('discount', 0e0, 1e0), ('momentum', 1e0, 0e0)) s(name, k1, k2) WHERE penalty = 0.1e0),
nterms AS (SELECT method, entity, eom, t, variance, (1 - speed) * aim AS a, speed AS b, lift FROM naims),
{scan_ctes('nterms', 'method', 'npos')},{pricing_ctes('(SELECT method, eom, entity, weight, variance FROM npos)')},
nmetrics AS ({metrics_sql('method')})"""


def neutral_returns(spark, sf_dir) -> DataFrame:
    """The policy with each feature set neutral in turn, priced with the fitted coefficients."""
    def build():
        rows = portfolio_ml.neutralize(base.universe(spark, sf_dir), SETS, X2)
        by = ["neutralized", "eom"]
        rows = portfolio_ml.design(
            rows, X2, "vol_12m", constant=False, group_rows=base.bound(spark, sf_dir), by=by
        ).withColumns(
            {"speed": policy.trading_speed(F.col("variance"), F.col("lambda_adv"), aum=AUM), "test_year": F.year("eom")}
        )
        fixed = betas(spark, sf_dir).where("penalty = 0.1")
        terms = portfolio_ml.partial_adjustment(portfolio_ml.aim_weights(rows, fixed, ["test_year"])).select(
            "neutralized", "eom", "entity", "a", "b", "ret_exc_lead1m", "lambda_adv", "variance"
        )
        return ledger.grid_ledger(terms, base.stats(spark, sf_dir), ["neutralized"], aum=AUM)

    return base.shared(spark, sf_dir, "neutral_returns", build)


@register(
    "neutralized_metrics",
    f"neutralized {METRICS}",
    "SELECT * RENAME (method AS neutralized) FROM nmetrics",
    NEUTRAL,
)
def neutralized_metrics(spark, sf_dir):
    return performance.performance(neutral_returns(spark, sf_dir), by=["neutralized"])


@register(
    "importance",
    "scope neutralized importance:6 share:6 place:bigint",
    "SELECT 'full' AS scope, neutralized, importance, CASE WHEN sum(greatest(importance, 0e0)) OVER () > 0 THEN greatest(importance, 0e0) / sum(greatest(importance, 0e0)) OVER () END AS share, rank() OVER (ORDER BY importance DESC) AS place FROM "
    "(SELECT n.method AS neutralized, f.annualized_ex_ante_utility_flow - n.annualized_ex_ante_utility_flow AS importance FROM nmetrics n JOIN nmetrics f ON f.method = 'none' WHERE n.method <> 'none')",
    NEUTRAL,
)
def importance(spark, sf_dir):
    """Utility lost when a feature is neutral: amount, share and rank."""
    metrics = performance.performance(neutral_returns(spark, sf_dir), by=["neutralized"]).withColumn("scope", F.lit("full"))
    value = "annualized_ex_ante_utility_flow"
    return selection.importance(
        metrics.where("neutralized = 'none'"), metrics.where("neutralized <> 'none'"), value, ["scope"]
    )


# Mechanisms and checks of the ledger --------------------------------------------------------------

MECHANISM = f"""{RETURNS},
deciles AS (SELECT eom, entity, adv_6m, greatest(1, ceil((rn - 1) * 10 / (n - 1)::DOUBLE)) AS decile FROM (SELECT *, row_number() OVER (PARTITION BY eom ORDER BY adv_6m, entity) AS rn, count(*) OVER (PARTITION BY eom) AS n FROM uni)),
stock AS (SELECT m.eom, c.method, c.entity, weight, inherited, weight - inherited AS trade, lambda_adv, adv_6m, decile, abs(weight) AS aw, 0.5e0 * 1e5 * lambda_adv * pow(weight - inherited, 2) AS cost, weight - inherited AS aim_delta
  FROM carried c JOIN months m USING (t) JOIN deciles d ON d.eom = m.eom AND d.entity = c.entity WHERE NOT dropped),
placed AS (SELECT *, row_number() OVER (PARTITION BY eom, method ORDER BY cost DESC, entity) AS rc, row_number() OVER (PARTITION BY eom, method ORDER BY abs(trade) DESC, entity) AS rt, count(*) OVER (PARTITION BY eom, method) AS n FROM stock),
mech AS (SELECT eom, method, sum(cost) AS within_cost, sum(aw) AS gross_weight, CASE WHEN sum(aw) > 0 THEN sum(adv_6m * aw) / sum(aw) END AS weighted_adv, CASE WHEN sum(aw) > 0 THEN sum(CASE WHEN decile = 1 THEN aw ELSE 0e0 END) / sum(aw) END AS low_adv_share,
  CASE WHEN sum(aw) > 0 THEN sum(CASE WHEN decile = 10 THEN aw ELSE 0e0 END) / sum(aw) END AS high_adv_share, CASE WHEN sum(cost) > 0 THEN sum(CASE WHEN rc <= greatest(1, ceil(0.1e0 * n)) THEN cost END) / sum(cost) END AS top_names_cost_share,
  CASE WHEN sum(cost) > 0 THEN sum(CASE WHEN rt <= greatest(1, ceil(0.1e0 * n)) THEN cost END) / sum(cost) END AS top_trades_cost_share, sum(abs(trade)) AS trade_l1, sqrt(sum(trade * trade)) AS trade_l2, sqrt(sum(lambda_adv * trade * trade)) AS trade_lambda FROM placed GROUP BY 1, 2)"""


def _mechanisms(spark, sf_dir) -> DataFrame:
    def build():
        held = base.held(spark, sf_dir).withColumn("aim_weight", F.col("weight"))
        carried = ledger.carry_positions(held, base.stats(spark, sf_dir), carry=["adv_6m", "aim_weight"])
        deciles = windows.liquidity_decile(base.universe(spark, sf_dir), "adv_6m", base.bound(spark, sf_dir))
        return ledger.mechanisms(carried, deciles, AUM, base.bound(spark, sf_dir))

    return base.shared(spark, sf_dir, "mechanisms", build)


MECH = "within_cost:8 gross_weight:8 weighted_adv:4 low_adv_share:8 high_adv_share:8 top_names_cost_share:8 top_trades_cost_share:8 trade_l1:8 trade_l2:8 trade_lambda:10"


@register("mechanisms", f"eom method {MECH} l1_ratio:6", "SELECT *, CASE WHEN trade_l1 > 0 THEN 1e0 END AS l1_ratio FROM mech", MECHANISM)
def mechanisms(spark, sf_dir):
    """Stock-level costs and distances; these policies trade all the way to their weights (``mechanism_aims`` has one that doesn't)."""
    return _mechanisms(spark, sf_dir)


@register(
    "mechanism_aims",
    "eom method penalty:4 trade_l1:8 aim_l1:8 l1_ratio:6 lambda_ratio:6 aim_cost:8",
    """SELECT m.eom, c.method, c.penalty, sum(abs(weight - inherited)) AS trade_l1, sum(abs(aim - inherited)) AS aim_l1,
      CASE WHEN sum(abs(aim - inherited)) > 0 THEN sum(abs(weight - inherited)) / sum(abs(aim - inherited)) END AS l1_ratio,
      CASE WHEN sum(c.lambda_adv * pow(aim - inherited, 2)) > 0 THEN sqrt(sum(c.lambda_adv * pow(weight - inherited, 2))) / sqrt(sum(c.lambda_adv * pow(aim - inherited, 2))) END AS lambda_ratio,
      sum(0.5e0 * 1e5 * c.lambda_adv * pow(aim - inherited, 2)) AS aim_cost
    FROM carried c JOIN months m USING (t) JOIN aims a ON a.penalty = c.penalty AND a.entity = c.entity AND a.t = c.t
    WHERE NOT dropped GROUP BY m.eom, c.method, c.penalty""",
    AIMS,
)
def mechanism_aims(spark, sf_dir):
    """How far the learned policy trades of the way to its own aim, in weights and in cost distance."""
    keys = ["method", "penalty"]
    carried = ledger.carry_positions(
        policy_held(spark, sf_dir), base.stats(spark, sf_dir), keys, carry=["adv_6m", "aim_weight"]
    )
    deciles = windows.liquidity_decile(base.universe(spark, sf_dir), "adv_6m", base.bound(spark, sf_dir))
    return ledger.mechanisms(carried, deciles, AUM, base.bound(spark, sf_dir), by=["eom", *keys])


MECH_COLUMNS = ("low_adv_share", "high_adv_share", "trade_l1", "weighted_adv")


@register(
    "mechanism_scopes",
    "scope method eom year low_adv_share:8 trade_l1:8 exit_share:8 coverage:8 cost_to_gross:4 near_zero_gross cumulative_return:8 drawdown:8",
    """SELECT 'month' AS scope, r.method, r.eom, CAST(year(r.eom) AS INTEGER) AS year, low_adv_share, trade_l1, CASE WHEN trading_cost > 0 THEN exit_cost / trading_cost END AS exit_share, CASE WHEN trading_cost > 0 THEN within_cost / trading_cost END AS coverage, trading_cost / greatest(abs(gross_return), 1e-4) AS cost_to_gross, abs(gross_return) < 1e-4 AS near_zero_gross, wealth - 1 AS cumulative_return,
      wealth / max(wealth) OVER (PARTITION BY r.method ORDER BY r.eom) - 1 AS drawdown FROM (SELECT *, product(1 + net_return) OVER (PARTITION BY method ORDER BY eom) AS wealth FROM rets) r JOIN mech USING (eom, method)
    UNION ALL SELECT 'year', r.method, NULL, CAST(year(r.eom) AS INTEGER), avg(low_adv_share), avg(trade_l1), avg(CASE WHEN trading_cost > 0 THEN exit_cost / trading_cost END), NULL, 12 * avg(trading_cost) / greatest(abs(12 * avg(gross_return)), 0.005e0), abs(12 * avg(gross_return)) < 0.005, NULL, NULL FROM rets r JOIN mech USING (eom, method) GROUP BY r.method, year(r.eom)""",
    MECHANISM,
)
def mechanism_scopes(spark, sf_dir):
    monthly = base.returns(spark, sf_dir).join(_mechanisms(spark, sf_dir), ["eom", "method"])
    paths = performance.wealth_path(base.returns(spark, sf_dir), ["method"], "net_return").drop("net_return")
    return ledger.mechanism_scopes(monthly, paths, MECH_COLUMNS)


@register(
    "reconcile_ledger",
    "method months:bigint passed",
    f"""SELECT method, count(*) AS months, max(abs(cost - (trading_cost - exit_cost))) <= 1e-12 AND max(abs(utility_flow - (net_return - 0.5e0 * {S.GAMMA} * ex_ante_monthly_variance))) <= 1e-12 AS passed
    FROM (SELECT eom, method, 1e5 / 2 * sum(lambda_adv * pow(weight - inherited, 2)) AS cost FROM carried JOIN months USING (t) WHERE NOT dropped GROUP BY 1, 2)
    JOIN (SELECT * REPLACE (trading_cost + CASE WHEN method = 'top_bottom' AND month(eom) = 7 THEN 1e-6 ELSE 0e0 END AS trading_cost) FROM rets) USING (eom, method) GROUP BY 1""",
    RETURNS,
)
def reconcile_ledger(spark, sf_dir):
    """Costs rebuilt from positions; those of one policy are planted wrong every July and must not pass."""
    carried = ledger.carry_positions(base.held(spark, sf_dir), base.stats(spark, sf_dir))
    wrong = (F.col("method") == "top_bottom") & (F.month("eom") == 7)
    rows = base.returns(spark, sf_dir).withColumn(
        "trading_cost", F.col("trading_cost") + F.when(wrong, F.lit(1e-6)).otherwise(0.0)
    )
    return ledger.reconcile_ledger(carried, rows, ["method"], AUM)


@register(
    "ledger_warnings",
    "eom method kind warning",
    "SELECT eom, method, kind, CAST(eom AS VARCHAR) || ': ' || method || ' ' || kind AS warning FROM (SELECT eom, method, 'max abs weight' AS kind FROM rets WHERE max_abs_weight > 0.06 UNION ALL SELECT eom, method, 'leverage' FROM rets WHERE leverage > 1.5)",
    RETURNS,
)
def ledger_warnings(spark, sf_dir):
    return ledger.ledger_warnings(base.returns(spark, sf_dir), 0.06, 1.5)


@register(
    "pending",
    "method candidate test_year",
    "SELECT DISTINCT method, candidate, test_year FROM rets WHERE NOT (test_year <= 1998 OR (test_year = 1999 AND method = 'static_ml'))",
    GRID,
)
def pending(spark, sf_dir):
    """(candidate, year) keys of the grid that a half-finished run still owes."""
    rows = grid_returns(spark, sf_dir)
    done = rows.where("test_year <= 1998 or (test_year = 1999 and method = 'static_ml')")
    expected = rows.select("method", "candidate", "test_year").distinct()
    return selection.pending(expected, done, ["method", "candidate", "test_year"])


@register(
    "gate",
    "method max_leverage:8 mean_turnover:8 bad_rows:bigint leverage_ok turnover_ok values_ok passed",
    "SELECT *, leverage_ok AND turnover_ok AND values_ok AS passed FROM (SELECT method, max(leverage) AS max_leverage, avg(turnover) AS mean_turnover, CAST(0 AS BIGINT) AS bad_rows, max(leverage) <= 1.5 AS leverage_ok, avg(turnover) <= 1.2 AS turnover_ok, true AS values_ok FROM rets GROUP BY 1)",
    RETURNS,
)
def gate(spark, sf_dir):
    return selection.gate(base.returns(spark, sf_dir), 1.5, 1.2)


DISPLAY = {"equal_weight": "1/N", "rank_long_short": "Rank", "top_bottom": "Top-bottom", "markowitz": "Mean-variance"}


@register(
    "consolidate",
    "place:bigint specification method display annualized_net_return:8",
    "SELECT row_number() OVER (ORDER BY CASE specification WHEN 'early' THEN 1 ELSE 2 END, CASE method WHEN 'equal_weight' THEN 1 WHEN 'rank_long_short' THEN 2 WHEN 'top_bottom' THEN 3 ELSE 4 END) AS place, specification, method, CASE method WHEN 'equal_weight' THEN '1/N' WHEN 'rank_long_short' THEN 'Rank' WHEN 'top_bottom' THEN 'Top-bottom' ELSE 'Mean-variance' END AS display, annualized_net_return FROM "
    "(SELECT 'early' AS specification, method, 12 * avg(net_return) AS annualized_net_return FROM rets WHERE test_year < 1998 GROUP BY 2 UNION ALL SELECT 'late', method, 12 * avg(net_return) FROM rets WHERE test_year >= 1998 GROUP BY 2)",
    RETURNS,
)
def consolidate(spark, sf_dir):
    rows = base.returns(spark, sf_dir)
    return selection.consolidate(
        {
            "early": performance.performance(rows.where("test_year < 1998")),
            "late": performance.performance(rows.where("test_year >= 1998")),
        },
        base.METHODS, DISPLAY,
    )
