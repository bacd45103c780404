"""Positions, costs, exits, states, policies: hand values and brute force on small tables."""

from __future__ import annotations

from decimal import Decimal, localcontext
from fractions import Fraction

import numpy as np
import pandas as pd
import pytest
from conftest import month
from pyspark.sql import functions as F

from crosspanel import settings as S
from crosspanel.operators import ledger, policy, portfolio_ml, regress, risk, scaling

PANEL = "eom date, entity long, ret_exc_lead1m double, lambda_adv double, lag_mktcap double"
HELD = "method string, eom date, entity long, weight double, ret_exc_lead1m double, lambda_adv double"


def test_trade_cost(spark):
    """AUM 100: moving 0.1 between two names."""
    panel = spark.createDataFrame(
        [(month(m), e, 0.0, lam, 1.0) for m in (0, 1) for e, lam in ((1, 0.01), (2, 0.02))], PANEL
    )
    held = spark.createDataFrame(
        [("p", month(0), 2, 0.4, 0.0, 0.02), ("p", month(0), 1, 0.6, 0.0, 0.01),
         ("p", month(1), 1, 0.5, 0.1, 0.01), ("p", month(1), 2, 0.5, -0.1, 0.02)], HELD,
    )
    out = ledger.ledger(held, ledger.month_stats(panel, 10), aum=100.0).where(F.col("t") == 2).first()
    assert out["trading_cost"] == pytest.approx(50.0 * (0.01 * 0.01 + 0.02 * 0.01))
    assert out["turnover"] == pytest.approx(0.2)
    assert out["leverage"] == pytest.approx(1.0)


def test_exit_cost(spark):
    """A name that leaves pays its last impact parameter."""
    panel = spark.createDataFrame(
        [(month(0), 1, 0.0, 0.01, 1.0), (month(0), 2, 0.0, 0.02, 1.0), (month(1), 1, 0.0, 0.01, 1.0)], PANEL
    )
    held = spark.createDataFrame(
        [("p", month(0), 1, 0.6, 0.0, 0.01), ("p", month(0), 2, 0.4, 0.0, 0.02), ("p", month(1), 1, 0.6, 0.0, 0.01)], HELD
    )
    stats = ledger.month_stats(panel, 10)
    out = ledger.ledger(held, stats, aum=100.0).where(F.col("t") == 2).first()
    assert out["exit_cost"] == pytest.approx(50.0 * 0.02 * 0.16)
    assert out["dropped_names"] == 1
    gone = ledger.dropped(ledger.carry_positions(held, stats)).collect()
    assert [r["entity"] for r in gone] == [2]


def random_panel(spark, months=14, names=12, seed=5):
    rng = np.random.default_rng(seed)
    rows = []
    for t in range(months):
        for e in range(names):
            if rng.random() < 0.2:
                continue
            ret = None if rng.random() < 0.05 else float(rng.normal(0, 0.05))
            rows.append(
                (month(t), e, ret, float(rng.uniform(0.5, 2.0) * 1e-3), float(rng.uniform(1, 9)) if t else None,
                 float(rng.normal(0, 0.01)), float(rng.uniform(0.002, 0.01)), float(rng.random()), float(rng.random()))
            )
    schema = PANEL + ", mu double, variance double, x double, y double"
    pdf = pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])
    return spark.createDataFrame(rows, schema), pdf.astype({"ret_exc_lead1m": float, "lag_mktcap": float})


def growth_path(pdf):
    """Month number -> growth carried into the next month."""
    out, g = {}, 1.0
    for t, (_, m) in enumerate(pdf.groupby("eom"), start=1):
        ok = m["lag_mktcap"].notna() & m["ret_exc_lead1m"].notna()
        if ok.any():
            g = max(1.0 + np.average(m["ret_exc_lead1m"][ok], weights=m["lag_mktcap"][ok]), 0.1)
        out[t] = g
    return out


def brute_force(pdf, choose, aum, gamma, start=None):
    """Month by month: inherited, weights, costs."""
    growth = growth_path(pdf)
    held = pd.Series(dtype=float) if start is None else start
    lam_before, rows = pd.Series(dtype=float), []
    for t, (eom, m) in enumerate(pdf.groupby("eom"), start=1):
        m = m.set_index("entity").sort_index()
        inherited = held.reindex(m.index).fillna(0.0)
        gone = held[~held.index.isin(m.index)]
        w = choose(m, inherited)
        trade = w - inherited
        lam_gone = lam_before.reindex(gone.index).fillna(m["lambda_adv"].median())
        exit_cost = aum / 2 * float((lam_gone * gone**2).sum())
        cost = aum / 2 * float((m["lambda_adv"] * trade**2).sum()) + exit_cost
        ret = m["ret_exc_lead1m"].fillna(0.0)
        rows.append((eom, float((w * ret).sum()), cost, exit_cost, float(trade.abs().sum() + gone.abs().sum())))
        held, lam_before = w * (1 + ret) / growth[t], m["lambda_adv"]
    return pd.DataFrame(rows, columns=["eom", "gross_return", "trading_cost", "exit_cost", "turnover"])


def close(df, want):
    got = df.toPandas().sort_values("eom").reset_index(drop=True)
    for c in want.columns[1:]:
        np.testing.assert_allclose(got[c], want[c], rtol=1e-10, atol=1e-14, err_msg=c)


@pytest.mark.parametrize("star", [False, True])
def test_static_policies_against_a_month_loop(spark, star):
    df, pdf = random_panel(spark)
    aum, gamma = 50.0, 10.0
    mu, var, lam = F.col("mu"), F.col("variance"), F.col("lambda_adv")
    if star:
        a, b = policy.static_star_terms(mu, var, lam, gamma, aum, 0.5, 0.25, 2.0)
        lhs = lambda m: gamma * (m["variance"] * 1.25 + 1e-8) + aum * 2.0 * m["lambda_adv"]
        choose = lambda m, i: (0.5 * m["mu"] + aum * 2.0 * m["lambda_adv"] * i) / lhs(m)
    else:
        a, b = policy.static_terms(mu, var, lam, gamma, aum, 3.0, 0.25)
        lhs = lambda m: gamma * (m["variance"] + 1e-8) + aum / 3.0 * m["lambda_adv"]
        choose = lambda m, i: (0.25 * m["mu"] + aum / 3.0 * m["lambda_adv"] * i) / lhs(m)
    terms = df.select(F.lit("p").alias("method"), "eom", "entity", "ret_exc_lead1m", "lambda_adv", a.alias("a"), b.alias("b"))
    close(ledger.grid_ledger(terms, ledger.month_stats(df, 100), ["method"], aum=aum), brute_force(pdf, choose, aum, gamma))


def test_value_weighted_start(spark):
    """Month one inherits cap weights; without caps it inherits equal weights."""
    df, pdf = random_panel(spark)
    aum = 50.0
    stats = ledger.month_stats(df, 100)
    keys = spark.createDataFrame([("p",)], "method string")
    state = ledger.value_weighted_state(df, stats, keys)
    a, b = policy.static_terms(F.col("mu"), F.col("variance"), F.col("lambda_adv"), 10.0, aum, 3.0, 0.25)
    terms = df.select(F.lit("p").alias("method"), "eom", "entity", "ret_exc_lead1m", "lambda_adv", a.alias("a"), b.alias("b"))
    first = pdf[pdf["eom"] == pdf["eom"].min()]["entity"]
    start = pd.Series(1.0 / len(first), index=sorted(first))
    choose = lambda m, i: (0.25 * m["mu"] + aum / 3.0 * m["lambda_adv"] * i) / (
        10.0 * (m["variance"] + 1e-8) + aum / 3.0 * m["lambda_adv"]
    )
    close(ledger.grid_ledger(terms, stats, ["method"], aum=aum, state=state), brute_force(pdf, choose, aum, 10.0, start))


def test_speed_solves_its_condition(spark):
    """Ten substitutions are the diagonal of the recorded 2 x 2 case's routine; large risk keeps its digits."""
    df, pdf = random_panel(spark)
    for aum in (1e3, 1e-9):
        got = df.select("eom", "entity", policy.trading_speed(F.col("variance"), F.col("lambda_adv"), aum=aum).alias("m"))
        m = pdf.merge(got.toPandas(), on=["eom", "entity"])
        r = [Fraction(10.0) * Fraction(v) / (Fraction(aum) * Fraction(l)) for v, l in zip(m["variance"], m["lambda_adv"])]
        for ri, v, kept in zip(r, m["variance"], m["m"]):
            c = 1 + Fraction(v) / Fraction(1.007) ** 2
            with localcontext(prec=60):
                rd = Decimal(ri.numerator) / Decimal(ri.denominator)
                x = ((rd + 2) - ((rd + 2) ** 2 - 4).sqrt()) / 2
                for _ in range(10):
                    x = 1 / (rd + 1 + (1 - x) * Decimal(c.numerator) / Decimal(c.denominator))
            assert kept == pytest.approx(float(x), rel=1e-10)
    free = df.select(policy.trading_speed(F.col("variance"), F.col("lambda_adv"), aum=0.0).alias("m"))
    assert free.distinct().collect() == [(0.0,)]


def factored(spark, df, seed=2):
    rng = np.random.default_rng(seed)
    half = rng.normal(size=(2, 2)) * 0.05
    cov = half @ half.T
    rows = df.withColumn("loadings", F.array(F.lit(1.0), F.col("x"))).withColumn("idio_variance", F.col("variance"))
    dates = df.select("eom").distinct().withColumn(
        "factor_cov", F.array(*[F.array(*[F.lit(float(v)) for v in r]) for r in cov])
    )
    return rows, dates, cov


@pytest.mark.parametrize("s, c, v", [(0.25, 1 / 3.0, 0.0), (0.5, 2.0, 0.25)])
def test_static_factored_against_dense_solve(spark, s, c, v):
    df, pdf = random_panel(spark)
    rows, matrices, cov = factored(spark, df)
    rows = risk.entity_variance(rows, matrices).withColumn("inherited", F.col("x") * 0.02)
    got = risk.static_factored(rows, matrices, "mu", "inherited", ["a", "b"], s, c, v, aum=50.0).toPandas()
    for eom, m in got.groupby("eom"):
        b = np.column_stack([np.ones(len(m)), m["x"]])
        sigma = b @ cov @ b.T + np.diag(m["variance"])
        pull = np.diag(50.0 * c * m["lambda_adv"])
        lhs = 10.0 * (sigma + v * np.diag(np.diag(sigma)) + 1e-8 * np.eye(len(m))) + pull
        want = np.linalg.solve(lhs, s * m["mu"] + pull @ m["inherited"])
        np.testing.assert_allclose(m["weight"], want, rtol=1e-8, atol=1e-12)


def test_ewma_of_a_long_series(spark):
    """Weights (1-a)^age over more days than their inverse powers would stand."""
    rng = np.random.default_rng(5)
    days = pd.DataFrame({"d": range(4000), "x": rng.normal(size=4000), "y": rng.normal(size=4000), "f": "p"})
    got = regress.ewma_moments(spark.createDataFrame(days), ["f"], "d", "x", "y", 5).toPandas().set_index("d")
    for at in (0, 1, 7, 3999):
        w = (1 - 2 / 6) ** np.arange(at, -1, -1.0)
        x, y = days["x"][: at + 1], days["y"][: at + 1]
        want = (w * x * y).sum() / w.sum() - (w * x).sum() * (w * y).sum() / w.sum() ** 2
        assert got.loc[at, "covariance"] == pytest.approx(want, abs=1e-12)


def test_two_rows_of_a_month_are_an_error(spark):
    rows = spark.createDataFrame([(1, 1, 1.0, 0.5), (1, 2, 1.0, 0.5), (1, 2, 1.0, 0.5)], "entity long, t int, a double, b double")
    with pytest.raises(Exception, match="two rows of one t"):
        ledger.affine_scan(rows, ["entity"], "t", "a", "b", "x").collect()


def test_factored_markowitz_against_dense_solve(spark):
    df, pdf = random_panel(spark)
    rows, matrices, cov = factored(spark, df)
    got = risk.markowitz_factored(rows, matrices, "mu", ["a", "b"]).select("eom", "entity", "weight").toPandas()
    for eom, m in pdf.groupby("eom"):
        b = np.column_stack([np.ones(len(m)), m["x"]])
        sigma = b @ cov @ b.T + np.diag(m["variance"]) + 1e-8 * np.eye(len(m))
        want = np.linalg.solve(10.0 * sigma, m["mu"].to_numpy())
        part = m.merge(got[got["eom"] == eom], on="entity")
        np.testing.assert_allclose(part["weight"], want, rtol=1e-8, atol=1e-12)


@pytest.mark.parametrize("width", [3, 30])
def test_portfolio_statistics_against_a_month_loop(spark, width):
    """Loadings and utility sums with entries and exits, for a narrow and a wide design."""
    df, pdf = random_panel(spark, months=8)
    rng = np.random.default_rng(9)
    freq = rng.normal(size=width)
    arrays = F.array(*[F.sin(F.lit(float(f)) * F.col("x") + F.col("y")) for f in freq])
    rows = df.withColumn("design", arrays).withColumn(
        "speed", policy.trading_speed(F.col("variance"), F.col("lambda_adv"), aum=50.0)
    )
    stats = ledger.month_stats(df, 100)
    got = portfolio_ml.utility_statistics(portfolio_ml.loadings(rows, stats), width, 10.0, 50.0).toPandas().set_index("eom")
    speeds = rows.select("eom", "entity", "speed").toPandas()
    full = pdf.merge(speeds, on=["eom", "entity"])
    growth = growth_path(pdf)
    before, lam_before = pd.DataFrame(), pd.Series(dtype=float)
    for t, (eom, m) in enumerate(full.groupby("eom"), start=1):
        m = m.set_index("entity").sort_index()
        design = np.sin(np.outer(m["x"], freq) + m["y"].to_numpy()[:, None])
        inherited = before.reindex(m.index).fillna(0.0).to_numpy() if len(before) else np.zeros_like(design)
        s = m["speed"].to_numpy()[:, None]
        b = s * inherited + (1 - s) * design
        d = b - inherited
        want = 10.0 * b.T @ (m["variance"].to_numpy()[:, None] * b) + 50.0 * d.T @ (m["lambda_adv"].to_numpy()[:, None] * d)
        if len(before):
            gone = before[~before.index.isin(m.index)]
            lam = lam_before.reindex(gone.index).fillna(m["lambda_adv"].median()).to_numpy()[:, None]
            want = want + 50.0 * gone.to_numpy().T @ (lam * gone.to_numpy())
        reward = b.T @ m["ret_exc_lead1m"].fillna(0.0).to_numpy()
        np.testing.assert_allclose(regress._full(np.array([got.loc[eom, "xx"]]), width)[0], want, rtol=1e-9, atol=1e-12)
        np.testing.assert_allclose(got.loc[eom, "xy"], reward, rtol=1e-9, atol=1e-12)
        lift = (1 + m["ret_exc_lead1m"].fillna(0.0).to_numpy())[:, None] / growth[t]
        before, lam_before = pd.DataFrame(b * lift, index=m.index), m["lambda_adv"]


def test_beta_solves_the_quadratic(spark):
    rng = np.random.default_rng(1)
    half = rng.normal(size=(4, 4))
    h, r = half @ half.T * 6, rng.normal(size=4) * 6
    packed = h[np.triu_indices(4)]
    rows = spark.createDataFrame([(packed.tolist(), r.tolist(), 6, p) for p in (0.0, 0.5)], "xx array<double>, xy array<double>, n long, penalty double")
    for row in portfolio_ml.solve_beta(rows).collect():
        want = np.linalg.solve(h / 6 + max(row["penalty"], 1e-10) * np.eye(4), r / 6)
        np.testing.assert_allclose(row["beta"], want, rtol=1e-8)
        assert row["gradient_norm"] < 1e-10


def test_diagonal_risk_imputes_the_median(spark):
    df = spark.createDataFrame([(month(0), 1, 0.1), (month(0), 2, None), (month(0), 3, 0.3)], "eom date, entity long, vol_12m double")
    got = {r["entity"]: r for r in risk.diagonal_risk(df, group_rows=3).collect()}
    assert got[2]["variance"] == pytest.approx(0.04)
    assert [e for e, r in got.items() if r["variance_imputed"]] == [2]


def test_factor_risk_case(spark):
    """Loadings 1, 0, -1; the third name takes the median idiosyncratic variance."""
    panel = spark.createDataFrame([(month(0), e) for e in (1, 2, 3)], "eom date, entity long")
    loads = spark.createDataFrame([(month(0), 1, 1.0), (month(0), 2, 0.0), (month(0), 3, -1.0)], "eom date, entity long, f double")
    idio = spark.createDataFrame([(month(0), 1, 1e-4), (month(0), 2, 2e-4), (month(0), 3, None)], "eom date, entity long, idio_var double")
    cov = spark.createDataFrame([(month(0), "f", "f", 1e-4)], "eom date, factor_1 string, factor_2 string, covariance double")
    rows = risk.factor_risk(panel, loads, idio, ["f"], group_rows=3)
    matrices = risk.covariance_matrices(cov, ["f"])
    got = {r["entity"]: r for r in risk.entity_variance(rows, matrices).collect()}
    assert got[3]["idio_variance"] == pytest.approx(21 * 1.5e-4)
    assert got[1]["factor_total_variance"] == pytest.approx(21 * 2e-4)
    held = rows.withColumn("weight", F.lit(0.5)).withColumn("method", F.lit("p")).where("entity in (1, 3)")
    pair = risk.portfolio_variance(held, matrices, ["f"]).first()
    assert pair["factor_variance"] == pytest.approx(0.0, abs=1e-18)  # the two names offset each other
    cover = risk.risk_coverage(rows, matrices).first()
    assert not cover["usable"] and cover["missing_idio"] == 1


def test_portfolio_variance_is_the_dense_form(spark):
    df, pdf = random_panel(spark)
    rows, matrices, cov = factored(spark, df)
    held = rows.withColumns({"weight": F.col("mu") * 30, "method": F.lit("p")})
    got = risk.portfolio_variance(held, matrices, ["a", "b"]).toPandas().set_index("eom")["ex_ante_monthly_variance"]
    for eom, m in pdf.groupby("eom"):
        b = np.column_stack([np.ones(len(m)), m["x"]])
        w = 30 * m["mu"].to_numpy()
        assert got[eom] == pytest.approx(w @ (b @ cov @ b.T + np.diag(m["variance"])) @ w, rel=1e-10)


def test_unit_norm(spark):
    df, _ = random_panel(spark)
    flat = df.withColumn("flat", F.lit(0.7))
    got = scaling.unit_norm(flat, ["x", "flat"], constant="z_one").toPandas()
    for _, m in got.groupby("eom"):
        assert (m["z_x"] ** 2).sum() == pytest.approx(1.0)
        assert m["z_x"].sum() == pytest.approx(0.0, abs=1e-12)
        assert (m["z_flat"] == 0).all()
        assert (m["z_one"] ** 2).sum() == pytest.approx(1.0)


def test_grid_ledger_shuffles_twice(spark):
    """One shuffle for positions and carries together, one small one for the month sums."""
    df, _ = random_panel(spark, months=3)
    a, b = policy.static_terms(F.col("mu"), F.col("variance"), F.col("lambda_adv"), 10.0, 50.0, 3.0, 0.25)
    terms = df.select(F.when(F.col("x") < 2, "p").alias("method"), "eom", "entity", "ret_exc_lead1m", "lambda_adv", a.alias("a"), b.alias("b"))
    months = ledger.month_stats(df, 100).collect()
    stats = spark.createDataFrame(months, ledger.month_stats(df, 100).schema)
    plan = ledger.grid_ledger(terms, stats, ["method"], aum=50.0)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_policies_are_shuffled_before_they_multiply_rows(spark, sf_dir, monkeypatch):
    """Scenarios, candidates and methods are made after the one shuffle by entity."""
    from crosspanel.operators import ranks
    from crosspanel.plans import base, policies

    monkeypatch.setattr(ranks, "FOLD_ROWS", 1000)

    def plan(df):
        return df._jdf.queryExecution().executedPlan().toString()

    for made in (policies.static_policies(spark, sf_dir), ledger.carry_positions(base.held(spark, sf_dir), base.stats(spark, sf_dir))):
        text = plan(made)
        assert "hashpartitioning(entity" in text and "hashpartitioning(method" not in text


def test_own_factor_risk_joins_nothing(spark):
    """A panel that holds its exposures and variances gives the rows of the joined tables, without a shuffle of its names."""
    rows = [(i, month(m), float(i * m) / 3, 1e-4 * (i + 1) if (i + m) % 4 else None) for i in range(12) for m in range(3)]
    panel = spark.createDataFrame(rows, "entity long, eom date, f double, v double")
    loads = panel.select("eom", "entity", (F.col("f") - 1).alias("x"))
    want = risk.factor_risk(panel, loads, panel.select("eom", "entity", F.col("v").alias("idio_var")), ["x"], group_rows=12)
    got = risk.own_factor_risk(panel, {"x": F.col("f") - 1}, F.col("v"), ["x"], group_rows=12)
    order = ["entity", "eom"]
    assert got.select(*want.columns).orderBy(*order).collect() == want.orderBy(*order).collect()
    plan = got._jdf.queryExecution().analyzed().toString()
    assert plan.count("Join") == 1  # the medians of the months
