"""Influence of single rows and importance by year against plain loops."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from crosspanel import settings as S
from crosspanel.operators import evidence, ledger


def spearman(x, y):
    x, y = pd.Series(x).rank(), pd.Series(y).rank()
    if len(x) < 2 or x.nunique() < 2 or y.nunique() < 2:
        return None
    return float(np.corrcoef(x, y)[0, 1])


CASES = {
    "plain": [("a", 1.0, 2.0), ("b", 2.0, 1.0), ("c", 3.0, 5.0), ("d", 4.0, 4.0), ("e", 5.0, 9.0)],
    "ties": [("a", 1.0, 2.0), ("b", 1.0, 2.0), ("c", 1.0, 5.0), ("d", 4.0, 2.0), ("e", 4.0, 9.0), ("f", 4.0, 9.0)],
    "one_moves": [("a", 1.0, 3.0), ("b", 1.0, 4.0), ("c", 1.0, 5.0), ("d", 2.0, 6.0)],
    "flat": [("a", 1.0, 3.0), ("b", 1.0, 4.0), ("c", 1.0, 5.0)],
    "missing": [("a", 1.0, 3.0), ("b", None, 4.0), ("c", 5.0, float("nan")), ("d", 2.0, 7.0), ("e", 0.0, 6.0)],
    "single": [("a", 1.0, 3.0)],
}


def test_jackknife(spark):
    rows = [(g, *r) for g, items in CASES.items() for r in items]
    df = spark.createDataFrame(rows, "g string, key string, x double, y double")
    got = {(r.g, r.omitted): r for r in evidence.spearman_jackknife(df, ["g"], "key", "x", "y").collect()}
    want = {}
    for g, items in CASES.items():
        known = [i for i in items if all(v is not None and v == v for v in i[1:])]
        full = spearman([i[1] for i in known], [i[2] for i in known])
        for out in known:
            rest = [i for i in known if i is not out]
            want[g, out[0]] = (len(rest), full, spearman([i[1] for i in rest], [i[2] for i in rest]))
    assert set(got) == set(want)
    for k, (n, full, loo) in want.items():
        assert got[k].n == n
        assert got[k].full_sample == (None if full is None else pytest.approx(full, abs=1e-12))
        assert got[k].leave_one_out == (None if loo is None else pytest.approx(loo, abs=1e-12))


def test_jackknife_of_random_ties(spark):
    rng = np.random.default_rng(5)
    x, y = rng.integers(0, 9, 60).astype(float), rng.integers(0, 7, 60).astype(float)
    df = spark.createDataFrame([("g", f"k{i:02d}", float(a), float(b)) for i, (a, b) in enumerate(zip(x, y))], "g string, key string, x double, y double")
    got = sorted(evidence.spearman_jackknife(df, ["g"], "key", "x", "y").collect(), key=lambda r: r.omitted)
    for i, r in enumerate(got):
        assert r.leave_one_out == pytest.approx(spearman(np.delete(x, i), np.delete(y, i)), abs=1e-12)
    # Nothing at all.
    assert evidence.spearman_jackknife(df.limit(0), ["g"], "key", "x", "y").count() == 0


def test_summary_names_the_row_that_carries_the_result(spark):
    # Without the far row the correlation is -0.5; with it, 0.4.
    rows = [("g", "k0", 0.0, 1.0), ("g", "k1", 1.0, 2.0), ("g", "k2", 2.0, 0.0), ("g", "far", 90.0, 90.0)]
    df = spark.createDataFrame(rows, "g string, key string, x double, y double")
    details = evidence.spearman_jackknife(df, ["g"], "key", "x", "y")
    (r,) = evidence.influence_summary(details, ["g"], "k1").collect()
    assert r.most_influential == "far" and r.n == 4 and not r.sign_stable and r.sign_stability < 1
    assert r.minimum <= r.median <= r.maximum and r.named_omission is not None


def gates(spark, primary=0.9, second=0.8, change=0.1, prior=0.5, stable=True, share=10, target=0.1, recovers=False, turned=2):
    metrics = [("sfm", primary, second)] + [(f"m{i}", 0.3 if i < share - 1 else -0.3, 0.3) for i in range(9)]
    rows = [(m, k, v, stable, change) for k, a, b in metrics for m, v in (("one", a), ("two", b))]
    summary = spark.createDataFrame(rows, "method string, metric string, full_sample double, sign_stable boolean, largest_change double")
    features = spark.createDataFrame(
        [("up", 0.2, 13, 13, False, 0.9, True, target), ("down", -0.2, 2, turned, recovers, 0.1, True, -0.1)],
        "feature string, sfm double, first_reversal int, first_decay int, recovers boolean, apr_12 double, h1_agree boolean, target double",
    )
    before = spark.createDataFrame([(prior,)], "prior double")
    (r,) = evidence.classify_evidence(summary, features, before, ("one", "two"), "sfm", "up", "down").collect()
    return r


@pytest.mark.parametrize("change, want", [
    ({}, ("Case A", "strongly consistent")),
    ({"primary": 0.72, "second": 0.4}, ("Case A", "moderately consistent")),
    ({"share": 7}, ("Case A", "moderately consistent")),
    ({"prior": 0.8}, ("Case B", "weakly consistent")),
    ({"change": 0.36}, ("Case B", "weakly consistent")),
    ({"stable": False}, ("Case B", "weakly consistent")),
    ({"second": -0.1}, ("Case B", "mixed")),
    ({"share": 4}, ("Case B", "mixed")),
    ({"target": -0.1}, ("Case B", "inconsistent")),
    ({"recovers": True}, ("Case B", "inconsistent")),
    ({"turned": 3}, ("Case B", "inconsistent")),
    ({"prior": None}, ("Case B", "weakly consistent")),
    ({"primary": None}, ("Case B", "mixed")),
])
def test_gates(spark, change, want):
    r = gates(spark, **change)
    assert (r.decision, r.classification) == want


def test_superposition_equals_a_loop_over_months(spark):
    """Every (penalty, neutral set) as a recursion of its own, names that come and go included."""
    rng = np.random.default_rng(3)
    months = [dt.date(2019, 10, 31), dt.date(2019, 11, 30), dt.date(2019, 12, 31), dt.date(2020, 1, 31), dt.date(2020, 2, 29)]
    x, sets, penalties = ["p", "q"], {"none": [], "p": ["p"], "both": ["p", "q"]}, (0.1, 1.0)
    growth = [1.01, 0.99, 1.02, 1.0, 1.03]
    rows = []
    for e in range(7):
        for t, day in enumerate(months):
            if (e, t) in {(1, 2), (2, 4), (3, 0), (4, 1)}:
                continue
            d = rng.normal(size=2)
            rows.append((day, e, day.year, [float(v) for v in d], float(rng.uniform(0, 0.9)), float(rng.normal(0, 0.05)), float(rng.uniform(0.01, 0.1)), 0.01))
    designed = spark.createDataFrame(rows, "eom date, entity int, test_year int, design array<double>, speed double, ret_exc_lead1m double, lambda_adv double, variance double")
    coefficients = {(2019, 0.1): [1.0, -0.5], (2019, 1.0): [0.3, 0.2], (2020, 0.1): [0.7, 0.4], (2020, 1.0): [-0.2, 0.1]}
    beta = spark.createDataFrame([(y, p, b) for (y, p), b in coefficients.items()], "test_year int, penalty double, beta array<double>")
    stats = spark.createDataFrame(
        [(d, t + 1, g, months[t + 1] if t < 4 else None, 0.05, 1.0) for t, (d, g) in enumerate(zip(months, growth))],
        "eom date, t int, growth double, next_eom date, next_median_lambda double, wealth_growth double",
    )
    carried = evidence.superposed_positions(designed, beta, stats, x, sets, penalties)
    got = {(r.penalty, r.neutralized, r.eom): r for r in ledger.evaluate(carried, evidence.SCENARIO, 10.0).collect()}
    by = {(r[1], r[0]): r for r in rows}
    for p in penalties:
        for name, gone in sets.items():
            held: dict[int, tuple[float, float]] = {}
            for t, day in enumerate(months):
                new, cost, gross, turnover = {}, 0.0, 0.0, 0.0
                for e in range(7):
                    prior = held.pop(e, None)
                    r = by.get((e, day))
                    if r is None:
                        if prior is not None:
                            cost += 5.0 * prior[1] * prior[0] ** 2
                            turnover += abs(prior[0])
                        continue
                    aim = sum(v * b for v, b, n in zip(r[3], coefficients[day.year, p], x) if n not in gone)
                    inherited = prior[0] if prior else 0.0
                    w = r[4] * inherited + (1 - r[4]) * aim
                    cost += 5.0 * r[6] * (w - inherited) ** 2
                    gross += w * r[5]
                    turnover += abs(w - inherited)
                    new[e] = (w * (1 + r[5]) / growth[t], r[6])
                held = new
                out = got[p, name, day]
                assert out.gross_return == pytest.approx(gross, abs=1e-12)
                assert out.trading_cost == pytest.approx(cost, abs=1e-12)
                assert out.turnover == pytest.approx(turnover, abs=1e-12)


def test_superposition_shuffles_names_before_scenarios(spark):
    rows = spark.createDataFrame([], "eom date, entity int, test_year int, design array<double>, speed double, ret_exc_lead1m double, lambda_adv double, variance double")
    beta = spark.createDataFrame([], "test_year int, penalty double, beta array<double>")
    stats = spark.createDataFrame([], "eom date, t int, growth double, next_eom date, next_median_lambda double, wealth_growth double")
    carried = evidence.superposed_positions(rows, beta, stats, ["p"], {"none": []}, (0.1,))
    plan = carried._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(entity") == 1
    assert "Exchange hashpartitioning(penalty" not in plan and carried.count() == 0


def test_importance_of_years(spark):
    data = []
    for name, extra in (("none", 0.0), ("f", -0.01), ("g", 0.002)):
        for year in (2001, 2002):
            for m in range(1, 4):
                flow = 0.01 * m + (extra if year == 2002 or name == "g" else 0.0)
                data.append((0.1, name, year, dt.date(year, m, 28), flow, 0.0, flow, flow, 1.0, 2.0))
    returns = spark.createDataFrame(data, "penalty double, neutralized string, test_year int, eom date, gross_return double, trading_cost double, net_return double, utility_flow double, turnover double, leverage double")
    table = evidence.importance_by_year(returns, ["penalty"]).cache()
    got = {(r.neutralized, r.scope, r.test_year): r for r in table.collect()}
    assert len(got) == 6 and set(S.IMPORTANCE_OUTCOMES) <= set(table.columns)
    assert got["f", "year", 2001].delta_utility == pytest.approx(0.0)
    assert got["f", "year", 2002].delta_utility == pytest.approx(0.12)
    assert got["f", "full", None].delta_utility == pytest.approx(0.06)
    assert got["f", "full", None].place == 1 and got["g", "full", None].place == 2 and got["g", "year", 2001].place is None
    assert got["f", "full", None].delta_turnover == 0.0
    shares = {r.neutralized: r for r in evidence.importance_concentration(table, ["penalty", "neutralized"], [2002]).collect()}
    f, g = shares["f"], shares["g"]
    assert f.top_1_share == pytest.approx(1.0) and f.crisis_share == pytest.approx(1.0) and f.largest_year == 2002
    assert g.top_1_share is None and g.crisis_share is None and g.years_positive == 0 and g.largest_value < 0
    assert table.where(F.col("scope") == "nothing").count() == 0


def test_scenario_tables_do_not_share_a_name(spark, sf_dir):
    """Both scenario tables in one session: each query reads the table of its own."""
    from crosspanel.plans import evidence as plans, policies

    points = policies.scenario_returns(spark, sf_dir)
    ledgers = plans.scenario_returns(spark, sf_dir)
    assert {"axis", "point"} <= set(points.columns) and "penalty" not in points.columns
    assert {"penalty", "neutralized"} <= set(ledgers.columns)
    assert plans.yearly(spark, sf_dir).where("scope = 'full'").count() == 4
