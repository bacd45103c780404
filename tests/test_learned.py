"""Learned policies on feature maps against a dense loop over months."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import month
from crosspanel.operators import learned, paths, selection

GAMMA, AUM = 10.0, 1e5
PENALTIES = (0.001, 0.1)
MAPS = learned.feature_maps(3, (4, 8), (0.5, 2.0), 7)
MONTHS = 30


def universe(seed=3):
    """{t: rows} of (entity, x, lambda, variance, volatility, speed, label); names come and go."""
    rng = np.random.default_rng(seed)
    out = {}
    for t in range(1, MONTHS + 1):
        out[t] = []
        for i in range(17):
            if (i + t) % 6 == 0 or (i == 3 and t > 20):
                continue
            x = rng.uniform(size=3)
            x[2] = 0.5 if t == 4 else x[2]
            label = None if (i * t) % 13 == 5 else float(rng.normal() * 0.05)
            out[t].append((i, x.tolist(), float(rng.uniform(1e-7, 1e-6)), float(rng.uniform(0.001, 0.01)),
                           float(rng.uniform(0.02, 0.2)), float(rng.uniform(0.2, 0.9)), label))
    out[12] = [(*r[:6], None) for r in out[12]]
    return out, {t: 1 + 0.01 * (t % 3) for t in out}


def frame(spark, rows, growth, extra=()):
    flat = [(month(t), *r) for t, rs in rows.items() for r in rs] + list(extra)
    schema = (
        "eom date, entity long, features array<double>, lambda_adv double, variance double, volatility double, speed double,"
        " label double"
    )
    table = spark.createDataFrame(flat, schema).withColumn("ret_exc_lead1m", F.col("label")).repartition(4)
    stats = spark.createDataFrame([(month(t), t, g) for t, g in growth.items()], "eom date, t int, growth double")
    return paths.entity_paths(table, stats, learned.NUMBERS, "features", learned.OPTIONAL), stats


def small_map(m, p):
    """The map of p features drawn on its own from the bank's frequencies."""
    if p is None:
        return lambda x: x
    w = m.weights[:, : p // 2]
    return lambda x: np.concatenate([np.cos(x @ w), np.sin(x @ w)], axis=1) / np.sqrt(p)


def dense_design(of, rows):
    f = of(np.array([r[1] for r in rows]))
    f = f - f.mean(axis=0)
    norms = np.sqrt((f**2).sum(axis=0))
    f = np.divide(f, norms, out=np.zeros_like(f), where=norms > 1e-12)
    return np.concatenate([np.full((len(rows), 1), len(rows) ** -0.5), f], axis=1) / np.array([[r[4]] for r in rows])


def dense_fit(of, rows, growth, upto, penalty):
    h = r = None
    n, before = 0, {}
    for t in range(1, upto + 1):
        now = rows[t]
        x = dense_design(of, now)
        inherited = np.array([before.get(v[0], (np.zeros(x.shape[1]),))[0] for v in now])
        m = np.array([[v[5]] for v in now])
        b = m * inherited + (1 - m) * x
        lam, var = np.array([v[2] for v in now]), np.array([v[3] for v in now])
        cost = GAMMA * b.T @ (var[:, None] * b) + AUM * (b - inherited).T @ (lam[:, None] * (b - inherited))
        for i, (g, left) in before.items():
            if i not in {v[0] for v in now}:
                cost = cost + AUM * left * np.outer(g, g)
        known = [k for k, v in enumerate(now) if v[6] is not None]
        if known:
            gain = b[known].T @ np.array([now[k][6] for k in known])
            h, r, n = (cost, gain, 1) if n == 0 else (h + cost, r + gain, n + 1)
        before = {v[0]: (k * (1 + (v[6] or 0.0)) / growth[t], v[2]) for v, k in zip(now, b)}
    return None if not n else (np.linalg.solve(h / n + penalty * np.eye(len(r)), r / n), n, h, r)


def years_of():
    return {t: month(t).year for t in range(1, MONTHS + 1)}


@pytest.fixture(scope="module")
def made(spark):
    rows, growth = universe()
    names, stats = frame(spark, rows, growth)
    names = names.persist()
    moment = learned.moments(names, MONTHS, 3, MAPS)
    statistic = learned.statistics(names, stats, MONTHS, 3, MAPS, moment, GAMMA, AUM)
    years = sorted(set(years_of().values()))
    fitted = learned.fits(statistic, years, 3, MAPS, PENALTIES).collect()
    return rows, growth, names, moment, fitted


def test_coefficients_equal_the_dense_loop(made):
    rows, growth, _, _, fitted = made
    assert len(fitted) == (1 + 2 * 2) * len(PENALTIES) * len(set(years_of().values()))
    for r in fitted:
        m = next(m for m in MAPS if (m.kind, m.eta) == (r.kind, r.eta))
        upto = max((t for t in rows if month(t) <= month(0).replace(year=r.test_year - 1, month=11, day=30)), default=0)
        want = dense_fit(small_map(m, r.p), rows, growth, upto, r.penalty)
        if want is None:
            # A year without history is a row with a null fit, not a missing row.
            assert r.beta is None and r.n == 0 and r.trained_to is None
            continue
        beta, n, h, g = want
        full = h / n + r.penalty * np.eye(len(beta))
        assert r.n == n and np.allclose(r.beta, beta, rtol=1e-6, atol=1e-9 * np.abs(beta).max())
        assert np.isclose(r.objective, g / n @ beta - 0.5 * beta @ full @ beta, rtol=1e-8)
        assert np.isclose(r.condition, np.linalg.cond(full), rtol=1e-6) and r.gradient_norm < 1e-9
    assert any(r.beta is None for r in fitted) and {r.n for r in fitted if r.test_year == 2021} == {10}


def test_positions_equal_the_dense_loop(made):
    rows, growth, names, moment, fitted = made
    got = learned.positions(names, MONTHS, years_of(), 3, MAPS, moment, fitted).collect()
    by = {(r.candidate, r.t, r.entity): r for r in got}
    assert len(by) == len(got)
    seen = 0
    for r in (r for r in fitted if r.test_year == 2021):
        m = next(m for m in MAPS if (m.kind, m.eta) == (r.kind, r.eta))
        betas = {f.test_year: f.beta for f in fitted if (f.kind, f.eta, f.p, f.penalty) == (r.kind, r.eta, r.p, r.penalty)}
        before = {}
        for t, now in rows.items():
            beta = betas[month(t).year]
            if beta is None:
                before = {}
                continue
            aim = dense_design(small_map(m, r.p), now) @ np.array(beta)
            after = {}
            for v, a in zip(now, aim):
                prior = before.get(v[0], 0.0)
                w = v[5] * prior + (1 - v[5]) * a
                mine = by[learned.candidate_name(r.kind, r.eta, r.p, r.penalty), t, v[0]]
                assert np.allclose([mine.aim_weight, mine.weight, mine.inherited], [a, w, prior], rtol=1e-7, atol=1e-10)
                after[v[0]] = w * (1 + (v[6] or 0.0)) / growth[t]
                seen += 1
            before = after
    assert seen == len(got)


def test_odd_rows(spark):
    rows, growth = universe()
    some = {t: rows[t] for t in (1, 2)}
    bad = [(month(1), 90, [None, 0.1, 0.2], 1e-7, 0.01, 0.1, 0.5, 0.1), (month(1), 91, [0.1] * 3, 0.0, 0.01, 0.1, 0.5, 0.1),
           (month(2), 92, [0.1] * 3, 1e-7, None, 0.1, 0.5, 0.1), (month(2), 93, [0.1] * 3, 1e-7, 0.1, float("nan"), 0.5, 0.1)]
    names, _ = frame(spark, some, {1: 1.0, 2: 1.0}, bad)
    assert {r.entity for r in names.collect()} == {r[0] for t in some for r in some[t]}
    counts = learned.moments(names, 2, 3, MAPS)[0][0]
    assert counts.tolist() == [len(some[1]), len(some[2])]
    empty, stats = frame(spark, {1: []}, {1: 1.0})
    moment = learned.moments(empty, 1, 3, MAPS)
    statistic = learned.statistics(empty, stats, 1, 3, MAPS, moment)
    assert statistic.count() == 0 and learned.fits(statistic, [2020], 3, MAPS, PENALTIES).count() == 0
    assert learned.positions(empty, 1, {1: 2020}, 3, MAPS, moment, []).count() == 0


def test_learned_methods_are_chosen_by_utility_flow(spark):
    data = [("portfolio_ml_rf", c, month(12 * y + k), 2020 + y, g, 0.0, u) for c, g, u in (("a", 0.05, 0.01), ("b", 0.01, 0.03))
            for y in range(3) for k in range(12)]
    table = spark.createDataFrame(
        data, "method string, candidate string, eom date, test_year int, gross_return double, trading_cost double, utility_flow double"
    )
    chosen = selection.select_cumulative(table, ["static_ml"]).where("selected").collect()
    assert {(r.candidate, r.test_year) for r in chosen} == {("b", 2021), ("b", 2022)}
    assert all(np.isclose(r.score, 0.03) and not r.future_information_used for r in chosen)
    static = selection.select_cumulative(table, ["portfolio_ml_rf"]).where("selected").collect()
    assert {r.candidate for r in static} == {"a"}


def test_ledger_of_priced_positions_needs_no_shuffle_by_name(spark, made):
    """Month sums of the rows as they come equal the ledger that joins and carries the positions."""
    from crosspanel.operators import ledger

    rows, growth, names, moment, fitted = made
    stats = spark.createDataFrame(
        [(month(t), t, growth[t], growth[t - 1] if t > 1 else 1.0, month(t + 1) if t < MONTHS else None, 1e-7, 1e-7) for t in range(1, MONTHS + 1)],
        "eom date, t int, growth double, wealth_growth double, next_eom date, median_lambda double, next_median_lambda double",
    )
    args, keys = (names, MONTHS, years_of(), 3, MAPS, moment, fitted), ["method", "candidate"]
    out = ledger.evaluate(learned.carried(learned.priced_positions(*args), stats), keys, AUM)
    prices = spark.createDataFrame(
        [(month(t), r[0], r[6], r[2], r[3]) for t, rs in rows.items() for r in rs],
        "eom date, entity long, ret_exc_lead1m double, lambda_adv double, variance double",
    )
    held = learned.positions(*args).join(stats.select("eom", "t"), "t").select(*keys, "eom", "entity", "weight")
    want = {(r.candidate, r.eom): r for r in ledger.ledger(held.join(prices, ["eom", "entity"]), stats, keys, aum=AUM).collect()}
    got = {(r.candidate, r.eom): r for r in out.collect()}
    assert set(got) == set(want) and sum(r.dropped_names for r in want.values()) > 0
    for k, r in want.items():
        for name in ("gross_return", "trading_cost", "exit_cost", "turnover", "leverage", "ex_ante_monthly_variance", "utility_flow", "n_names", "dropped_names", "wealth_growth"):
            assert np.isclose(got[k][name], r[name], rtol=1e-10, atol=1e-14), (k, name)
    above = out.select("*")._jdf.queryExecution().executedPlan().toString().split("MapInArrow")[0]
    shuffles = [line for line in above.splitlines() if "Exchange hashpartitioning" in line]
    assert "Window" not in above and shuffles and not [line for line in shuffles if "entity" in line], shuffles
