"""Carried positions under factored risk against a dense loop over months."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import month
from crosspanel.operators import factored, ledger
from crosspanel.operators.factored import Candidate

CANDIDATES = [
    Candidate("static_ml", "a", 0.5, 1.0), Candidate("static_ml", "b", 0.1, 1 / 6),
    Candidate("static_ml_star", "c", 0.25, 2.0, 0.5), Candidate("static_ml_star", "slow", 0.5, 400.0, 0.25),
]
GAMMA, AUM, RIDGE = 10.0, 1e6, 1e-8


def universe(months=14, names=23, k=3, seed=6):
    """Rows of a moving universe, its growth by month, and factor covariances (one month has none)."""
    rng = np.random.default_rng(seed)
    rows, covs = [], {}
    for t in range(1, months + 1):
        root = rng.normal(size=(k, k)) * 0.05
        if t != 5:
            covs[t] = root @ root.T
        f = covs.get(t, np.zeros((k, k)))
        for i in range(names):
            if (i + t) % 7 == 0 or (i % 5 == 0 and t == 9):
                continue
            b, idio = rng.normal(size=k), rng.uniform(0.001, 0.01)
            ret = None if (i * t) % 11 == 3 else float(rng.normal() * 0.05)
            rows.append((month(t), i, float(rng.normal() * 0.01), float(rng.uniform(1e-9, 1e-7)), b.tolist(), idio,
                         float(b @ f @ b) + idio, ret))
    return rows, {t: 1 + 0.01 * (t % 4) for t in range(1, months + 1)}, covs


def dense(rows, growth, covs, c: Candidate):
    """{(t, entity): (weight, inherited)} by solving the full system of each month in turn."""
    months = sorted({r[0] for r in rows})
    before, out = {}, {}
    for t, eom in enumerate(months, 1):
        now = [r for r in rows if r[0] == eom]
        b = np.array([r[4] for r in now])
        f = covs.get(t, np.zeros((b.shape[1],) * 2))
        sigma = b @ f @ b.T + np.diag([r[5] for r in now])
        sigma = sigma + c.shrinkage * np.diag([r[6] for r in now]) + RIDGE * np.eye(len(now))
        pull = AUM * c.cost * np.diag([r[3] for r in now])
        inherited = np.array([before.get(r[1], 0.0) for r in now])
        w = np.linalg.solve(GAMMA * sigma + pull, c.scale * np.array([r[2] for r in now]) + pull @ inherited)
        before = {r[1]: x * (1 + (r[7] or 0.0)) / growth[t] for r, x in zip(now, w)}
        out |= {(t, r[1]): (x, i) for r, x, i in zip(now, w, inherited)}
    return out


def tables(spark, rows, growth):
    schema = (
        "eom date, entity long, mu double, lambda_adv double, loadings array<double>, idio_variance double, "
        "factor_total_variance double, ret_exc_lead1m double"
    )
    stats = spark.createDataFrame([(month(t), t, g) for t, g in growth.items()], "eom date, t int, growth double")
    return spark.createDataFrame(rows, schema).repartition(5), stats


@pytest.mark.parametrize("lags", [1, 3, 6, 50])
def test_equals_the_dense_loop(spark, lags):
    rows, growth, covs = universe()
    panel, stats = tables(spark, rows, growth)
    paths = factored.entity_paths(panel.withColumn("path", F.lit("clash")), stats).persist()
    path = factored.solve_path(paths, covs, len(growth), CANDIDATES, GAMMA, AUM, RIDGE, lags)
    # Each round settles ``lags`` months more whatever the data; contraction makes it far fewer.
    assert path.rounds <= -(-len(growth) // min(lags, len(growth))) + 2 and path.change <= 1e-12
    if lags == 50:
        assert path.rounds == 1
    got = factored.positions(paths, path, CANDIDATES, GAMMA, AUM, RIDGE).collect()
    for c in CANDIDATES:
        want = dense(rows, growth, covs, c)
        mine = {(r.t, r.entity): (r.weight, r.inherited) for r in got if (r.method, r.candidate) == (c.method, c.name)}
        assert mine.keys() == want.keys()
        scale = max(abs(w) for w, _ in want.values())
        assert all(np.allclose(mine[k], want[k], rtol=1e-9, atol=1e-11 * scale) for k in want)
    paths.unpersist()


def test_rows_without_numbers_hold_nothing(spark):
    rows, growth, covs = universe(4, 6)
    bad = [list(r) for r in rows]
    for i, (at, value) in enumerate([(2, None), (3, None), (3, 0.0), (4, [None, 1.0, 1.0]), (5, float("nan")), (6, None)]):
        bad[i * 3][at] = value
    kept = [r for i, r in enumerate(rows) if i % 3 or i >= 18]
    panel, stats = tables(spark, [tuple(r) for r in bad], growth)
    paths = factored.entity_paths(panel, stats)
    path = factored.solve_path(paths, covs, 4, CANDIDATES[:1], GAMMA, AUM, RIDGE)
    got = {(r.t, r.entity): r.weight for r in factored.positions(paths, path, CANDIDATES[:1], GAMMA, AUM, RIDGE).collect()}
    want = dense(kept, growth, covs, CANDIDATES[0])
    assert got.keys() == want.keys() and all(np.isclose(got[k], want[k][0], rtol=1e-9, atol=1e-14) for k in want)
    # No rows, no covariances: no factor part.
    empty = factored.entity_paths(panel.limit(0), stats)
    assert factored.positions(empty, factored.solve_path(empty, covs, 4, CANDIDATES), CANDIDATES).count() == 0
    none = factored.solve_path(paths, {}, 4, CANDIDATES[:1], GAMMA, AUM, RIDGE)
    flat = {r: w for r, (w, _) in dense(kept, growth, {}, CANDIDATES[0]).items()}
    got = factored.positions(paths, none, CANDIDATES[:1], GAMMA, AUM, RIDGE).collect()
    assert none.rounds == 0 and all(np.isclose(r.weight, flat[r.t, r.entity], rtol=1e-9, atol=1e-14) for r in got)


def test_a_repeated_month_is_an_error(spark):
    rows, growth, covs = universe(3, 4)
    panel, stats = tables(spark, [*rows, rows[0]], growth)
    with pytest.raises(Exception, match="two rows of one month"):
        factored.solve_path(factored.entity_paths(panel, stats), covs, 3, CANDIDATES)


def test_ledger_prices_the_carried_positions(spark):
    """What the ledger calls inherited is what the policy started from."""
    rows, growth, covs = universe()
    panel, stats = tables(spark, rows, growth)
    paths = factored.entity_paths(panel, stats)
    path = factored.solve_path(paths, covs, len(growth), CANDIDATES, GAMMA, AUM, RIDGE)
    held = factored.positions(paths, path, CANDIDATES, GAMMA, AUM, RIDGE).join(stats.select("eom", "t"), "t").drop("t")
    calendar = stats.selectExpr(
        "eom", "t", "growth", "1e-8D AS median_lambda", "lag(growth, 1, 1D) OVER (ORDER BY t) AS wealth_growth",
        "lead(eom) OVER (ORDER BY t) AS next_eom", "1e-8D AS next_median_lambda",
    )
    priced = held.withColumnRenamed("inherited", "start").join(panel.select("eom", "entity", "ret_exc_lead1m", "lambda_adv"), ["eom", "entity"])
    carried = ledger.carry_positions(priced, calendar, ["method", "candidate"], ["start"]).where("not dropped")
    gap = carried.agg(F.max(F.abs(F.col("start") - F.col("inherited"))), F.count("*"), F.max(F.abs("start"))).first()
    assert gap[0] <= 1e-12 and gap[1] == held.count() and gap[2] > 0
