"""Decayed moments, residuals and their variance against dense loops."""

from __future__ import annotations

import datetime as dt
import math

import numpy as np
import pytest

from crosspanel.operators import regress

DAY = dt.date(2015, 1, 1)


def dense(points, span):
    """Weighted covariance after the last of (position, x, y), ages counted in positions."""
    decay = 1.0 - 2.0 / (span + 1.0)
    kept = [(k, x, y) for k, x, y in points if x is not None and y is not None]
    if not kept:
        return 0.0
    last = points[-1][0]
    w = np.array([decay ** (last - k) if last > k else 1.0 for k, _, _ in kept])
    x, y = (np.array([p[i] for p in kept]) for i in (1, 2))
    mx, my = (w @ x) / w.sum(), (w @ y) / w.sum()
    return float(w @ ((x - mx) * (y - my)) / w.sum())


@pytest.mark.parametrize("span", [1, 3, 60])
@pytest.mark.parametrize("gaps", [False, True])
def test_decayed_covariance(spark, span, gaps):
    """Several blocks, whole blocks without a row, nulls at the start and inside, values far from zero."""
    rng = np.random.default_rng(span)
    rows = []
    for pair in ("a", "b"):
        at = -1
        for i in range(900):
            at += 1 if not gaps or i % 97 else int(rng.integers(1, 1300))
            x, y = 1e5 + rng.normal(), rng.normal()
            hole = i < 3 or rng.random() < 0.1
            rows.append((pair, DAY + dt.timedelta(days=at), at, None if hole else float(x), float(y)))
    df = spark.createDataFrame(rows, "pair string, day date, at long, x double, y double")
    out = regress.ewma_moments(df, ["pair"], "day", "x", "y", span, "at" if gaps else None)
    assert out.columns == [*df.columns, "covariance"]
    got = {(r.pair, r.day): r.covariance for r in out.collect()}
    assert len(got) == len(rows)
    for pair in ("a", "b"):
        own = [r for r in rows if r[0] == pair]
        for i in [0, 2, 3, 5, 40, 300, 551, 552, 553, 899]:
            want = dense([(r[2] if gaps else k, r[3], r[4]) for k, r in enumerate(own[: i + 1])], span)
            assert math.isclose(got[pair, own[i][1]], want, rel_tol=1e-7, abs_tol=1e-9), (pair, i)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "InPandas" not in plan and "Arrow" not in plan


def test_residuals_and_their_variance(spark):
    rng = np.random.default_rng(9)
    rows = []
    for d in range(70):
        for name in range(12):
            if (d + name) % 5 == 0 or (name == 11 and d > 12):
                continue
            x = None if (d, name) == (4, 2) else float(rng.normal())
            ret = None if (d, name) == (6, 3) else 0.01 * name + (x or 0.0) + float(rng.normal())
            rows.append((name, DAY + dt.timedelta(days=d), x, ret))
    df = spark.createDataFrame(rows, "name int, date date, x double, ret double")
    left = regress.factor_residuals(df, ["x"], "ret", 0.5)
    got = {(r["name"], r.date): r.residual for r in left.collect()}
    assert len(got) == len(rows)
    want = {}
    for date in {r[1] for r in rows}:
        own = [r for r in rows if r[1] == date and r[2] is not None and r[3] is not None]
        x, y = np.array([r[2] for r in own]), np.array([r[3] for r in own])
        beta = np.cov(x, y, bias=True)[0, 1] / (x.var() + 0.5)
        want |= {(r[0], date): r[3] - y.mean() - beta * (r[2] - x.mean()) for r in own}
    for key, value in got.items():
        assert (value is None) == (key not in want)
        assert value is None or math.isclose(value, want[key], abs_tol=1e-10)

    months = {(r["name"], r.eom): r for r in regress.idiosyncratic_variance(left, "name", "date", 8, 15).collect()}
    seen = set()
    for name in range(12):
        own = sorted((date, v) for (n, date), v in want.items() if n == name)
        for i, (date, _) in enumerate(own):
            eom = (date.replace(day=1) + dt.timedelta(days=32)).replace(day=1) - dt.timedelta(days=1)
            if i + 1 < len(own) and own[i + 1][0] <= eom:
                continue
            r = months[name, eom]
            seen.add((name, eom))
            assert r.observations == i + 1 and r.days == sum(d.month == date.month for d, _ in own)
            if i + 1 < 15:
                assert r.idio_var is None
            else:
                value = dense([((d - DAY).days, v, v) for d, v in own[: i + 1]], 8)
                assert math.isclose(r.idio_var, value, rel_tol=1e-8)
    assert seen == set(months)
