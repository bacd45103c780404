"""Competing return models against direct fits on the rows."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import month
from crosspanel.operators import joins, learned, returnmodels

MONTHS, PENALTIES = 40, (0.01, 1.0)
MAPS = learned.feature_maps(3, (4, 8), (0.5, 2.0), 7)
WINDOW = dict(wanted=12, least_train=5, least_validation=4)


@pytest.fixture(scope="module")
def made(spark):
    rng = np.random.default_rng(2)
    data = []
    for t in range(1, MONTHS + 1):
        for i in range(15):
            if (i + t) % 5 == 0:
                continue
            x = rng.uniform(size=3)
            y = None if (i * t) % 11 == 4 or t == 7 else float(np.sin(3 * x[0]) * 0.1 + 0.02 * x[1] + rng.normal() * 0.03)
            data.append((month(t), i, t, month(t).year, y, x.tolist()))
    table = spark.createDataFrame(
        data, "eom date, entity long, t int, test_year int, label double, features array<double>"
    ).withColumn("row", F.lit("clash")).repartition(5)
    months = [month(t) for t in range(1, MONTHS + 1)]
    moments = returnmodels.month_moments(table, MONTHS, 3, MAPS).persist()
    fits = returnmodels.compete(moments, months, [2020, 2021, 2022, 2023], 3, MAPS, PENALTIES, **WINDOW).collect()
    return data, table, months, fits


def features(kind, eta, p, x):
    if kind == "ridge":
        return x
    w = next(m for m in MAPS if m.eta == eta).weights[:, : p // 2]
    return np.concatenate([np.cos(x @ w), np.sin(x @ w)], axis=1) / np.sqrt(p)


def direct(kind, x, y, penalty):
    """Ridge on the rows themselves: intercept free, linear features standardised."""
    mean, scale = (x.mean(axis=0), x.std(axis=0)) if kind == "ridge" else (0.0, 1.0)
    d = np.column_stack([np.ones(len(x)), (x - mean) / scale])
    penal = penalty * np.eye(d.shape[1])
    penal[0, 0] = 0.0
    b = np.linalg.solve(d.T @ d / len(y) + penal, d.T @ y / len(y))
    return lambda z: b[0] + ((z - mean) / scale) @ b[1:]


def test_equal_direct_fits(made):
    data, _, months, fits = made
    assert len(fits) == 4 * 10 and len({(r.test_year, r.candidate) for r in fits}) == len(fits)
    for r in fits:
        known = sum(m <= month(0).replace(year=r.test_year - 1, month=11, day=30) for m in months)
        train, held = returnmodels.windows(months, r.test_year, **WINDOW)
        assert (r.train_months, r.validation_months) == (train, held)
        if r.test_year <= 2020:
            assert r.validation_mse is None and r.coef is None and not r.selected
            continue
        rows = [d for d in data if d[4] is not None]
        pick = lambda a, b: ([d for d in rows if a < d[2] <= b])
        arrays = lambda ds: (features(r.kind, r.eta, r.p, np.array([d[5] for d in ds])), np.array([d[4] for d in ds]))
        x, y = arrays(pick(0, train))
        z, want = arrays(pick(train, train + held))
        assert (r.train_rows, r.validation_rows) == (len(y), len(want)) and r.validation_start == months[train]
        assert np.isclose(r.validation_mse, np.mean((direct(r.kind, x, y, r.penalty)(z) - want) ** 2), rtol=1e-7)
        x, y = arrays(pick(0, known))
        bank = next(m for m in MAPS if returnmodels.KINDS[m.kind] == r.kind and m.eta == r.eta)
        probe = np.random.default_rng(0).uniform(size=(4, 3))
        got = r.coef[0] + features(r.kind, r.eta, r.p, probe) @ np.array(r.coef[1:])
        assert np.allclose(got, direct(r.kind, x, y, r.penalty)(features(r.kind, r.eta, r.p, probe)), rtol=1e-7) and bank
    for year in (2021, 2022, 2023):
        own = [r for r in fits if r.test_year == year]
        best = min(own, key=lambda r: (r.validation_mse, r.candidate))
        assert [r.candidate for r in own if r.selected] == [best.candidate]
    # Candidates in order: linear ones, then widths, scales, penalties.
    order = [(r.kind, r.p, r.eta, r.penalty) for r in sorted(fits, key=lambda r: r.candidate) if r.test_year == 2021]
    rf = [("rf_ridge", p, e, v) for p in (4, 8) for e in (0.5, 2.0) for v in PENALTIES]
    assert order == [("ridge", None, None, v) for v in PENALTIES] + rf


def test_predictions(made):
    data, table, months, fits = made
    chosen = [r for r in fits if r.selected]
    got = {(r.eom, r.entity): r.mu_hat for r in returnmodels.predict(table, chosen, 3, MAPS).collect()}
    assert got.keys() == {(d[0], d[1]) for d in data if d[3] >= 2021}
    by = {r.test_year: r for r in chosen}
    for d in data:
        if d[3] in by:
            r = by[d[3]]
            want = r.coef[0] + features(r.kind, r.eta, r.p, np.array([d[5]])) @ np.array(r.coef[1:])
            assert np.isclose(got[d[0], d[1]], want[0], rtol=1e-9)
    assert returnmodels.predict(table, [], 3, MAPS).count() == 0


def test_windows_and_table_agree(spark, made):
    _, _, months, _ = made
    table = spark.createDataFrame([(m,) for m in months], "eom date")
    years = spark.createDataFrame([(y,) for y in (2020, 2021, 2022, 2023)], "test_year int")
    parted = joins.adaptive_window(joins.training_rows(table, years), ["test_year"], *WINDOW.values()).collect()
    for year in (2021, 2022, 2023):
        train, held = returnmodels.windows(months, year, **WINDOW)
        own = sorted((r.eom, r.part) for r in parted if r.test_year == year)
        assert [p for _, p in own] == ["train"] * train + ["validation"] * held
    assert returnmodels.windows(months, 2021, 12, 5, 40) == (0, 0)


def test_no_labels(spark, made):
    _, table, months, _ = made
    none = table.withColumn("label", F.lit(None).cast("double"))
    moments = returnmodels.month_moments(none, MONTHS, 3, MAPS)
    assert moments.count() == 0
    assert returnmodels.compete(moments, months, [2022], 3, MAPS, PENALTIES, **WINDOW).count() == 0
