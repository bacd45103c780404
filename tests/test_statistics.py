"""Regression, inference, signals and selection against numpy and hand values."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from conftest import month
from pyspark.sql import functions as F

from crosspanel.operators import inference, joins, performance, regress, selection, signals


@pytest.fixture(scope="module")
def sample(spark):
    rng = np.random.default_rng(4)
    n = 600
    x = rng.random((n, 3))
    x[:, 2] = 0.5  # a flat feature
    y = 0.3 * x[:, 0] - 0.2 * x[:, 1] + rng.normal(0, 0.1, n)
    pdf = pd.DataFrame(x, columns=["a", "b", "c"]).assign(y=y, eom=[month(i % 30) for i in range(n)])
    rows = [(*map(float, r[:4]), r[4]) for r in pdf.itertuples(index=False)]
    return spark.createDataFrame(rows, "a double, b double, c double, y double, eom date"), pdf


@pytest.mark.parametrize("standard", [True, False])
def test_ridge_against_normal_equations(sample, standard):
    df, pdf = sample
    names, lam = ["a", "b", "c"], 0.7
    fit = regress.ridge_fit(
        regress.gram(df.withColumn("g", F.lit(1)), names, "y", ["g"]).withColumn("lam", F.lit(lam)), "lam", standard
    ).first()["coef"]
    z = pdf[names].to_numpy()
    mean, scale = (z.mean(0), z.std(0)) if standard else (np.zeros(3), np.ones(3))
    scale = np.where(scale < 1e-12, 1.0, scale)
    design = np.column_stack([np.ones(len(z)), (z - mean) / scale])
    penalty = np.diag([0.0, 1, 1, 1])
    coef = np.linalg.pinv(design.T @ design / len(z) + lam * penalty) @ (design.T @ pdf["y"].to_numpy() / len(z))
    want = design @ coef
    got = fit[0] + z @ np.array(fit[1:])
    np.testing.assert_allclose(got, want, atol=1e-10)


def test_wide_gram_equals_narrow(sample, monkeypatch):
    df, _ = sample
    narrow = regress.gram(df, ["a", "b", "c"], "y", ["eom"]).toPandas().set_index("eom").sort_index()
    monkeypatch.setattr(regress, "EXPRESSION_WIDTH", 1)
    wide = regress.gram(df, ["a", "b", "c"], "y", ["eom"]).toPandas().set_index("eom").sort_index()
    for c in ("xx", "xy"):
        np.testing.assert_allclose(np.array(narrow[c].tolist()), np.array(wide[c].tolist()), rtol=1e-12)
    assert (narrow["n"] == wide["n"]).all()


def test_return_model_uses_no_later_month(sample):
    """Changing the labels from December on leaves the next year's choice as it was."""
    df, _ = sample
    args = (["a", "b"], "y", (0.01, 1.0), 6)
    before = regress.return_model_by_year(df, *args).where("test_year = 2022").orderBy("penalty").collect()
    moved = df.withColumn("y", F.when(F.col("eom") >= "2021-12-31", F.col("y") * 100).otherwise(F.col("y")))
    after = regress.return_model_by_year(moved, *args).where("test_year = 2022").orderBy("penalty").collect()
    assert [(r["selected"], tuple(r["coef"])) for r in before] == [(r["selected"], tuple(r["coef"])) for r in after]


def test_random_features_nest():
    small = regress.random_weights(3, 16, 0.5, 11, bank=64)
    large = regress.random_weights(3, 64, 0.5, 11, bank=64)
    np.testing.assert_array_equal(small, large[:, :8])


def test_newey_west(spark):
    rng = np.random.default_rng(8)
    values = rng.normal(0.1, 1.0, 40)
    df = spark.createDataFrame([("s", month(i), float(v)) for i, v in enumerate(values)], "k string, eom date, v double")
    row = inference.newey_west(df, "v", 6, ["k"], "eom").first()
    c, n = values - values.mean(), len(values)
    total = c @ c / n + sum(2 * (1 - k / 7) * (c[k:] @ c[:-k]) / n for k in range(1, 7))
    assert row["nw_se"] == pytest.approx(np.sqrt(total / n))
    short = inference.newey_west(df.where(F.col("eom") < month(3)), "v", 6, ["k"], "eom").first()
    assert short["lags"] == 2


def test_bootstrap_agrees_with_theory(spark):
    rng = np.random.default_rng(2)
    values = rng.normal(0.2, 1.0, 120)
    df = spark.createDataFrame([("s", month(i), float(v)) for i, v in enumerate(values)], "k string, eom date, v double")
    once = inference.block_bootstrap(df, "v", ["k"], "eom", block=1, replications=2000, seed=3).first()
    half = 1.96 * values.std() / np.sqrt(120)
    assert once["ci_lower"] == pytest.approx(values.mean() - half, abs=0.04)
    assert once["ci_upper"] == pytest.approx(values.mean() + half, abs=0.04)
    again = inference.block_bootstrap(df.repartition(3), "v", ["k"], "eom", block=1, replications=2000, seed=3).first()
    assert once == again
    whole = inference.block_bootstrap(df, "v", ["k"], "eom", block=500, replications=50, seed=3).first()
    assert whole["ci_lower"] == pytest.approx(values.mean()) == whole["ci_upper"]


def test_rounding_of_a_sum_is_no_difference(spark):
    rows = [("a", month(i), 2020, 1.0 + (i + 1) * 2.0**-50, 0.5 + i) for i in range(24)] + [("b", month(i), 2020, 1.0, 0.25) for i in range(24)]
    df = spark.createDataFrame(rows, "method string, eom date, test_year int, leverage double, turnover double")
    gaps = joins.method_pairs(df, [("a", "b")], ["leverage", "turnover"])
    assert {r["delta_leverage"] for r in gaps.collect()} == {0.0}
    assert sorted(r["delta_turnover"] for r in gaps.collect()) == [0.25 + i for i in range(24)]
    drawn = inference.block_bootstrap(gaps, "delta_leverage", list(inference.PAIR), "eom", replications=20).first()
    assert drawn["probability_positive"] == 0.0


def test_outcome_differences_are_taken_as_they_are(spark):
    """The queries' SQL subtracts and compares with zero: a difference of few units in the last place counts there."""
    flows = ["gross_return", "trading_cost", "net_return", "utility_flow", "turnover", "ex_ante_monthly_variance"]
    rows = [(m, month(i), 2020, lev, *[0.1] * 6) for i in range(24) for m, lev in (("a", 1.0 + (i % 3 - 1) * 2.0**-50), ("b", 1.0))]
    df = spark.createDataFrame(rows, "method string, eom date, test_year int, leverage double, " + ", ".join(f"{f} double" for f in flows))
    diffs = inference.method_differences(df, [("a", "b")])
    assert sorted({r["delta_leverage"] for r in diffs.collect()}) == [-(2.0**-50), 0.0, 2.0**-50]
    shares = inference.period_attribution(diffs, F.lit("all"))
    assert shares.where("outcome = 'leverage'").first()["positive_month_share"] == pytest.approx(1 / 3)
    assert inference.block_bootstrap(
        diffs.where("delta_leverage <> 0"), "delta_leverage", list(inference.PAIR), "eom", block=1, replications=200
    ).first()["probability_positive"] > 0.2


def test_drawdown_starts_at_the_first_wealth(spark):
    df = spark.createDataFrame([("p", month(i), r) for i, r in enumerate([-0.5, 0.2, -0.1])], "method string, eom date, net_return double")
    assert performance.max_drawdown(df, ["method"]).first()["max_drawdown"] == pytest.approx(-0.1)


def test_sharpe_is_null_without_volatility(spark):
    df = spark.createDataFrame(
        [("p", month(i), 0.01, 0.0, 0.01, 0.0, 1.0, 1.0) for i in range(3)],
        "method string, eom date, gross_return double, trading_cost double, net_return double, utility_flow double, turnover double, leverage double",
    )
    assert performance.performance(df).first()["net_sharpe"] is None
    assert performance.validation_utility(df.limit(1), ["method"]).first()["validation_utility"] == float("-inf")


def test_method_comparison_shape(spark):
    """24 months x 4 methods: 24 rows per pair, seven outcomes, the utility identity holds."""
    rows = []
    for t in range(24):
        for k, m in enumerate(("a", "b", "c", "d")):
            gross, cost, var = 0.01 * k + 0.001 * np.sin(t + k), 0.001 * k, 1e-4 * (k + 1)
            rows.append((month(t), 2020 + t // 12, m, gross, cost, gross - cost, var, gross - cost - 5 * var, 0.1 * k, 1.0))
    df = spark.createDataFrame(
        [tuple(float(v) if isinstance(v, np.floating) else v for v in r) for r in rows],
        "eom date, test_year int, method string, gross_return double, trading_cost double, net_return double,"
        " ex_ante_monthly_variance double, utility_flow double, turnover double, leverage double",
    )
    pairs = (("b", "a"), ("c", "a"), ("d", "a"), ("c", "b"), ("d", "b"))
    diffs = inference.method_differences(df, pairs)
    assert diffs.count() == 24 * 5
    assert inference.identity_error(diffs).where("not passed").isEmpty()
    table = inference.inference(diffs, replications=50)
    assert table.count() == 5 * 7
    assert table.where("years_total <> 2").isEmpty()


def test_horizon_join_follows_dates_not_rows(spark):
    """A gap in the months must not move a label."""
    months = [0, 1, 3, 4]
    df = spark.createDataFrame([(1, month(m), 2020 * 12 + 1 + m, float(m)) for m in months], "entity long, eom date, month_index int, ret_exc_lead1m double")
    out = joins.horizon_join(df, df.select("entity", "eom", "month_index"), 3)
    got = {(r["eom"], r["horizon"]): r["ret_exc_lead1m"] for r in out.collect()}
    assert got[(month(1), 3)] == 3.0 and (month(1), 2) not in got
    pairs = joins.transition_pairs(df, ["ret_exc_lead1m"])
    assert {r["eom"] for r in pairs.collect()} == {month(0), month(3)}


def test_path_metrics(spark):
    path = [0.4, 0.3, 0.1, 0.25, -0.1] + [0.05] * 7
    df = spark.createDataFrame([("f", h + 1, v) for h, v in enumerate(path)] + [("flat", h + 1, 0.0) for h in range(12)], "feature string, horizon int, v double")
    got = {r["feature"]: r for r in signals.path_metrics(df, ["feature"], "v").collect()}
    assert got["f"]["sfm"] == pytest.approx(sum(path[1:]))
    assert got["f"]["first_decay"] == 3 and got["f"]["recovers"] and got["f"]["first_reversal"] == 5
    assert got["f"]["apr_3"] == pytest.approx(0.4 / 0.8)
    assert got["flat"]["near_zero"] and got["flat"]["sfm"] is None


def test_diversified_choice(spark):
    rows = [("q1", "Q", 0.5, True), ("q2", "Q", 0.9, True), ("q3", "Q", 0.8, True), ("v1", "V", 0.1, True), ("v2", "V", 0.95, False)]
    df = spark.createDataFrame(rows, "feature string, theme string, s double, ok boolean")
    picks = signals.select_diversified(df, "s", "ok", ["V", "Q"], wanted=3).orderBy("pick").collect()
    assert [r["feature"] for r in picks] == ["v1", "q2", "q3"]


def test_cumulative_selection_looks_back_only(spark):
    rows = []
    for y in range(2000, 2004):
        for m in range(12):
            for c, level in (("a", 0.01), ("b", 0.02 if y < 2002 else -0.05)):
                rows.append((pd.Timestamp(y, m + 1, 28).date(), y, "aim", c, level, 0.0, level + 0.0001 * m))
    df = spark.createDataFrame(rows, "eom date, test_year int, method string, candidate string, gross_return double, trading_cost double, utility_flow double")
    chosen = selection.select_cumulative(df, ["static_ml"], 2001)
    picks = {r["test_year"]: r["candidate"] for r in chosen.where("selected").collect()}
    assert picks == {2001: "b", 2002: "b", 2003: "a"}
    stable = selection.selection_stability(chosen).first()
    assert stable["changes"] == 1 and stable["cutoff_violations"] == 0 and stable["modal_value"] == "b"
    planted = chosen.withColumn("future_information_used", F.col("test_year") == 2001).withColumn(
        "latest_validation_year", F.when(F.col("test_year") == 2002, 2002).otherwise(F.col("latest_validation_year"))
    )
    broken = selection.selection_stability(planted).first()
    assert broken["future_information_violations"] == 1 and broken["cutoff_violations"] == 1


def test_splits_are_disjoint(spark):
    years = spark.createDataFrame([(y,) for y in (2000, 2001)], "test_year int")
    splits = joins.rolling_splits(years, "1990-01-01", 3)
    ends = {(r["test_year"], r["part"]): (r["start"], r["end"]) for r in splits.collect()}
    assert ends[(2000, "train")][1] < ends[(2000, "validation")][0]
    assert ends[(2000, "validation")][1] < ends[(2000, "test")][0]
    assert str(ends[(2000, "train")][1]) == "1996-12-31"


def test_leave_one_out(spark):
    df = spark.createDataFrame([("a", 1.0, 1.0), ("b", 2.0, 2.0), ("c", 3.0, 3.0), ("d", 4.0, -9.0)], "f string, x double, y double")
    got = {r["omitted"]: r["spearman"] for r in signals.leave_one_out(df, "f", "x", "y").collect()}
    assert got["d"] == pytest.approx(1.0) and got["a"] < 0.5


def test_importance_shares(spark):
    full = spark.createDataFrame([("full", 0.05)], "scope string, u double")
    neutral = spark.createDataFrame([("full", "a", 0.02), ("full", "b", 0.04), ("full", "c", 0.06)], "scope string, neutralized string, u double")
    got = {r["neutralized"]: r for r in selection.importance(full, neutral, "u", ["scope"]).collect()}
    assert got["a"]["share"] == pytest.approx(0.75) and got["a"]["place"] == 1
    assert got["c"]["share"] == 0.0 and got["c"]["place"] == 3


def test_horizons_are_multiplied_after_the_shuffle(spark):
    """One exchange of rows that aren't exploded yet, and the labels of exactly the wanted months."""
    from crosspanel.operators import joins

    data = [(i, m, month(m), float(10 * m + i) if (i + m) % 4 else None) for i in range(6) for m in range(20) if (i * m) % 5 != 3]
    df = spark.createDataFrame(data, "entity long, month_index int, eom date, ret_exc_lead1m double")
    features = df.select("entity", "month_index", "eom", (F.col("month_index") * 2).alias("x")).where("month_index % 3 <> 1")
    features = features.unionByName(spark.createDataFrame([(2, 99, month(99), 1), (77, 3, month(3), 1)], features.schema))
    out = joins.horizon_join(df, features, 4)
    got = {(r.entity, r.month_index, r.horizon, r.x, r.target_eom, r.ret_exc_lead1m) for r in out.collect()}
    known = {(i, m): (e, y) for i, m, e, y in data if y is not None}
    want = {
        (i, m, h, 2 * m, *known[i, m + h - 1])
        for i, m, *_ in data if m % 3 != 1 for h in range(1, 5) if (i, m + h - 1) in known
    }
    assert got == want and out.count() == len(want)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.index("Generate") < plan.index("Window")


def test_horizon_statistics_without_multiplied_rows(spark):
    """Every horizon from rows that carry their labels: shuffled by name and by month once, and equal to ranks of the matched rows."""
    rng = np.random.default_rng(8)
    data = [
        (i, m, month(m), float(rng.integers(0, 9)) / 7 if (i + m) % 6 else None, float(rng.integers(0, 12)) / 11, 1 / 3, float(rng.random()))
        for i in range(40) for m in range(14) if (i * m) % 7 != 3 and m != 9 and (m < 12 or i < 12)
    ]
    df = spark.createDataFrame(data, "entity long, month_index int, eom date, ret_exc_lead1m double, a double, flat double, c double")
    features = {"a": "a", "flat": "flat", "c": "c"}
    out = signals.horizon_ic(df, features, "ret_exc_lead1m", 4, group_rows=40, rows=len(data))
    matched = joins.horizon_join(df, df.select("entity", "eom", "month_index", *features), 4)
    key = ["feature", "horizon", "eom"]
    want = {
        (f, *r[:2]): r[2:]
        for f in features
        for r in signals.monthly_ic(matched, ["horizon", "eom"], f, "ret_exc_lead1m").collect()
    }
    got = {tuple(r[k] for k in key): tuple(r[c] for c in r.asDict() if c not in key) for r in out.collect()}
    assert set(got) == set(want)
    for k, values in want.items():
        assert got[k] == pytest.approx(tuple(values), abs=1e-12, nan_ok=True), k
    assert any(v[1] is None for k, v in got.items() if k[0] == "c") and all(v[1] is None for k, v in got.items() if k[0] == "flat")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and out.select("*")._jdf.queryExecution().executedPlan().toString().count("Exchange") == 2
    one = {(r["feature"], r["eom"]): tuple(r)[2:] for r in signals.feature_ic(df, features, "ret_exc_lead1m", group_rows=40, rows=len(data)).collect()}
    assert one == {(f, e): v for (f, h, e), v in got.items() if h == 1}


def test_feature_level_ranks_in_windows(spark):
    """A table of a few features is ranked in windows, without buckets."""
    df = spark.createDataFrame([(f, float(i % 4), float(i * i % 5)) for i, f in enumerate("abcdef")], "f string, x double, y double")
    out = signals.leave_one_out(df, "f", "x", "y", group_rows=6)
    want = {r["omitted"]: tuple(r)[1:] for r in signals.leave_one_out(df, "f", "x", "y").collect()}
    assert {r["omitted"]: pytest.approx(tuple(r)[1:], abs=1e-12) for r in out.collect()} == want
    assert "xxhash64" not in out._jdf.queryExecution().optimizedPlan().toString()
