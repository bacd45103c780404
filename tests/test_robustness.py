"""Samples that leave years out, against plain loops."""

from __future__ import annotations

import datetime as dt
import hashlib

import numpy as np
import pytest

from crosspanel.operators import inference

EXCLUDED = {"full": [], "no_2001": [2001], "none_left": [2000, 2001, 2002]}


def start(seed: int, rep: int, block: int, n: int) -> int:
    return int(hashlib.md5(f"{seed}|{rep}|{block}".encode()).hexdigest()[:8], 16) % n


def robust(v: np.ndarray, lags: int) -> float:
    n = len(v)
    c = v - v.mean()
    lags = min(lags, n - 1)
    total = c @ c / n + sum(2 * (1 - k / (lags + 1)) * (c[k:] @ c[:-k]) / n for k in range(1, lags + 1))
    return float(np.sqrt(max(total, 0) / n))


def test_sample_inference(spark):
    rng = np.random.default_rng(8)
    series = {dt.date(y, m, 28): float(rng.normal(0.002, 0.01)) for y in (2000, 2001, 2002) for m in range(1, 13)}
    fields = ", ".join(f"delta_{f} double" for f in inference.OUTCOMES)
    rows = [(d, d.year, "a", "b", *[v if f == "utility_flow" else None for f in inference.OUTCOMES]) for d, v in series.items()]
    df = spark.createDataFrame(rows, f"eom date, test_year int, candidate_method string, benchmark_method string, {fields}")
    got = {r["sample"]: r for r in inference.sample_inference(df, EXCLUDED, replications=40, block=5, lags=3, seed=11).collect()}
    assert set(got) == {"full", "no_2001"}
    for i, name in enumerate(("full", "no_2001")):
        kept = np.array([v for d, v in sorted(series.items()) if d.year not in EXCLUDED[name]])
        n, r = len(kept), got[name]
        means = []
        for rep in range(1, 41):
            places = [(start(11 + i, rep, b, n) + j) % n for b in range(-(-n // 5)) for j in range(5)][:n]
            means.append(kept[places].mean())
        assert r.n == n and r.seed == 11 + i and r.replications == 40
        assert r["mean"] == pytest.approx(kept.mean()) and r.nw_se == pytest.approx(robust(kept, 3))
        assert r.ci_lower == pytest.approx(12 * np.quantile(means, 0.025))
        assert r.ci_upper == pytest.approx(12 * np.quantile(means, 0.975))
        assert r.probability_positive == pytest.approx(np.mean(np.array(means) > 0))
        years = [sum(v for d, v in series.items() if d.year == y) for y in (2000, 2001, 2002) if y not in EXCLUDED[name]]
        assert r.years_total == len(years) and r.years_won == sum(y > 0 for y in years)
        assert r.cumulative == pytest.approx(sum(years)) and r.median_annual == pytest.approx(np.median(years))
    assert inference.sample_inference(df.limit(0), EXCLUDED, replications=5).count() == 0
