"""Registered queries: inference and risk calibration on samples that leave years out."""

from __future__ import annotations

from crosspanel.operators import inference, risk
from crosspanel.plans.comparisons import DIFFS, KEYS, differences
from crosspanel.plans.registry import register
from crosspanel.plans.riskplans import MODEL_CTES, risk_returns
from crosspanel.plans.signals import nw_sql

SAMPLES = {"full": [], "no_1998": [1998], "no_1997_1998": [1997, 1998], "no_2000": [2000], "no_1995": [1995]}
SAMPLE_SQL = "(VALUES " + ", ".join(f"('{n}', {i}, {y})" for i, (n, y) in enumerate(SAMPLES.items())) + ") s(sample, seed, gone)"
BY = f"sample, seed, {KEYS}, outcome"

INFERENCE = f"""{DIFFS},
kept AS (SELECT s.sample, CAST(s.seed AS INTEGER) AS seed, o.* FROM outcomes o JOIN {SAMPLE_SQL} ON NOT list_contains(s.gone, o.test_year) WHERE outcome = 'utility_flow'),
kseries AS (SELECT {BY}, delta, row_number() OVER (PARTITION BY {BY} ORDER BY eom) - 1 AS i, count(*) OVER (PARTITION BY {BY}) AS n FROM kept WHERE delta IS NOT NULL),
kstarts AS (SELECT seed, n, rep, b, CAST('0x' || substr(md5(seed || '|' || rep || '|' || b), 1, 8) AS BIGINT) % n AS start FROM (SELECT DISTINCT seed, n FROM kseries) CROSS JOIN (SELECT unnest(range(1, 2001)) AS rep), LATERAL (SELECT unnest(range(0, CAST(ceil(n / least(12, n)::DOUBLE) AS BIGINT))) AS b)),
kplaces AS (SELECT s.seed, s.n, rep, (start + i % least(12, s.n)) % s.n AS place FROM kstarts s, LATERAL (SELECT unnest(range(0, s.n)) AS i) WHERE i // least(12, s.n) = b),
kmeans AS (SELECT sample, s.seed, {KEYS}, outcome, rep, avg(delta) AS m FROM kplaces p JOIN kseries s ON s.seed = p.seed AND s.n = p.n AND s.i = p.place GROUP BY ALL),
kboot AS (SELECT {BY}, 12 * quantile_cont(m, 0.025) AS ci_lower, 12 * quantile_cont(m, 0.975) AS ci_upper, avg(CASE WHEN m > 0 THEN 1e0 ELSE 0e0 END) AS probability_positive, count(*) AS replications FROM kmeans GROUP BY ALL),
kwon AS (SELECT {BY}, median(y) AS median_annual, count(*) FILTER (WHERE y > 0) AS years_won, count(*) AS years_total, sum(y) AS cumulative FROM (SELECT {BY}, test_year, sum(delta) AS y FROM kept GROUP BY ALL) GROUP BY ALL)"""


@register(
    "sample_inference",
    "sample candidate_method benchmark_method outcome n:bigint mean:8 annualized_mean:8 lags nw_se:8 nw_t:6 ci_lower:8 ci_upper:8 probability_positive:4 replications:bigint median_annual:8 years_won:bigint years_total:bigint cumulative:8",
    f"SELECT *, 12 * mean AS annualized_mean FROM ({nw_sql('kept', BY, 'delta')}) JOIN kwon USING ({BY}) JOIN kboot USING ({BY})",
    INFERENCE,
)
def sample_inference(spark, sf_dir):
    """Utility differences on five samples that leave years out, each with its own draws."""
    return inference.sample_inference(differences(spark, sf_dir), SAMPLES)


CALIBRATED = f"""{MODEL_CTES},
sampled AS (SELECT s.sample, r.* FROM model_rets r JOIN {SAMPLE_SQL} ON NOT list_contains(s.gone, r.test_year)),
sfull AS (SELECT sample, method, count(*) AS n_months, count(*) FILTER (WHERE risk_model_used <> 'factor' OR risk_fallback_reason IS NOT NULL) AS fallbacks FROM sampled GROUP BY 1, 2),
syears AS (SELECT sample, method, test_year, CASE WHEN avg(ex_ante_monthly_variance) > 0 THEN sqrt(12) * stddev_samp(net_return) / sqrt(12 * avg(ex_ante_monthly_variance)) END AS ratio FROM sampled GROUP BY 1, 2, 3),
sspread AS (SELECT sample, method, median(ratio) AS ratio_median, quantile_cont(ratio, 0.1) AS ratio_p10, quantile_cont(ratio, 0.9) AS ratio_p90, max(ratio) AS ratio_max, avg(CASE WHEN ratio BETWEEN 0.6 AND 1.5 THEN 1e0 ELSE 0e0 END) FILTER (WHERE ratio IS NOT NULL) AS within_share, count(*) FILTER (WHERE ratio > 2) AS above_two, count(ratio) AS years FROM syears GROUP BY 1, 2)"""


@register(
    "sample_calibration",
    "sample method n_months:bigint fallbacks:bigint ratio_median:6 ratio_p10:6 ratio_p90:6 ratio_max:6 within_share:8 above_two:bigint passed",
    "SELECT *, coalesce(years > 0 AND ratio_median BETWEEN 0.8 AND 1.25 AND within_share >= 0.8 AND above_two <= greatest(1, ceil(0.1 * years)) AND fallbacks = 0, false) AS passed FROM sfull JOIN sspread USING (sample, method)",
    CALIBRATED,
)
def sample_calibration(spark, sf_dir):
    """The quality gate of predicted volatility on the same five samples."""
    rows = inference.samples(risk_returns(spark, sf_dir), SAMPLES)
    return risk.calibration_report(rows, ("sample", "method")).where("scope = 'summary'")
