"""Registered queries: information coefficients, persistence, horizon paths, feature choice."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from crosspanel import settings as S
from crosspanel.functions import scalars as X
from crosspanel.operators import inference, joins, performance, ranks, signals, windows
from crosspanel.plans import base
from crosspanel.plans.models import HISTORY, _predictions
from crosspanel.plans.registry import register
from crosspanel.plans.scans import LONG_SQL, THEME_SQL
from crosspanel.plans.sqltext import FEATURES, panel_ctes
from crosspanel.sources.panel import THEMES

PANEL = panel_ctes()
LABEL = "ret_exc_lead1m"
RANK_COLUMNS = [f"rank_{f}" for f in FEATURES]
FILLED = {f: f"rank_{f}" for f in FEATURES}


def corr_sql(a: str, b: str) -> str:
    return f"CASE WHEN stddev_pop({a}) > 1e-12 AND stddev_pop({b}) > 1e-12 THEN corr({a}, {b}) END"


def ic_sql(source: str, by: str, x: str, y: str, minimum: int = 20) -> str:
    """Rank and Pearson correlation with the cross-sectional line, per group."""
    ok = f"count(*) >= {minimum} AND stddev_pop(x) > 1e-12"
    return (
        f"SELECT {by}, count(*) AS n_valid, CASE WHEN {ok} THEN {corr_sql('x', 'y')} END AS pearson_ic, CASE WHEN {ok} THEN {corr_sql('rx', 'ry')} END AS rank_ic, "
        f"CASE WHEN {ok} THEN regr_intercept(y, x) END AS fmb_intercept, CASE WHEN {ok} THEN regr_slope(y, x) END AS fmb_slope FROM "
        f"(SELECT {by}, {x} AS x, {y} AS y, rank() OVER (PARTITION BY {by} ORDER BY {x}) + (count(*) OVER (PARTITION BY {by}, {x}) - 1) / 2e0 AS rx, "
        f"rank() OVER (PARTITION BY {by} ORDER BY {y}) + (count(*) OVER (PARTITION BY {by}, {y}) - 1) / 2e0 AS ry FROM {source} WHERE {x} IS NOT NULL AND {y} IS NOT NULL) GROUP BY {by}"
    )


LONG = f"{PANEL},\nlong AS ({LONG_SQL})"
IC = f"{LONG},\nic AS ({ic_sql('long', 'feature, eom', 'rank_value', LABEL)})"
HORIZON = f"""{LONG},
spread AS (SELECT entity, eom AS target_eom, {LABEL}, h AS horizon, month_index - h + 1 AS month_index FROM panel, LATERAL (SELECT CAST(unnest(range(1, 13)) AS INTEGER) AS h) WHERE {LABEL} IS NOT NULL),
matched AS (SELECT l.feature, l.eom, l.rank_value, s.horizon, s.{LABEL} AS target FROM long l JOIN spread s ON l.entity = s.entity AND l.month_index = s.month_index),
stats AS ({ic_sql('matched', 'feature, horizon, eom', 'rank_value', 'target')}),
fmb AS (SELECT feature, horizon, avg(fmb_slope) AS slope, avg(rank_ic) AS ric FROM stats GROUP BY 1, 2)"""


def long(spark, sf_dir, keep=("entity", "eom", "month_index", LABEL)) -> DataFrame:
    return performance.unpivot_features(base.panel(spark, sf_dir), FEATURES, list(keep))


def monthly_ic(spark, sf_dir) -> DataFrame:
    return base.shared(
        spark, sf_dir, "monthly_ic",
        lambda: signals.feature_ic(
            base.panel(spark, sf_dir), FILLED, LABEL, group_rows=base.bound(spark, sf_dir), rows=base.rows(spark, sf_dir)
        ),
    )


def horizon_stats(spark, sf_dir) -> DataFrame:
    return base.shared(
        spark, sf_dir, "horizon_stats",
        lambda: signals.horizon_ic(
            base.panel(spark, sf_dir), FILLED, LABEL, group_rows=base.bound(spark, sf_dir), rows=base.rows(spark, sf_dir)
        ),
    )


def pairs(spark, sf_dir) -> DataFrame:
    """Month t next to t+1, unpivoted: (feature, eom, value, next_value)."""
    wide = joins.transition_pairs(base.panel(spark, sf_dir), RANK_COLUMNS)
    items = F.array(
        *[
            F.struct(F.lit(f).alias("feature"), F.col(f"rank_{f}").alias("value"), F.col(f"next_rank_{f}").alias("next_value"))
            for f in FEATURES
        ]
    )
    return wide.select("entity", "eom", F.inline(items))


PAIRS = f"""{LONG},
led AS (SELECT *, lead(rank_value) OVER w AS next_value, lead(month_index) OVER w AS next_index FROM long WINDOW w AS (PARTITION BY feature, entity ORDER BY month_index)),
pairs AS (SELECT feature, entity, eom, rank_value AS value, next_value FROM led WHERE next_index = month_index + 1)"""


@register("monthly_ic", "feature eom n_valid pearson_ic:8 rank_ic:8", "SELECT * FROM ic", IC)
def monthly_ic_plan(spark, sf_dir):
    return monthly_ic(spark, sf_dir)


@register(
    "horizon_join",
    "feature horizon rows:bigint mean_target:8 first_month last_month",
    "SELECT feature, horizon, count(*) AS rows, avg(target) AS mean_target, min(eom) AS first_month, max(eom) AS last_month FROM matched GROUP BY 1, 2",
    HORIZON,
)
def horizon_join(spark, sf_dir):
    """Features at t with labels at t+h-1, matched by month number."""
    features = long(spark, sf_dir, ("entity", "eom", "month_index")).drop("raw_value")
    rows = joins.horizon_join(base.panel(spark, sf_dir), features, S.HORIZONS)
    return rows.groupBy("feature", "horizon").agg(
        F.count(F.lit(1)).alias("rows"), F.avg(LABEL).alias("mean_target"),
        F.min("eom").alias("first_month"), F.max("eom").alias("last_month"),
    )


@register(
    "horizon_stats",
    "feature horizon eom n_valid rank_ic:8 pearson_ic:8 fmb_intercept:8 fmb_slope:8",
    "SELECT * FROM stats",
    HORIZON,
)
def horizon_stats_plan(spark, sf_dir):
    return horizon_stats(spark, sf_dir)


SUMMARY = (
    "SELECT feature, avg(rank_ic) AS mean, median(rank_ic) AS median, stddev_samp(rank_ic) AS std, count(rank_ic) AS valid_months, "
    "CASE WHEN stddev_samp(rank_ic) > 0 THEN avg(rank_ic) / stddev_samp(rank_ic) END AS information_ratio, avg(n_valid) AS mean_n FROM ic GROUP BY feature"
)


@register(
    "ic_summary", "feature mean:8 median:8 std:8 valid_months information_ratio:8 mean_n:8", SUMMARY, IC
)
def ic_summary(spark, sf_dir):
    return signals.ic_summary(monthly_ic(spark, sf_dir), ["feature"], "rank_ic")


def nw_sql(source: str, by: str, value: str, lags: int = 6) -> str:
    """Newey-West mean test of one series per ``by``."""
    lagged = ", ".join(f"lag(c, {k}) OVER w AS c{k}" for k in range(1, lags + 1))
    terms = " + ".join(
        f"coalesce(2 * greatest(1 - {k}e0 / (least({lags}, count(*) - 1) + 1), 0e0) * sum(c * c{k}) / count(*), 0e0)" for k in range(1, lags + 1)
    )
    return (
        f"SELECT {by}, n, mean, lags, nw_se, CASE WHEN nw_se > 0 THEN mean / nw_se END AS nw_t FROM (SELECT {by}, count(*) AS n, avg(v) AS mean, CAST(least({lags}, count(*) - 1) AS INTEGER) AS lags, "
        f"sqrt(greatest(sum(c * c) / count(*) + {terms}, 0e0) / count(*)) AS nw_se FROM (SELECT *, {lagged} FROM (SELECT {by}, eom, {value} AS v, {value} - avg({value}) OVER (PARTITION BY {by}) AS c FROM {source} WHERE {value} IS NOT NULL) "
        f"WINDOW w AS (PARTITION BY {by} ORDER BY eom)) GROUP BY {by})"
    )


@register(
    "newey_west", "feature n mean:8 lags nw_se:8 nw_t:6", nw_sql("ic", "feature", "rank_ic"), IC
)
def newey_west(spark, sf_dir):
    return inference.newey_west(monthly_ic(spark, sf_dir), "rank_ic", S.HAC_LAGS, ["feature"], "eom")


@register(
    "fmb_summary",
    "feature horizon valid_months mean:8 median:8 std:8 plain_se:8 plain_t:6 nw_se:8 nw_t:6",
    f"SELECT a.feature, a.horizon, n AS valid_months, mean, median, std, std / sqrt(n) AS plain_se, CASE WHEN std > 0 THEN mean / (std / sqrt(n)) END AS plain_t, nw_se, nw_t FROM ({nw_sql('stats', 'feature, horizon', 'fmb_slope')}) a "
    "JOIN (SELECT feature, horizon, median(fmb_slope) AS median, stddev_samp(fmb_slope) AS std FROM stats GROUP BY 1, 2) b ON a.feature = b.feature AND a.horizon = b.horizon",
    HORIZON,
)
def fmb_summary(spark, sf_dir):
    return signals.fmb_summary(horizon_stats(spark, sf_dir), ["feature", "horizon"])


@register(
    "transition_pairs",
    "eom pairs:bigint overlap_fraction:8",
    "SELECT a.eom, pairs, pairs / least(a.n, b.n)::DOUBLE AS overlap_fraction FROM (SELECT eom, month_index, count(*) AS n FROM panel GROUP BY 1, 2) a JOIN (SELECT month_index, count(*) AS n FROM panel GROUP BY 1) b ON b.month_index = a.month_index + 1 "
    "JOIN (SELECT eom, count(*) AS pairs FROM pairs WHERE feature = 'tax' GROUP BY 1) p ON a.eom = p.eom",
    PAIRS,
)
def transition_pairs(spark, sf_dir):
    rows = base.panel(spark, sf_dir)
    return joins.overlap_fraction(rows, joins.transition_pairs(rows, ["rank_tax"]))


PERSIST = f"{PAIRS},\npersist AS ({ic_sql('pairs', 'feature, eom', 'value', 'next_value')})"


def persistence(spark, sf_dir) -> DataFrame:
    return base.shared(
        spark, sf_dir, "persistence",
        lambda: signals.monthly_ic(
            pairs(spark, sf_dir), ["feature", "eom"], "value", "next_value", group_rows=base.bound(spark, sf_dir)
        ),
    )


@register("persistence", "feature eom n_valid pearson_ic:8 rank_ic:8", "SELECT * FROM persist", PERSIST)
def persistence_plan(spark, sf_dir):
    """Correlation of each feature with itself one month on."""
    return persistence(spark, sf_dir)


@register(
    "distribution_summary",
    "feature mean:8 median:8 std:8 p10:8 p90:8",
    "SELECT feature, avg(rank_ic) AS mean, median(rank_ic) AS median, stddev_samp(rank_ic) AS std, quantile_cont(rank_ic, 0.1) AS p10, quantile_cont(rank_ic, 0.9) AS p90 FROM persist GROUP BY 1",
    PERSIST,
)
def distribution_summary(spark, sf_dir):
    return performance.distribution_summary(persistence(spark, sf_dir), "rank_ic", ["feature"])


AR1 = (
    "SELECT *, CASE WHEN se > 0 THEN rho / se END AS t FROM (SELECT feature, count(*) AS pairs, regr_slope(next_value, value) AS rho, regr_intercept(next_value, value) AS intercept, "
    "sqrt(greatest(regr_syy(next_value, value) - pow(regr_slope(next_value, value), 2) * regr_sxx(next_value, value), 0e0) / (count(*) - 2) / regr_sxx(next_value, value)) AS se, regr_r2(next_value, value) AS r2 FROM pairs GROUP BY 1)"
)


@register(
    "pooled_ar1",
    "feature ar1_pairs:bigint ar1_rho:8 ar1_intercept:8 ar1_se:8 ar1_t:6 ar1_r2:8",
    f"SELECT feature, pairs AS ar1_pairs, rho AS ar1_rho, intercept AS ar1_intercept, se AS ar1_se, t AS ar1_t, r2 AS ar1_r2 FROM ({AR1})",
    PAIRS,
)
def pooled_ar1(spark, sf_dir):
    return signals.pooled_ar1(pairs(spark, sf_dir), ["feature"], "value", "next_value")


@register(
    "half_life",
    "feature decay:8 half_life:6",
    f"SELECT feature, 1 - rho AS decay, CASE WHEN rho > 0 AND rho < 1 THEN ln(0.5e0) / ln(rho) END AS half_life FROM ({AR1})",
    PAIRS,
)
def half_life(spark, sf_dir):
    rows = signals.pooled_ar1(pairs(spark, sf_dir), ["feature"], "value", "next_value")
    return rows.select(
        "feature", (F.lit(1.0) - F.col("ar1_rho")).alias("decay"), signals.half_life(F.col("ar1_rho")).alias("half_life")
    )


def _persistence_table(spark, sf_dir) -> DataFrame:
    rows = long(spark, sf_dir)
    monthly = persistence(spark, sf_dir).groupBy("feature").agg(
        F.avg("pearson_ic").alias("pearson"), F.avg("rank_ic").alias("spearman")
    )
    ar1 = signals.pooled_ar1(pairs(spark, sf_dir), ["feature"], "value", "next_value").select("feature", "ar1_rho")
    fills = performance.feature_coverage(rows, ["feature"]).select("feature", "neutral_fill_rate")
    ties = performance.tie_fraction(rows, ["feature"], "rank_value")
    panel = base.panel(spark, sf_dir)
    overlap = joins.overlap_fraction(panel, joins.transition_pairs(panel, ["rank_tax"])).agg(
        F.avg("overlap_fraction").alias("overlap")
    )
    table = reduce(lambda a, b: a.join(b, "feature"), [monthly, ar1, fills, ties])
    return table.join(F.broadcast(overlap))


@register(
    "persistence_flag",
    "feature max_gap:8 sign_disagreement flag note",
    f"""SELECT feature, gap AS max_gap, signs AS sign_disagreement, CASE WHEN gap > 0.1e0 OR signs THEN 'review' ELSE 'aligned' END AS flag,
    CASE WHEN NOT (gap > 0.1e0 OR signs) THEN 'AR(1), monthly Pearson and monthly Spearman persistence are aligned'
      ELSE 'maximum metric gap ' || printf('%.3f', gap) || '; ' || CASE WHEN detail = '' THEN 'rank transformation or nonlinear cross-sectional movement' ELSE detail END END AS note
    FROM (SELECT feature, greatest(rho, pearson, spearman) - least(rho, pearson, spearman) AS gap, greatest(CASE WHEN abs(rho) > 0.05 THEN sign(rho) ELSE 0 END, CASE WHEN abs(pearson) > 0.05 THEN sign(pearson) ELSE 0 END, CASE WHEN abs(spearman) > 0.05 THEN sign(spearman) ELSE 0 END) > 0
      AND least(CASE WHEN abs(rho) > 0.05 THEN sign(rho) ELSE 0 END, CASE WHEN abs(pearson) > 0.05 THEN sign(pearson) ELSE 0 END, CASE WHEN abs(spearman) > 0.05 THEN sign(spearman) ELSE 0 END) < 0 AS signs,
      concat_ws('; ', CASE WHEN fill > 0.1 THEN 'material neutral-rank missing-value fills' END, CASE WHEN tie > 0.1 THEN 'material rank ties' END, CASE WHEN overlap < 0.9 THEN 'low dynamic-universe overlap' END) AS detail
      FROM ({AR1}) JOIN (SELECT feature, avg(pearson_ic) AS pearson, avg(rank_ic) AS spearman FROM persist GROUP BY 1) USING (feature)
      JOIN (SELECT feature, avg(CASE WHEN raw_value IS NULL AND rank_value = 0.5 THEN 1e0 ELSE 0e0 END) AS fill FROM long GROUP BY 1) USING (feature)
      JOIN (SELECT feature, avg(tie) AS tie FROM (SELECT feature, eom, 1 - count(DISTINCT rank_value) / count(*)::DOUBLE AS tie FROM long GROUP BY 1, 2) GROUP BY 1) USING (feature)
      CROSS JOIN (SELECT avg(pairs / least(a.n, b.n)::DOUBLE) AS overlap FROM (SELECT eom, month_index, count(*) AS n FROM panel GROUP BY 1, 2) a JOIN (SELECT month_index, count(*) AS n FROM panel GROUP BY 1) b ON b.month_index = a.month_index + 1
        JOIN (SELECT eom, count(*) AS pairs FROM pairs WHERE feature = 'tax' GROUP BY 1) p ON a.eom = p.eom))""",
    PERSIST,
)
def persistence_flag(spark, sf_dir):
    table = _persistence_table(spark, sf_dir)
    flags = signals.persistence_flag(
        [F.col("ar1_rho"), F.col("pearson"), F.col("spearman")],
        F.col("neutral_fill_rate"), F.col("tie_fraction"), F.col("overlap"),
    )
    return table.select("feature", *[c.alias(n) for n, c in flags.items()])


@register(
    "rank_autocorr",
    "feature eom autocorrelation:8 mean_abs_change:8",
    f"SELECT feature, eom, {corr_sql('CASE WHEN prior IS NOT NULL THEN rank_value END', 'prior')} AS autocorrelation, avg(abs(rank_value - prior)) AS mean_abs_change FROM "
    "(SELECT *, CASE WHEN month_index - lag(month_index) OVER w = 1 THEN lag(rank_value) OVER w END AS prior FROM long WINDOW w AS (PARTITION BY feature, entity ORDER BY month_index)) GROUP BY 1, 2",
    LONG,
)
def rank_autocorr(spark, sf_dir):
    """Lag-1 rank correlation by month; the lag runs on the wide panel, once for all features."""
    wide = windows.lag_month(base.panel(spark, sf_dir), RANK_COLUMNS)
    items = F.array(
        *[
            F.struct(F.lit(f).alias("feature"), F.col(f"rank_{f}").alias("value"), F.col(f"lag_rank_{f}").alias("previous"))
            for f in FEATURES
        ]
    )
    return signals.rank_autocorrelation(wide.select("eom", F.inline(items)), ["feature"], "value", "previous")


CORR_PAIRS = [(a, b) for a in FEATURES for b in FEATURES if a != b]
CORR_SQL = " UNION ALL ".join(
    f"SELECT eom, 'rank_{a}' AS feature, 'rank_{b}' AS other, {corr_sql('rank_' + a, 'rank_' + b)} AS correlation FROM panel GROUP BY eom"
    for a, b in CORR_PAIRS
)
CORRELATIONS = f"{PANEL},\ncorrelations AS ({CORR_SQL})"


@register("monthly_correlations", "eom feature other correlation:8", "SELECT * FROM correlations", CORRELATIONS)
def monthly_correlations(spark, sf_dir):
    return signals.monthly_correlations(base.panel(spark, sf_dir), RANK_COLUMNS, RANK_COLUMNS)


@register(
    "corr_matrix",
    "feature average_abs:8 max_abs:8 most_correlated",
    "SELECT feature, avg(abs(c)) AS average_abs, max(abs(c)) AS max_abs, arg_min(other, (-abs(c), other)) AS most_correlated FROM (SELECT feature, other, avg(correlation) AS c FROM correlations GROUP BY 1, 2) GROUP BY 1",
    CORRELATIONS,
)
def corr_matrix(spark, sf_dir):
    return signals.correlation_summary(
        signals.monthly_correlations(base.panel(spark, sf_dir), RANK_COLUMNS, RANK_COLUMNS)
    )


@register(
    "pooled_corr",
    "a_b:8 a_c:8 b_c:8",
    "SELECT corr(rank_discount, rank_tax) AS a_b, corr(rank_discount, rank_qty) AS a_c, corr(rank_tax, rank_qty) AS b_c FROM panel",
    PANEL,
)
def pooled_corr(spark, sf_dir):
    return base.panel(spark, sf_dir).agg(
        signals.correlation("rank_discount", "rank_tax").alias("a_b"),
        signals.correlation("rank_discount", "rank_qty").alias("a_c"),
        signals.correlation("rank_tax", "rank_qty").alias("b_c"),
    )


STABILITY = (
    "SELECT feature, max(mean_ic) AS mean_ic, avg(CASE WHEN a > 0 THEN 1e0 ELSE 0e0 END) AS positive_year_share, avg(CASE WHEN CASE WHEN mean_ic >= 0 THEN 1 ELSE -1 END * a > 0 THEN 1e0 ELSE 0e0 END) AS same_sign_year_share, "
    "sum(CASE WHEN rn <= 3 THEN abs(a) END) / greatest(sum(abs(a)), 1e-16) AS top3_year_share FROM (SELECT feature, a, mean_ic, row_number() OVER (PARTITION BY feature ORDER BY abs(a) DESC) AS rn FROM "
    "(SELECT feature, year(eom) AS y, avg(rank_ic) AS a FROM ic GROUP BY 1, 2) JOIN (SELECT feature, avg(rank_ic) AS mean_ic FROM ic GROUP BY 1) USING (feature) WHERE a IS NOT NULL) GROUP BY 1"
)


@register(
    "ic_stability",
    "feature mean_ic:8 positive_year_share:8 same_sign_year_share:8 top3_year_share:8",
    STABILITY,
    IC,
)
def ic_stability(spark, sf_dir):
    return signals.ic_stability(monthly_ic(spark, sf_dir), ["feature"])


@register(
    "prediction_relation",
    "feature mean_corr:8 months:bigint mean_prediction_std:8",
    "SELECT feature, avg(c) AS mean_corr, count(c) AS months, avg(sd) AS mean_prediction_std FROM ("
    + " UNION ALL ".join(
        f"SELECT 'rank_{f}' AS feature, eom, {corr_sql('rank_' + f, 'mu_hat')} AS c, stddev_samp(mu_hat) AS sd FROM predictions GROUP BY eom" for f in FEATURES
    )
    + ") GROUP BY 1",
    HISTORY,
)
def prediction_relation(spark, sf_dir):
    """How each feature lines up with the model's prediction, month by month."""
    rows = _predictions(spark, sf_dir)
    monthly = signals.monthly_correlations(rows, RANK_COLUMNS, ["mu_hat"])
    spread = rows.groupBy("eom").agg(F.stddev_samp("mu_hat").alias("sd"))
    return monthly.join(F.broadcast(spread), "eom").groupBy("feature").agg(
        F.avg("correlation").alias("mean_corr"), F.count("correlation").alias("months"), F.avg("sd").alias("mean_prediction_std")
    )


def path_sql(value: str) -> str:
    """Path metrics from one row per (feature, horizon)."""
    return f"""
  SELECT feature, h1, false AS near_zero, CAST(sign(h1) AS INTEGER) AS direction, sum(greatest(v, 0e0)) FILTER (WHERE horizon > 1) AS sdm, sum(v) FILTER (WHERE horizon > 1) AS sfm,
    count(*) FILTER (WHERE horizon > 1 AND v > 0) / 11e0 AS ssh, CAST(coalesce(min(horizon) FILTER (WHERE horizon > 1 AND v < 0.5e0 * abs(h1)), 13) AS INTEGER) AS first_decay,
    coalesce(max(horizon) FILTER (WHERE horizon > 1 AND v >= 0.5e0 * abs(h1)) > min(horizon) FILTER (WHERE horizon > 1 AND v < 0.5e0 * abs(h1)), false) AS recovers,
    CAST(coalesce(min(horizon) FILTER (WHERE horizon > 1 AND v < 0), 13) AS INTEGER) AS first_reversal,
    sum(greatest(v, 0e0)) FILTER (WHERE horizon BETWEEN 2 AND 3) / (2 * abs(h1)) AS apr_3, sum(greatest(v, 0e0)) FILTER (WHERE horizon BETWEEN 2 AND 6) / (5 * abs(h1)) AS apr_6,
    sum(greatest(v, 0e0)) FILTER (WHERE horizon BETWEEN 2 AND 12) / (11 * abs(h1)) AS apr_12
  FROM (SELECT feature, horizon, {value} * sign(first_value({value}) OVER w) AS v, first_value({value}) OVER w AS h1 FROM fmb WINDOW w AS (PARTITION BY feature ORDER BY horizon)) GROUP BY feature, h1"""


PATH = "feature h1:8 near_zero direction sdm:8 sfm:8 ssh:8 first_decay recovers first_reversal apr_3:6 apr_6:6 apr_12:6"


def _paths(spark, sf_dir) -> DataFrame:
    return horizon_stats(spark, sf_dir).groupBy("feature", "horizon").agg(
        F.avg("fmb_slope").alias("slope"), F.avg("rank_ic").alias("ric")
    )


@register("path_metrics", PATH, path_sql("slope"), HORIZON)
def path_metrics(spark, sf_dir):
    return signals.path_metrics(_paths(spark, sf_dir), ["feature"], "slope")


@register("path_metrics_rank_ic", PATH, path_sql("ric"), HORIZON)
def path_metrics_rank_ic(spark, sf_dir):
    return signals.path_metrics(_paths(spark, sf_dir), ["feature"], "ric")


@register(
    "path_pivot",
    "feature " + " ".join(f"h{h:02d}:8 adjusted_h{h:02d}:8" for h in range(1, 13)),
    "SELECT feature, "
    + ", ".join(
        f"max(CASE WHEN horizon = {h} THEN slope END) AS h{h:02d}, max(CASE WHEN horizon = {h} THEN slope END) * sign(max(CASE WHEN horizon = 1 THEN slope END)) AS adjusted_h{h:02d}"
        for h in range(1, 13)
    )
    + " FROM fmb GROUP BY 1",
    HORIZON,
)
def path_pivot(spark, sf_dir):
    return signals.path_pivot(_paths(spark, sf_dir), ["feature"], "slope")


CROSS = f"""{HORIZON},
ic AS ({ic_sql('long', 'feature, eom', 'rank_value', LABEL)}),
led AS (SELECT *, lead(rank_value) OVER w AS next_value, lead(month_index) OVER w AS next_index FROM long WINDOW w AS (PARTITION BY feature, entity ORDER BY month_index)),
pairs AS (SELECT feature, entity, eom, rank_value AS value, next_value FROM led WHERE next_index = month_index + 1),
paths AS ({path_sql('slope')}),
table_f AS (SELECT feature, rho, abs(mean_ic) AS strength, sfm, {THEME_SQL} AS theme FROM ({AR1}) JOIN (SELECT feature, avg(rank_ic) AS mean_ic FROM ic GROUP BY 1) USING (feature) JOIN paths USING (feature))"""


def feature_table(spark, sf_dir) -> DataFrame:
    """One row per feature: persistence, strength of its correlation, later path, theme."""
    def build():
        ar1 = signals.pooled_ar1(pairs(spark, sf_dir), ["feature"], "value", "next_value").select(
            "feature", F.col("ar1_rho").alias("rho")
        )
        strength = monthly_ic(spark, sf_dir).groupBy("feature").agg(F.abs(F.avg("rank_ic")).alias("strength"))
        paths = signals.path_metrics(_paths(spark, sf_dir), ["feature"], "slope").select("feature", "sfm")
        table = ar1.join(strength, "feature").join(paths, "feature")
        return X.map_labels(table, "feature", THEMES, "theme")

    return base.shared(spark, sf_dir, "feature_table", build)


def spearman_sql(source: str, by: str, x: str, y: str) -> str:
    """Pearson and Spearman across rows; ``by`` may be empty."""
    key = f"{by}, " if by else ""
    part = f"PARTITION BY {by} " if by else ""
    group = f"GROUP BY {by}" if by else ""
    return (
        f"SELECT {key}count(*) AS n, corr(x, y) AS pearson, corr(rx, ry) AS spearman FROM (SELECT {key}{x} AS x, {y} AS y, rank() OVER ({part}ORDER BY {x}) + 0e0 AS rx, rank() OVER ({part}ORDER BY {y}) + 0e0 AS ry FROM {source}) {group}"
    )


@register("cross_feature_corr", "n pearson:8 spearman:8", spearman_sql("table_f", "", "rho", "strength"), CROSS)
def cross_feature_corr(spark, sf_dir):
    return signals.rank_correlation(feature_table(spark, sf_dir), [], "rho", "strength", len(FEATURES))


@register(
    "leave_one_out",
    "omitted n pearson:8 spearman:8",
    spearman_sql("(SELECT o.feature AS omitted, t.* FROM table_f t JOIN table_f o ON t.feature <> o.feature)", "omitted", "rho", "strength"),
    CROSS,
)
def leave_one_out(spark, sf_dir):
    return signals.leave_one_out(feature_table(spark, sf_dir), "feature", "rho", "strength", len(FEATURES))


@register(
    "median_split",
    "side n mean_strength:8 median_strength:8 mean_sfm:8 median_sfm:8",
    "SELECT side, count(*) AS n, avg(strength) AS mean_strength, median(strength) AS median_strength, avg(sfm) AS mean_sfm, median(sfm) AS median_sfm FROM (SELECT *, CASE WHEN rho >= (SELECT median(rho) FROM table_f) THEN 'high' ELSE 'low' END AS side FROM table_f) GROUP BY 1",
    CROSS,
)
def median_split(spark, sf_dir):
    return signals.median_split(feature_table(spark, sf_dir), "rho", ["strength", "sfm"])


@register(
    "theme_summary",
    "theme n members mean_rho:8 median_rho:8 mean_strength:8 median_strength:8",
    "SELECT theme, count(*) AS n, string_agg(feature, ', ' ORDER BY feature) AS members, avg(rho) AS mean_rho, median(rho) AS median_rho, avg(strength) AS mean_strength, median(strength) AS median_strength FROM table_f GROUP BY 1",
    CROSS,
)
def theme_summary(spark, sf_dir):
    return signals.theme_summary(feature_table(spark, sf_dir), "theme", ["rho", "strength"])


@register(
    "evidence_gate",
    "outcome tests:bigint positive:bigint large:bigint verdict",
    f"SELECT outcome, count(*) AS tests, count(*) FILTER (WHERE spearman > 0) AS positive, count(*) FILTER (WHERE abs(spearman) >= 0.3) AS large, CASE WHEN count(*) FILTER (WHERE spearman >= 0.3) = count(*) THEN 'supported' WHEN count(*) FILTER (WHERE spearman > 0) = count(*) THEN 'weak' ELSE 'not_supported' END AS verdict FROM "
    f"(SELECT 'strength' AS outcome, spearman FROM ({spearman_sql('table_f', '', 'rho', 'strength')}) UNION ALL SELECT 'sfm', spearman FROM ({spearman_sql('table_f', '', 'rho', 'sfm')}) UNION ALL SELECT 'strength', spearman FROM ({spearman_sql('table_f', '', 'sfm', 'strength')})) GROUP BY 1",
    CROSS,
)
def evidence_gate(spark, sf_dir):
    table = feature_table(spark, sf_dir)
    tests = [("strength", "rho", "strength"), ("sfm", "rho", "sfm"), ("strength", "sfm", "strength")]
    rows = [
        signals.rank_correlation(table, [], x, y, len(FEATURES)).select(F.lit(o).alias("outcome"), "spearman") for o, x, y in tests
    ]
    return signals.evidence_gate(reduce(DataFrame.unionByName, rows))


@register(
    "persistence_regression",
    "n:bigint beta_1:6 beta_2:6 se_0:6 se_1:6 se_2:6 r2:6",
    """WITH z AS (SELECT (a - avg(a) OVER ()) / stddev_samp(a) OVER () AS a, (b - avg(b) OVER ()) / stddev_samp(b) OVER () AS b, (y - avg(y) OVER ()) / stddev_samp(y) OVER () AS y FROM
      (SELECT feature, eom, pearson_ic AS y, n_valid AS a, fmb_slope AS b FROM ic WHERE pearson_ic IS NOT NULL AND n_valid IS NOT NULL)),
    s AS (SELECT count(*) AS n, sum(a*a) AS aa, sum(b*b) AS bb, sum(a*b) AS ab, sum(a*y) AS ay, sum(b*y) AS byy FROM z),
    f AS (SELECT *, aa * bb - ab * ab AS det, (bb * ay - ab * byy) / (aa * bb - ab * ab) AS b1, (aa * byy - ab * ay) / (aa * bb - ab * ab) AS b2 FROM s),
    r AS (SELECT z.*, n, b1, b2, (bb * a - ab * b) / det AS ua, (aa * b - ab * a) / det AS ub, y - b1 * a - b2 * b AS e FROM z, f),
    q AS (SELECT *, pow(e / (1 - (1e0 / n + a * ua + b * ub)), 2) AS w FROM r)
    SELECT max(n) AS n, max(b1) AS beta_1, max(b2) AS beta_2, sqrt(sum(w) / max(n::DOUBLE * n)) AS se_0, sqrt(sum(w * ua * ua)) AS se_1, sqrt(sum(w * ub * ub)) AS se_2, 1 - sum(e * e) / sum(y * y) AS r2 FROM q""",
    IC,
)
def persistence_regression(spark, sf_dir):
    """Standardised two-regressor line with HC3 errors, over the monthly correlations."""
    rows = monthly_ic(spark, sf_dir).where("pearson_ic is not null").withColumn("size", F.col("n_valid").cast("double"))
    return inference.ols_hc3(rows, "pearson_ic", ("size", "fmb_slope"))


SCORE_CTES = f"""{LONG},
ic AS ({ic_sql('long', 'feature, eom', 'rank_value', LABEL, minimum=2)}),
stability AS ({STABILITY}),
coverage AS (SELECT feature, avg(CASE WHEN raw_value IS NULL THEN 1e0 ELSE 0e0 END) AS missing_rate FROM long GROUP BY 1),
dispersion AS (SELECT feature, median(sd) AS median_std FROM (SELECT feature, eom, stddev_samp(rank_value) AS sd FROM long GROUP BY 1, 2) GROUP BY 1),
auto AS (SELECT feature, avg(c) AS persistence FROM (SELECT feature, eom, {corr_sql('CASE WHEN prior IS NOT NULL THEN rank_value END', 'prior')} AS c FROM
  (SELECT *, CASE WHEN month_index - lag(month_index) OVER w = 1 THEN lag(rank_value) OVER w END AS prior FROM long WINDOW w AS (PARTITION BY feature, entity ORDER BY month_index)) GROUP BY 1, 2) GROUP BY 1),
correlations AS ({CORR_SQL}),
redundancy AS (SELECT replace(feature, 'rank_', '') AS feature, avg(abs(c)) AS average_abs, max(abs(c)) AS max_abs FROM (SELECT feature, other, avg(correlation) AS c FROM correlations GROUP BY 1, 2) GROUP BY 1),
features AS (SELECT *, {THEME_SQL} AS theme, CASE WHEN feature IN ('momentum') THEN 1 ELSE 0 END = 1 AS sensitive FROM coverage JOIN dispersion USING (feature) JOIN stability USING (feature) JOIN auto USING (feature) JOIN redundancy USING (feature)),
parts AS (SELECT *, 0.7e0 * least(greatest(1 - missing_rate / 0.2e0, 0), 1) + 0.3e0 * least(greatest(median_std / 0.2e0, 0), 1) AS quality, least(greatest(abs(mean_ic) / 0.03e0, 0), 1) AS ic_score,
  0.6e0 * same_sign_year_share + 0.4e0 * least(greatest(1 - top3_year_share / 0.6e0, 0), 1) AS stability, least(greatest((persistence - 0.2e0) / 0.75e0, 0), 1) AS persistence_score, 0.6e0 * average_abs + 0.4e0 * max_abs AS redundancy,
  CASE theme WHEN 'Quality' THEN 1e0 WHEN 'Momentum' THEN 0.5e0 ELSE 0e0 END AS bonus, CASE WHEN sensitive THEN greatest(0.7e0 - persistence, 0) / 0.7e0 ELSE 0e0 END AS trading_penalty,
  missing_rate > 0.2 OR median_std < 0.02 OR persistence < 0.2 OR max_abs > 0.9 OR (sensitive AND persistence < 0.7) AS failed FROM features),
scores AS (SELECT *, 0.25e0 * quality + 0.25e0 * ic_score + 0.15e0 * stability + 0.2e0 * persistence_score + 0.1e0 * (1 - redundancy) + 0.05e0 * bonus - 0.05e0 * trading_penalty AS balanced_score,
  0.35e0 * quality + 0.05e0 * ic_score + 0.1e0 * stability + 0.3e0 * persistence_score + 0.2e0 * (1 - redundancy) - 0.05e0 * trading_penalty AS conservative_score, NOT failed AS balanced_eligible,
  NOT failed AND missing_rate <= 0.1 AND median_std >= 0.05 AND persistence >= 0.6 AND max_abs <= 0.85 AND average_abs <= 0.35 AS conservative_eligible FROM parts)"""

BONUS = {"Quality": 1.0, "Momentum": 0.5}


def feature_diagnostics(spark, sf_dir) -> DataFrame:
    """One row per feature from the coverage, dispersion, correlation and persistence tables."""
    def build():
        rows = long(spark, sf_dir)
        ic = signals.feature_ic(
            base.panel(spark, sf_dir), FILLED, LABEL, minimum=2, group_rows=base.bound(spark, sf_dir),
            rows=base.rows(spark, sf_dir),
        )
        wide = windows.lag_month(base.panel(spark, sf_dir), RANK_COLUMNS)
        items = F.array(
            *[
                F.struct(F.lit(f).alias("feature"), F.col(f"rank_{f}").alias("value"), F.col(f"lag_rank_{f}").alias("previous"))
                for f in FEATURES
            ]
        )
        auto = signals.rank_autocorrelation(wide.select("eom", F.inline(items)), ["feature"], "value", "previous")
        related = signals.correlation_summary(
            signals.monthly_correlations(base.panel(spark, sf_dir), RANK_COLUMNS, RANK_COLUMNS)
        ).withColumn("feature", F.regexp_replace("feature", "^rank_", ""))
        tables = [
            performance.feature_coverage(rows, ["feature"]).drop("rows"),
            performance.dispersion(rows, ["feature"], "rank_value"),
            signals.ic_stability(ic, ["feature"]),
            auto.groupBy("feature").agg(F.avg("autocorrelation").alias("persistence")),
            related,
        ]
        joined = reduce(lambda a, b: a.join(F.broadcast(b), "feature"), tables)
        return X.map_labels(joined, "feature", THEMES, "theme")

    return base.shared(spark, sf_dir, "feature_diagnostics", build)


@register(
    "feature_diagnostics",
    "feature theme missing_rate:8 median_std:8 mean_ic:8 persistence:8 average_abs:8 max_abs:8",
    "SELECT * FROM features",
    SCORE_CTES,
)
def feature_diagnostics_plan(spark, sf_dir):
    return feature_diagnostics(spark, sf_dir)


@register(
    "score_features",
    "feature quality:8 ic_score:8 stability:8 persistence_score:8 redundancy:8 balanced_score:8 conservative_score:8 balanced_eligible conservative_eligible",
    "SELECT * FROM scores",
    SCORE_CTES,
)
def score_features(spark, sf_dir):
    return signals.score_features(feature_diagnostics(spark, sf_dir), BONUS, ["momentum"])


PICKS = ("Quality", "Pricing", "Volume", "Momentum")


@register(
    "select_diversified",
    "pick feature theme balanced_score:8",
    "SELECT CAST(row_number() OVER (ORDER BY CASE WHEN rn = 1 THEN CASE theme WHEN 'Quality' THEN 1 WHEN 'Pricing' THEN 2 WHEN 'Volume' THEN 3 WHEN 'Momentum' THEN 4 ELSE 5 END ELSE 5 END, balanced_score DESC, feature) AS INTEGER) AS pick, feature, theme, balanced_score FROM "
    "(SELECT *, row_number() OVER (PARTITION BY theme ORDER BY balanced_score DESC, feature) AS rn FROM scores WHERE true) WHERE rn <= 2 ORDER BY pick LIMIT 4",
    SCORE_CTES,
)
def select_diversified(spark, sf_dir):
    """The four best features with at most two per theme; every feature counts as eligible here."""
    scores = signals.score_features(feature_diagnostics(spark, sf_dir), BONUS, ["momentum"])
    scores = scores.withColumn("all", F.lit(True))
    return signals.select_diversified(scores, "balanced_score", "all", PICKS, wanted=4)


@register(
    "min_rank_features",
    "feature place:bigint",
    "SELECT feature, rank() OVER (ORDER BY round(abs(avg(rank_ic)), 10) DESC) AS place FROM ic GROUP BY feature",
    IC,
)
def min_rank_features(spark, sf_dir):
    """Features by absolute mean rank correlation, ties sharing the smallest rank."""
    means = monthly_ic(spark, sf_dir).groupBy("feature").agg(F.round(F.abs(F.avg("rank_ic")), 10).alias("size"))
    return ranks.minimum_rank_descending(means, [], "size", "place")


@register(
    "t_stat",
    "feature n mean:8 t_stat:6",
    "SELECT feature, count(rank_ic) AS n, avg(rank_ic) AS mean, CASE WHEN stddev_samp(rank_ic) > 0 THEN avg(rank_ic) / (stddev_samp(rank_ic) / sqrt(count(rank_ic))) END AS t_stat FROM ic GROUP BY 1",
    IC,
)
def t_stat(spark, sf_dir):
    return inference.t_stat(monthly_ic(spark, sf_dir), "rank_ic", ["feature"])
