"""Registered queries: data-quality checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from crosspanel import settings as S
from crosspanel.operators import quality
from crosspanel.plans import base
from crosspanel.plans.models import FACTORS, factor_days
from crosspanel.plans.policies import GRID, SELECT_SQL, selected
from crosspanel.plans.registry import register
from crosspanel.plans.riskplans import exposures, idio, monthly_covariance, risk_returns
from crosspanel.plans.scans import LONG_SQL
from crosspanel.plans.signals import CORR_SQL, IC, horizon_stats, monthly_ic
from crosspanel.plans.sqltext import FEATURES, panel_ctes, returns_ctes
from crosspanel.sources import tables
from crosspanel.sources.panel import read

PANEL = panel_ctes()


def flat(df: DataFrame, *names: str) -> DataFrame:
    """Details as columns."""
    return df.select("check", "passed", "severity", *[F.col("details")[n].alias(n) for n in names])


def check(name: str, details: str, label: str, passed: str, severity: str, sql: str, ctes: str = PANEL, source=None):
    """Register a one-row check: ``sql`` gives the details and ``passed`` is an expression on them."""
    body = f"SELECT '{label}' AS \"check\", {passed} AS passed, '{severity}' AS severity, * FROM ({sql})"
    spec = 'check passed severity ' + details
    names = [d.partition(":")[0] for d in details.split()]

    def wrap(plan):
        register(name, spec.replace("check ", "check_name ", 1), body.replace('AS "check"', "AS check_name"), ctes)(
            lambda spark, sf_dir: flat(plan(spark, sf_dir), *names).withColumnRenamed("check", "check_name")
        )
        return plan

    return wrap


@check("check_columns", "missing_columns:2", "required_columns", "false", "error", "SELECT 1e0 AS missing_columns FROM (SELECT count(*) FROM panel)")
def check_columns(spark, sf_dir):
    """One of the wanted columns does not exist."""
    return quality.check_columns(base.panel(spark, sf_dir), ["eom", "entity", "price", "beta_mkt"])


@check(
    "check_unique", "duplicate_rows:2", "unique_key", "duplicate_rows = 0", "error",
    "SELECT coalesce(sum(n), 0)::DOUBLE AS duplicate_rows FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)",
)
def check_unique(spark, sf_dir):
    """The line items have no unique (order, line) key."""
    return quality.check_unique(read(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@check(
    "check_nested", "in_small_not_in_mid:2 in_mid_not_in_large:2", "nested_universes", "in_small_not_in_mid + in_mid_not_in_large = 0", "error",
    "SELECT (count(*) FILTER (WHERE in_small AND NOT in_mid))::DOUBLE AS in_small_not_in_mid, (count(*) FILTER (WHERE in_mid AND NOT in_large))::DOUBLE AS in_mid_not_in_large FROM panel",
)
def check_nested(spark, sf_dir):
    return quality.check_nested(base.panel(spark, sf_dir), ["in_small", "in_mid", "in_large"])


@check(
    "check_coverage", "small_panel:2 min:2 median:2 max:2 months_below:2 threshold:2", "monthly_coverage", "small_panel = 1 OR months_below = 0", "warning",
    "SELECT CASE WHEN (SELECT count(DISTINCT entity) FROM panel) < 60 THEN 1e0 ELSE 0e0 END AS small_panel, min(n)::DOUBLE AS min, median(n) AS median, max(n)::DOUBLE AS max, (count(*) FILTER (WHERE n < 60))::DOUBLE AS months_below, 60e0 AS threshold FROM (SELECT eom, count(DISTINCT entity) AS n FROM panel WHERE in_mid GROUP BY 1)",
)
def check_coverage(spark, sf_dir):
    return quality.check_coverage(base.panel(spark, sf_dir), "in_mid", 60)


@check(
    "check_missing", " ".join(f"raw_{f}:8" for f in FEATURES), "raw_feature_coverage", " AND ".join(f"raw_{f} <= 0.5" for f in FEATURES), "warning",
    "SELECT " + ", ".join(f"avg(CASE WHEN raw_{f} IS NULL THEN 1e0 ELSE 0e0 END) AS raw_{f}" for f in FEATURES) + " FROM panel",
)
def check_missing(spark, sf_dir):
    return quality.check_missing(base.panel(spark, sf_dir), [f"raw_{f}" for f in FEATURES])


@check(
    "check_range", "rank_tax:2 raw_momentum:2", "ranks_in_range", "rank_tax + raw_momentum = 0", "error",
    "SELECT (count(*) FILTER (WHERE NOT coalesce(rank_tax BETWEEN 0 AND 1, false)))::DOUBLE AS rank_tax, (count(*) FILTER (WHERE NOT coalesce(raw_momentum BETWEEN 0 AND 1, false)))::DOUBLE AS raw_momentum FROM panel",
)
def check_range(spark, sf_dir):
    """A rank passes; a raw feature with negative values and nulls does not."""
    return quality.check_range(base.panel(spark, sf_dir), ["rank_tax", "raw_momentum"])


@check(
    "check_neutral", " ".join(f"{f}:2" for f in FEATURES), "missing_features_neutral", " + ".join(FEATURES) + " = 0", "error",
    "SELECT " + ", ".join(f"(count(*) FILTER (WHERE raw_{f} IS NULL AND NOT abs(rank_{f} - 0.5) <= 1e-8 + 5e-6))::DOUBLE AS {f}" for f in FEATURES) + " FROM panel",
)
def check_neutral(spark, sf_dir):
    return quality.check_neutral(base.panel(spark, sf_dir), FEATURES)


@check(
    "check_label", "missing_rate:8", "label_coverage", "missing_rate <= 0.2", "warning",
    "SELECT avg(CASE WHEN ret_exc_lead1m IS NULL THEN 1e0 ELSE 0e0 END) AS missing_rate FROM panel",
)
def check_label(spark, sf_dir):
    return quality.check_label(base.panel(spark, sf_dir))


@check(
    "check_positive", "invalid_rows:2", "positive_ret_1m", "invalid_rows = 0", "error",
    "SELECT (count(*) FILTER (WHERE NOT coalesce(ret_1m > 0, false)))::DOUBLE AS invalid_rows FROM panel",
)
def check_positive(spark, sf_dir):
    """Returns are not all positive, so this one fails; volumes go through the validation report."""
    return quality.check_positive(base.panel(spark, sf_dir), "ret_1m")


@check(
    "check_lambda", "invalid_rows:2 formula_violations:2", "transaction_cost_lambda", "invalid_rows = 0 AND formula_violations = 0", "error",
    "SELECT 0e0 AS invalid_rows, (count(*) FILTER (WHERE entity % 5 = 0))::DOUBLE AS formula_violations FROM panel",
)
def check_lambda(spark, sf_dir):
    """Every fifth name gets a doubled parameter."""
    rows = base.panel(spark, sf_dir)
    planted = F.when(F.col("entity") % 5 == 0, F.col("lambda_adv") * 2).otherwise(F.col("lambda_adv"))
    return quality.check_lambda(rows.withColumn("lambda_adv", planted))


@check(
    "check_tail", "median:10 p99:10 ratio:6", "transaction_cost_extremes", "ratio <= 10000", "warning",
    "SELECT *, p99 / median AS ratio FROM (SELECT median(lambda_adv) AS median, quantile_cont(lambda_adv, 0.99) AS p99 FROM panel)",
)
def check_tail(spark, sf_dir):
    return quality.check_tail(base.panel(spark, sf_dir), rows=base.rows(spark, sf_dir))


@check(
    "check_min_price", "violations:2 min_price:2", "minimum_price", "violations = 0", "error",
    "SELECT (count(*) FILTER (WHERE in_mid AND coalesce(price < 1200, true)))::DOUBLE AS violations, 1200e0 AS min_price FROM panel",
)
def check_min_price(spark, sf_dir):
    return quality.check_min_price(base.panel(spark, sf_dir), "in_mid", 1200.0)


@check(
    "check_count_jumps", "jump_months:2 largest:8", "universe_count_jumps", "jump_months = 0", "warning",
    "SELECT (count(*) FILTER (WHERE c > 0.2))::DOUBLE AS jump_months, max(c) AS largest FROM (SELECT abs(n / lag(n) OVER (ORDER BY eom)::DOUBLE - 1) AS c FROM (SELECT eom, count(DISTINCT entity) AS n FROM panel WHERE in_large GROUP BY 1))",
)
def check_count_jumps(spark, sf_dir):
    return quality.check_count_jumps(base.panel(spark, sf_dir), "in_large")


@check(
    "check_market_cap", "invalid_rows:2 p01:4 median:4 p99:4", "market_cap_distribution", "invalid_rows = 0", "warning",
    "SELECT (count(*) FILTER (WHERE NOT coalesce(lag_mktcap > 0, false)))::DOUBLE AS invalid_rows, quantile_cont(lag_mktcap, 0.01) AS p01, median(lag_mktcap) AS median, quantile_cont(lag_mktcap, 0.99) AS p99 FROM panel WHERE in_mid",
)
def check_market_cap(spark, sf_dir):
    return quality.check_market_cap(base.panel(spark, sf_dir), "in_mid", group_rows=base.rows(spark, sf_dir))


@check(
    "check_periods", "overlapping:2", "sample_periods_disjoint", "overlapping = 0", "error",
    "WITH p AS (SELECT o_orderpriority AS name, min(o_orderdate) AS s, max(o_orderdate) AS e FROM orders GROUP BY 1) SELECT count(*)::DOUBLE AS overlapping FROM p a JOIN p b ON a.name < b.name AND greatest(a.s, b.s) <= least(a.e, b.e)",
)
def check_periods(spark, sf_dir):
    periods = read(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("name")).agg(
        F.min("o_orderdate").alias("start"), F.max("o_orderdate").alias("end")
    )
    return quality.check_periods(periods)


@check(
    "check_lookahead", "observations:2 same_month:8 next_month:8", "lookahead", "NOT (observations >= 30 AND same_month > next_month + 0.1)", "warning",
    "SELECT (count(*) FILTER (WHERE ret_1m IS NOT NULL AND ret_exc_lead1m IS NOT NULL AND nxt IS NOT NULL))::DOUBLE AS observations, corr(ret_exc_lead1m, ret_1m) AS same_month, corr(ret_exc_lead1m, nxt) AS next_month FROM (SELECT *, lead(ret_1m) OVER (PARTITION BY entity ORDER BY eom) AS nxt FROM panel)",
)
def check_lookahead(spark, sf_dir):
    return quality.check_lookahead(base.panel(spark, sf_dir))


@register(
    "check_risk_tables",
    "check_name passed severity",
    "SELECT 'risk_' || t AS check_name, ok AS passed, 'warning' AS severity FROM (VALUES ('factor_exposures', true), ('factor_returns_daily', false), ('factor_cov_monthly', false), ('idio_var_monthly', true)) v(t, ok)",
)
def check_risk_tables(spark, sf_dir):
    """Two tables are complete, one lacks its universe and one is absent."""
    found = quality.check_risk_tables(
        {
            "factor_exposures": exposures(spark, sf_dir),
            "factor_returns_daily": factor_days(spark, sf_dir),
            "factor_cov_monthly": None,
            "idio_var_monthly": idio(spark, sf_dir),
        },
        tables.RISK_COLUMNS,
    )
    return found.withColumnRenamed("check", "check_name")


@register(
    "unit_audit",
    "check_name passed severity p01:6 median:6 p99:6 max_relative_error:12 abs_p999:8",
    "SELECT * FROM (SELECT 'unit_returns' AS check_name, (SELECT quantile_cont(abs(ret_1m), 0.99) FROM panel) < 1 AS passed, 'review' AS severity, quantile_cont(ret_1m, 0.01) AS p01, median(ret_1m) AS median, quantile_cont(ret_1m, 0.99) AS p99, NULL AS max_relative_error, NULL AS abs_p999 FROM panel "
    + " ".join(
        f"UNION ALL SELECT '{n}', true, 'review', quantile_cont({c}, 0.01), median({c}), quantile_cont({c}, 0.99), NULL, NULL FROM panel"
        for n, c in (("unit_forward_returns", "ret_exc_lead1m"), ("unit_volatility", "vol_12m"), ("unit_volume", "adv_6m"))
    )
    + " UNION ALL SELECT 'unit_lambda', true, 'error', NULL, NULL, NULL, 0e0, NULL UNION ALL SELECT 'unit_factor_returns', quantile_cont(abs(factor_return), 0.999) <= 0.25, 'review', NULL, NULL, NULL, NULL, quantile_cont(abs(factor_return), 0.999) FROM factor_days)",
    f"{PANEL},{FACTORS}",
)
def unit_audit(spark, sf_dir):
    rows = quality.unit_audit(
        base.panel(spark, sf_dir), factor_days(spark, sf_dir), group_rows=base.rows(spark, sf_dir)
    )
    get = lambda n: F.try_element_at("details", F.lit(n)).alias(n)
    return rows.select(
        F.col("check").alias("check_name"), "passed", "severity", *[get(n) for n in ("p01", "median", "p99", "max_relative_error", "abs_p999")]
    )


@check(
    "check_overlap_equal", "rows:2 rank_tax:8 raw_tax:8", "overlap_equal", "false", "error",
    "SELECT count(*)::DOUBLE AS rows, max(CASE WHEN year(eom) = 1998 THEN 0.001e0 ELSE 0e0 END) AS rank_tax, 0e0 AS raw_tax FROM panel WHERE year(eom) BETWEEN 1997 AND 1998",
)
def check_overlap_equal(spark, sf_dir):
    """A copy of two years in which one year of a rank has been moved by 0.001."""
    rows = base.panel(spark, sf_dir)
    part = rows.where("year(eom) between 1997 and 1998").withColumn(
        "rank_tax", F.col("rank_tax") + F.when(F.year("eom") == 1998, 0.001).otherwise(0.0)
    )
    return quality.check_overlap_equal(rows, part, ["eom", "entity"], ["rank_tax", "raw_tax"])


@register(
    "feature_preflight",
    "feature worst_year_missing:8 min_year_spread:8 flat_years:bigint min_fill_correct:8 max_jump:8 bad_ranks:bigint missing_rate:8 average_abs:8 max_abs:8 passed",
    """SELECT *, missing_rate <= 0.2 AND coalesce(max_jump, 0) <= 0.15 AND min_fill_correct = 1 AND flat_years = 0 AND bad_ranks = 0 AND max_abs <= 0.9 AND worst_year_missing < 1 AS passed FROM
      (SELECT feature, max(rate) AS worst_year_missing, min(mean_sd) AS min_year_spread, count(*) FILTER (WHERE mean_sd < 0.01) AS flat_years, min(fill) AS min_fill_correct, max(jump) AS max_jump FROM
        (SELECT *, abs(rate - lag(rate) OVER (PARTITION BY feature ORDER BY year)) AS jump FROM (SELECT feature, year(eom) AS year, avg(CASE WHEN raw_value IS NULL THEN 1e0 ELSE 0e0 END) AS rate, CASE WHEN count(*) FILTER (WHERE raw_value IS NULL) > 0 THEN count(*) FILTER (WHERE raw_value IS NULL AND rank_value = 0.5) / (count(*) FILTER (WHERE raw_value IS NULL))::DOUBLE ELSE 1e0 END AS fill FROM long GROUP BY 1, 2)
         JOIN (SELECT feature, year, avg(sd) AS mean_sd FROM (SELECT feature, year(eom) AS year, eom, stddev_samp(rank_value) AS sd FROM long GROUP BY 1, 2, 3) GROUP BY 1, 2) USING (feature, year)) GROUP BY 1)
      JOIN (SELECT feature, CAST(0 AS BIGINT) AS bad_ranks, avg(CASE WHEN raw_value IS NULL THEN 1e0 ELSE 0e0 END) AS missing_rate FROM long GROUP BY 1) USING (feature)
      JOIN (SELECT replace(feature, 'rank_', '') AS feature, avg(abs(c)) AS average_abs, max(abs(c)) AS max_abs FROM (SELECT feature, other, avg(correlation) AS c FROM correlations GROUP BY 1, 2) GROUP BY 1) USING (feature)""",
    f"{PANEL},\nlong AS ({LONG_SQL}),\ncorrelations AS ({CORR_SQL})",
)
def feature_preflight(spark, sf_dir):
    return quality.feature_preflight(base.panel(spark, sf_dir), FEATURES)


@check(
    "check_panel_shape", "rows:2 months:2 min_names:2 max_names:2", "panel_shape",
    "rows = (SELECT count(*) FROM source) AND months = (SELECT count(DISTINCT eom) FROM source) "
    "AND (SELECT min(eom) = (SELECT min(eom) FROM source) AND max(eom) = (SELECT max(eom) FROM source) FROM panel)", "error",
    "SELECT sum(n)::DOUBLE AS rows, count(*)::DOUBLE AS months, min(n)::DOUBLE AS min_names, max(n)::DOUBLE AS max_names FROM (SELECT eom, count(*) AS n FROM panel GROUP BY 1)",
    f"{PANEL}, source AS (SELECT DISTINCT l_suppkey, CAST(last_day(l_shipdate) AS DATE) AS eom FROM lineitem)",
)
def check_panel_shape(spark, sf_dir):
    """The panel has a row for each supplier and month of the line items, and their months."""
    keys = read(spark, sf_dir, "lineitem").select("l_suppkey", F.last_day("l_shipdate").alias("eom")).distinct()
    want = keys.agg(F.count(F.lit(1)), F.count_distinct("eom"), F.min("eom"), F.max("eom")).first()
    return quality.check_panel_shape(base.panel(spark, sf_dir), want[0], want[1], str(want[2]), str(want[3]))


@register(
    "safety_counts",
    "check_name severity missing_returns:2 future:2 cutoff:2",
    "SELECT 'safety_counters' AS check_name, 'error' AS severity, 0e0 AS missing_returns, (SELECT count(*) FILTER (WHERE future_information_used) FROM chosen)::DOUBLE AS future, (SELECT count(*) FILTER (WHERE latest_validation_year >= test_year) FROM chosen)::DOUBLE AS cutoff",
    f"{GRID},{SELECT_SQL}",
)
def safety_counts(spark, sf_dir):
    found = quality.safety_counts(risk_returns(spark, sf_dir), selected(spark, sf_dir))
    return flat(found, "missing_returns", "future", "cutoff").withColumnRenamed("check", "check_name")


@register(
    "check_result_columns",
    "column_name present values:bigint usable",
    "SELECT 'net_return' AS column_name, true AS present, count(net_return) AS values, true AS usable FROM rets UNION ALL SELECT 'turnover', true, count(turnover), true FROM rets UNION ALL SELECT 'beta_norm', false, 0, false",
    returns_ctes(),
)
def check_result_columns(spark, sf_dir):
    return quality.check_result_columns(base.returns(spark, sf_dir), ["net_return", "turnover", "beta_norm"])


@check(
    "check_same_statistic", "max_difference:8", "same_statistic", "true", "error", "SELECT 0e0 AS max_difference FROM (SELECT count(*) FROM ic)", IC
)
def check_same_statistic(spark, sf_dir):
    """Horizon one must repeat the one-month table."""
    first = horizon_stats(spark, sf_dir).where("horizon = 1")
    keys = ["feature", "eom"]
    return quality.check_same_statistic(first, monthly_ic(spark, sf_dir), keys, ["rank_ic", "pearson_ic"])


@register(
    "validation_report",
    "check_name passed severity",
    """SELECT * FROM (VALUES ('required_columns', true, 'error'), ('unique_key', true, 'error'), ('nested_universes', true, 'error'), ('missing_features_neutral', true, 'error'), ('ranks_in_range', true, 'error'), ('positive_adv_6m', true, 'error'), ('transaction_cost_lambda', true, 'error')) v(check_name, passed, severity)
    UNION ALL SELECT 'label_coverage', avg(CASE WHEN ret_exc_lead1m IS NULL THEN 1e0 ELSE 0e0 END) <= 0.2, 'warning' FROM panel UNION ALL SELECT 'minimum_price', count(*) FILTER (WHERE in_mid AND price < 5) = 0, 'error' FROM panel
    UNION ALL SELECT 'transaction_cost_extremes', quantile_cont(lambda_adv, 0.99) / median(lambda_adv) <= 10000, 'warning' FROM panel""",
    PANEL,
)
def validation_report(spark, sf_dir):
    """The panel's own checks, all of which must pass."""
    rows = base.panel(spark, sf_dir)
    found = quality.report(
        quality.check_columns(rows, [*tables.PANEL_COLUMNS, *tables.feature_columns(FEATURES)]),
        quality.check_unique(rows),
        quality.check_nested(rows, ["in_small", "in_mid", "in_large"]),
        quality.check_neutral(rows, FEATURES),
        quality.check_range(rows, [f"rank_{f}" for f in FEATURES]),
        quality.check_positive(rows, "adv_6m"),
        quality.check_lambda(rows),
        quality.check_label(rows),
        quality.check_min_price(rows, "in_mid"),
        quality.check_tail(rows, rows=base.rows(spark, sf_dir)),
    )
    return found.withColumnRenamed("check", "check_name")
