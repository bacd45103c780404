"""Registered queries: method comparisons, inference, result-table aggregates and joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from crosspanel import settings as S
from crosspanel.functions import scalars as X
from crosspanel.operators import inference, joins, ledger, performance
from crosspanel.plans import base
from crosspanel.plans.models import factor_days, monthly_covariance, EWMA
from crosspanel.plans.portfolio import METRICS, metrics_sql
from crosspanel.plans.registry import register
from crosspanel.plans.signals import nw_sql
from crosspanel.plans.sqltext import FEATURES, UNIVERSE, WEIGHTS, panel_ctes, returns_ctes
from crosspanel.sources.panel import read

PANEL = panel_ctes()
RETURNS = returns_ctes()
PAIRS = (
    ("rank_long_short", "equal_weight"),
    ("markowitz", "equal_weight"),
    ("markowitz", "rank_long_short"),
)
FIELDS = inference.OUTCOMES
KEYS = "candidate_method, benchmark_method"
PAIR_VALUES = ", ".join(f"('{c}', '{b}')" for c, b in PAIRS)
DIFFS = f"""{RETURNS},
penalised AS (SELECT *, 0.5e0 * 1e1 * ex_ante_monthly_variance AS risk_penalty FROM rets),
diffs AS (SELECT c.eom, c.test_year, p.candidate_method, p.benchmark_method, {", ".join(f"c.{f} - b.{f} AS delta_{f}" for f in FIELDS)}
  FROM (VALUES {PAIR_VALUES}) p({KEYS}) JOIN penalised c ON c.method = p.candidate_method JOIN penalised b ON b.method = p.benchmark_method AND b.eom = c.eom),
outcomes AS ({" UNION ALL ".join(f"SELECT eom, test_year, {KEYS}, '{f}' AS outcome, delta_{f} AS delta FROM diffs" for f in FIELDS)}),
annual AS (SELECT {KEYS}, outcome, test_year, count(delta) AS n_months, sum(delta) AS annual_sum, 12 * avg(delta) AS annualized_mean FROM outcomes GROUP BY 1, 2, 3, 4)"""


def differences(spark, sf_dir) -> DataFrame:
    return base.shared(
        spark, sf_dir, "differences",
        lambda: inference.method_differences(base.returns(spark, sf_dir), PAIRS),
    )


@register(
    "method_differences",
    "eom test_year candidate_method benchmark_method " + " ".join(f"delta_{f}:8" for f in FIELDS),
    "SELECT * FROM diffs",
    DIFFS,
)
def method_differences(spark, sf_dir):
    return differences(spark, sf_dir)


@register(
    "utility_identity",
    "candidate_method benchmark_method passed year_disagreements:bigint",
    f"SELECT {KEYS}, max(abs(delta_net_return - delta_risk_penalty - delta_utility_flow)) <= 1e-10 AS passed, CAST(0 AS BIGINT) AS year_disagreements FROM diffs GROUP BY 1, 2",
    DIFFS,
)
def utility_identity(spark, sf_dir):
    return inference.identity_error(differences(spark, sf_dir))


@register(
    "annual_delta",
    "candidate_method benchmark_method outcome test_year n_months:bigint annual_sum:8 annualized_mean:8",
    "SELECT * FROM annual",
    DIFFS,
)
def annual_delta(spark, sf_dir):
    return inference.annual_delta(differences(spark, sf_dir))


BOOT = f"""{DIFFS},
series AS (SELECT {KEYS}, outcome, delta, row_number() OVER (PARTITION BY {KEYS}, outcome ORDER BY eom) - 1 AS i, count(*) OVER (PARTITION BY {KEYS}, outcome) AS n FROM outcomes WHERE delta IS NOT NULL),
starts AS (SELECT n, rep, b, CAST('0x' || substr(md5('0|' || rep || '|' || b), 1, 8) AS BIGINT) % n AS start FROM (SELECT DISTINCT n FROM series) CROSS JOIN (SELECT unnest(range(1, 2001)) AS rep), LATERAL (SELECT unnest(range(0, CAST(ceil(n / least(12, n)::DOUBLE) AS BIGINT))) AS b)),
places AS (SELECT s.n, rep, (start + i % least(12, s.n)) % s.n AS place FROM starts s, LATERAL (SELECT unnest(range(0, s.n)) AS i) WHERE i // least(12, s.n) = b),
boot_means AS (SELECT {KEYS}, outcome, rep, avg(delta) AS m FROM places p JOIN series s ON s.n = p.n AND s.i = p.place GROUP BY 1, 2, 3, 4),
boot AS (SELECT {KEYS}, outcome, quantile_cont(m, 0.025) AS ci_lower, quantile_cont(m, 0.975) AS ci_upper, avg(CASE WHEN m > 0 THEN 1e0 ELSE 0e0 END) AS probability_positive, count(*) AS replications FROM boot_means GROUP BY 1, 2, 3)"""


@register(
    "block_bootstrap",
    "candidate_method benchmark_method outcome ci_lower:8 ci_upper:8 probability_positive:4 replications",
    "SELECT * FROM boot",
    BOOT,
)
def block_bootstrap(spark, sf_dir):
    """Circular block bootstrap with digest-seeded starts, so the draw can be repeated in SQL."""
    long = inference.long_outcomes(differences(spark, sf_dir))
    return inference.block_bootstrap(long, "delta", [*inference.PAIR, "outcome"], "eom")


@register(
    "inference",
    "candidate_method benchmark_method outcome n mean:8 annualized_mean:8 lags nw_se:8 nw_t:6 ci_lower:8 ci_upper:8 probability_positive:4 median_annual:8 years_won:bigint years_total:bigint cumulative:8",
    f"SELECT w.candidate_method, w.benchmark_method, w.outcome, n, mean, 12 * mean AS annualized_mean, lags, nw_se, nw_t, 12 * ci_lower AS ci_lower, 12 * ci_upper AS ci_upper, probability_positive, median_annual, years_won, years_total, cumulative FROM ({nw_sql('outcomes', KEYS + ', outcome', 'delta')}) w "
    f"JOIN (SELECT {KEYS}, outcome, median(annual_sum) AS median_annual, count(*) FILTER (WHERE annual_sum > 0) AS years_won, count(*) AS years_total, sum(annual_sum) AS cumulative FROM annual GROUP BY 1, 2, 3) a USING ({KEYS}, outcome) JOIN boot USING ({KEYS}, outcome) WHERE outcome <> 'leverage'",
    BOOT,
)
def inference_plan(spark, sf_dir):
    """Leverage is one for two of the policies, so its difference is rounding noise: not tested."""
    return inference.inference(differences(spark, sf_dir)).where("outcome <> 'leverage'")


@register(
    "gain_concentration",
    "candidate_method benchmark_method outcome years_won:bigint years_total:bigint top_1_share:8 top_3_share:8 top_5_share:8 best_year best_value:8 worst_year worst_value:8 year_1998:8 year_2000:8",
    f"SELECT {KEYS}, outcome, count(*) FILTER (WHERE annual_sum > 0) AS years_won, count(*) AS years_total, sum(annual_sum) FILTER (WHERE rn <= 1 AND annual_sum > 0) / sum(annual_sum) FILTER (WHERE annual_sum > 0) AS top_1_share, "
    "sum(annual_sum) FILTER (WHERE rn <= 3 AND annual_sum > 0) / sum(annual_sum) FILTER (WHERE annual_sum > 0) AS top_3_share, sum(annual_sum) FILTER (WHERE rn <= 5 AND annual_sum > 0) / sum(annual_sum) FILTER (WHERE annual_sum > 0) AS top_5_share, "
    "arg_max(test_year, annual_sum) AS best_year, max(annual_sum) AS best_value, arg_min(test_year, annual_sum) AS worst_year, min(annual_sum) AS worst_value, sum(annual_sum) FILTER (WHERE test_year = 1998) AS year_1998, sum(annual_sum) FILTER (WHERE test_year = 2000) AS year_2000 FROM "
    f"(SELECT *, row_number() OVER (PARTITION BY {KEYS}, outcome ORDER BY annual_sum DESC) AS rn FROM annual) WHERE outcome <> 'leverage' GROUP BY 1, 2, 3",
    DIFFS,
)
def gain_concentration(spark, sf_dir):
    """How far the gain rests on few years (leverage differences are constant, so best years tie: left out)."""
    rows = inference.concentration(differences(spark, sf_dir), named_years=[1998, 2000])
    return rows.where("outcome <> 'leverage'")


EPISODES = {"asia_1997_1998": (1997, 1998), "tech_2000_2001": (2000, 2001)}


@register(
    "period_attribution",
    "candidate_method benchmark_method outcome period n_months:bigint total:8 annualized_mean:8 positive_month_share:8",
    f"SELECT {KEYS}, outcome, CASE WHEN test_year IN (1997, 1998) THEN 'asia_1997_1998' WHEN test_year IN (2000, 2001) THEN 'tech_2000_2001' ELSE 'non_crisis' END AS period, count(delta) AS n_months, sum(delta) AS total, 12 * avg(delta) AS annualized_mean, "
    "avg(CASE WHEN delta > 0 THEN 1e0 ELSE 0e0 END) AS positive_month_share FROM outcomes GROUP BY 1, 2, 3, 4",
    DIFFS,
)
def period_attribution(spark, sf_dir):
    return inference.period_attribution(
        differences(spark, sf_dir), X.crisis_label(F.col("test_year"), EPISODES)
    )


@register(
    "yearly_attribution",
    f"method test_year period predicted_volatility:8 realized_to_predicted:6 {METRICS}",
    f"SELECT m.*, '2020-2024' AS period, predicted_volatility, CASE WHEN predicted_volatility > 0 THEN annualized_volatility / predicted_volatility END AS realized_to_predicted FROM ({metrics_sql('method, test_year')}) m "
    "JOIN (SELECT method, test_year, sqrt(12 * avg(ex_ante_monthly_variance)) AS predicted_volatility FROM rets GROUP BY 1, 2) USING (method, test_year)",
    RETURNS,
)
def yearly_attribution(spark, sf_dir):
    return inference.yearly_attribution(base.returns(spark, sf_dir), None)


@register("annual_performance", f"method test_year {METRICS}", metrics_sql("method, test_year"), RETURNS)
def annual_performance(spark, sf_dir):
    return performance.performance(base.returns(spark, sf_dir), by=["method", "test_year"])


@register(
    "performance_scopes",
    f"scope method test_year {METRICS}",
    f"SELECT 'year' AS scope, * FROM ({metrics_sql('method, test_year')}) UNION ALL BY NAME SELECT 'full' AS scope, CAST(NULL AS INTEGER) AS test_year, * FROM ({metrics_sql('method')})",
    RETURNS,
)
def performance_scopes(spark, sf_dir):
    """Yearly and full-sample metrics in one pass with grouping sets."""
    return performance.performance_scopes(base.returns(spark, sf_dir))


@register(
    "max_drawdown",
    "method max_drawdown:8",
    "SELECT method, min(dd) AS max_drawdown FROM (SELECT method, wealth / max(wealth) OVER (PARTITION BY method ORDER BY eom) - 1 AS dd FROM (SELECT *, product(1 + greatest(gross_return, -0.999999e0)) OVER (PARTITION BY method ORDER BY eom) AS wealth FROM rets)) GROUP BY 1",
    RETURNS,
)
def max_drawdown(spark, sf_dir):
    return performance.max_drawdown(base.returns(spark, sf_dir), ["method"], "gross_return")


@register(
    "validation_utility",
    "method test_year validation_utility:8",
    "SELECT method, test_year, 12 * avg(net_return) - 0.5 * 1e1 * 12 * var_samp(net_return) AS validation_utility FROM rets GROUP BY 1, 2",
    RETURNS,
)
def validation_utility(spark, sf_dir):
    return performance.validation_utility(base.returns(spark, sf_dir), ["method", "test_year"])


@register(
    "selection_score",
    "method test_year score:8",
    "SELECT method, test_year, CASE WHEN method IN ('markowitz', 'top_bottom') THEN avg(gross_return) - avg(trading_cost) - 5e0 * var_pop(gross_return) ELSE avg(utility_flow) END AS score FROM rets GROUP BY 1, 2",
    RETURNS,
)
def selection_score(spark, sf_dir):
    return performance.selection_score(
        base.returns(spark, sf_dir), ["method", "test_year"], ["markowitz", "top_bottom"]
    )


@register(
    "completeness",
    "method rows:bigint months:bigint years:bigint complete",
    "SELECT method, count(*) AS rows, count(DISTINCT eom) AS months, count(DISTINCT test_year) AS years, count(DISTINCT eom) = 82 AND count(*) = count(DISTINCT eom) AS complete FROM rets GROUP BY 1",
    RETURNS,
)
def completeness(spark, sf_dir):
    return performance.completeness(base.returns(spark, sf_dir), ["method"], 82)


def annual_table(spark, sf_dir) -> DataFrame:
    return base.shared(
        spark, sf_dir, "annual", lambda: performance.performance(base.returns(spark, sf_dir), by=["method", "test_year"])
    )


ANNUAL = f"{RETURNS},\nyearly AS ({metrics_sql('method, test_year')})"


@register(
    "positive_topk_share",
    "method top_1_share:8 top_3_share:8 top_5_share:8",
    "SELECT method, sum(v) FILTER (WHERE rn <= 1 AND v > 0) / sum(v) FILTER (WHERE v > 0) AS top_1_share, sum(v) FILTER (WHERE rn <= 3 AND v > 0) / sum(v) FILTER (WHERE v > 0) AS top_3_share, sum(v) FILTER (WHERE rn <= 5 AND v > 0) / sum(v) FILTER (WHERE v > 0) AS top_5_share FROM "
    "(SELECT method, annualized_net_return AS v, row_number() OVER (PARTITION BY method ORDER BY annualized_net_return DESC) AS rn FROM yearly) GROUP BY 1",
    ANNUAL,
)
def positive_topk_share(spark, sf_dir):
    return performance.positive_topk_share(annual_table(spark, sf_dir), ["method"], "annualized_net_return")


@register(
    "best_worst",
    "method best_year best_value:8 worst_year worst_value:8",
    "SELECT method, arg_max(test_year, annualized_net_return) AS best_year, max(annualized_net_return) AS best_value, arg_min(test_year, annualized_net_return) AS worst_year, min(annualized_net_return) AS worst_value FROM yearly GROUP BY 1",
    ANNUAL,
)
def best_worst(spark, sf_dir):
    return performance.best_worst(annual_table(spark, sf_dir), ["method"], "annualized_net_return", "test_year")


@register(
    "win_years",
    "method years:bigint wins_annualized_net_return:bigint wins_empirical_utility:bigint",
    "SELECT a.method, count(*) AS years, count(*) FILTER (WHERE a.annualized_net_return > b.annualized_net_return) AS wins_annualized_net_return, count(*) FILTER (WHERE a.empirical_utility > b.empirical_utility) AS wins_empirical_utility FROM yearly a JOIN yearly b ON a.test_year = b.test_year AND b.method = 'equal_weight' WHERE a.method <> 'equal_weight' GROUP BY 1",
    ANNUAL,
)
def win_years(spark, sf_dir):
    return performance.win_years(
        annual_table(spark, sf_dir), "equal_weight", ["annualized_net_return", "empirical_utility"]
    )


WIDE = ", ".join(f"max(CASE WHEN method = '{m}' THEN annualized_net_return END) AS {m}" for m in base.METHODS)
GAPS = [m for m in base.METHODS if m != "equal_weight"]


@register(
    "pivot_year",
    "test_year " + " ".join(f"{m}:8" for m in base.METHODS) + " " + " ".join(f"{m}_minus_equal_weight:8" for m in GAPS),
    f"SELECT *, {', '.join(f'{m} - equal_weight AS {m}_minus_equal_weight' for m in GAPS)} FROM (SELECT test_year, {WIDE} FROM yearly GROUP BY 1)",
    ANNUAL,
)
def pivot_year(spark, sf_dir):
    return performance.pivot_year(annual_table(spark, sf_dir), "annualized_net_return", base.METHODS)


@register(
    "method_pairs",
    "eom candidate_method benchmark_method years_agree delta_net_return:8",
    f"SELECT eom, {KEYS}, true AS years_agree, delta_net_return FROM diffs",
    DIFFS,
)
def method_pairs(spark, sf_dir):
    return joins.method_pairs(base.returns(spark, sf_dir), PAIRS, ["net_return"], rounding=0.0)


@register(
    "pairwise_deltas",
    "test_year from_spec to_spec delta_annualized_net_return:8 delta_empirical_utility:6",
    "SELECT a.test_year, a.method AS from_spec, b.method AS to_spec, b.annualized_net_return - a.annualized_net_return AS delta_annualized_net_return, b.empirical_utility - a.empirical_utility AS delta_empirical_utility FROM yearly a JOIN yearly b ON a.test_year = b.test_year AND a.method < b.method",
    ANNUAL,
)
def pairwise_deltas(spark, sf_dir):
    return joins.pairwise_deltas(
        annual_table(spark, sf_dir), "method", ["test_year"], ["annualized_net_return", "empirical_utility"]
    )


@register(
    "exclude_years_robustness",
    f"sample method {METRICS}",
    metrics_sql("sample, method", source="(SELECT s.sample, r.* FROM rets r JOIN (VALUES ('full', []), ('no_1998', [1998]), ('no_1997_1998', [1997, 1998]), ('no_2000', [2000]), ('no_last', [2001])) s(sample, gone) ON NOT list_contains(s.gone, r.test_year))"),
    RETURNS,
)
def exclude_years_robustness(spark, sf_dir):
    """Performance on five samples that leave years out."""
    rows = inference.samples(
        base.returns(spark, sf_dir),
        {"full": [], "no_1998": [1998], "no_1997_1998": [1997, 1998], "no_2000": [2000], "no_last": [2001]},
    )
    return performance.performance(rows, by=["sample", "method"])


@register(
    "decomposition",
    "method test_year net_return_difference:8 turnover_difference:8 positive_share:8",
    "SELECT method, test_year, dn AS net_return_difference, dt AS turnover_difference, CASE WHEN sum(greatest(dn, 0e0)) OVER (PARTITION BY method) > 0 THEN greatest(dn, 0e0) / sum(greatest(dn, 0e0)) OVER (PARTITION BY method) END AS positive_share FROM "
    "(SELECT a.method, a.test_year, b.n - a.n AS dn, b.t - a.t AS dt FROM (SELECT method, test_year, sum(gross_return) AS n, sum(turnover) AS t FROM rets GROUP BY 1, 2) a JOIN (SELECT method, test_year, sum(net_return) AS n, sum(turnover) * 0.5e0 AS t FROM rets GROUP BY 1, 2) b USING (method, test_year))",
    RETURNS,
)
def decomposition(spark, sf_dir):
    """Year by year from gross to net (and half the turnover): two result sets side by side."""
    rows = base.returns(spark, sf_dir).groupBy("method", "test_year")
    left = rows.agg(F.sum("gross_return").alias("net_return"), F.sum("turnover").alias("turnover"))
    right = rows.agg(F.sum("net_return").alias("net_return"), (F.sum("turnover") * 0.5).alias("turnover"))
    return inference.decomposition(left, right, ["net_return", "turnover"])


@register(
    "compare_wide",
    "method n_months_a n_months_b n_months_difference net_a:8 net_b:8 net_difference:8",
    "SELECT a.method, a.n AS n_months_a, b.n AS n_months_b, b.n - a.n AS n_months_difference, a.net AS net_a, b.net AS net_b, b.net - a.net AS net_difference FROM (SELECT method, count(*) AS n, avg(net_return) AS net FROM rets WHERE test_year < 1998 GROUP BY 1) a JOIN (SELECT method, count(*) AS n, avg(net_return) AS net FROM rets WHERE test_year >= 1998 GROUP BY 1) b USING (method)",
    RETURNS,
)
def compare_wide(spark, sf_dir):
    rows = base.returns(spark, sf_dir)
    side = lambda part: part.groupBy("method").agg(
        F.count(F.lit(1)).alias("n_months"), F.avg("net_return").alias("net")
    )
    return joins.compare_wide(side(rows.where("test_year < 1998")), side(rows.where("test_year >= 1998")), ["method"], ("a", "b"))


@register(
    "align",
    "eom entity value:8",
    "SELECT eom, entity, rank_momentum AS value FROM uni",
    f"{PANEL},{UNIVERSE}",
)
def align(spark, sf_dir):
    """Left join on the panel key in which every row must find one match."""
    rows = base.universe(spark, sf_dir).select("eom", "entity")
    right = base.panel(spark, sf_dir).withColumnRenamed("rank_momentum", "value")
    return joins.align(rows, right, ["eom", "entity"], "value")


@register(
    "join_one_to_one",
    "eom method gross_return:8 drawdown_base:8",
    "SELECT r.eom, r.method, r.gross_return, e.net_return AS drawdown_base FROM rets r JOIN rets e ON e.eom = r.eom AND e.method = 'equal_weight' WHERE r.method = 'markowitz'",
    RETURNS,
)
def join_one_to_one(spark, sf_dir):
    rows = base.returns(spark, sf_dir)
    left = rows.where("method = 'markowitz'").select("eom", "method", "gross_return")
    right = rows.where("method = 'equal_weight'").select("eom", F.col("net_return").alias("drawdown_base"))
    return joins.join_one_to_one(left, right, ["eom"])


@register(
    "join_many_to_one",
    "eom method stock_cost:8 mean_adv:4",
    "SELECT eom, method, sum(0.5e0 * lambda_adv * weight * weight) AS stock_cost, avg(adv_6m) AS mean_adv FROM weights JOIN uni USING (eom, entity) GROUP BY 1, 2",
    f"{PANEL},{UNIVERSE},{WEIGHTS}",
)
def join_many_to_one(spark, sf_dir):
    """A ledger of several methods against one cost table."""
    held = base.held(spark, sf_dir).select("eom", "entity", "method", "weight")
    costs = base.panel(spark, sf_dir).select("eom", "entity", "adv_6m", "lambda_adv")
    rows = joins.join_many_to_one(held, costs, ["eom", "entity"])
    return rows.groupBy("eom", "method").agg(
        F.sum(F.lit(0.5) * F.col("lambda_adv") * F.col("weight") ** 2).alias("stock_cost"), F.avg("adv_6m").alias("mean_adv")
    )


@register(
    "extend_panel",
    "rows:bigint extended:bigint changed:bigint",
    "SELECT count(*) AS rows, count(*) FILTER (WHERE in_mid) AS extended, count(*) FILTER (WHERE was IS DISTINCT FROM now) AS changed FROM (SELECT *, mktcap AS was, CASE WHEN entity % 13 = 0 AND month(eom) = 3 THEN mktcap + 1 ELSE mktcap END AS now FROM panel)",
    PANEL,
)
def extend_panel(spark, sf_dir):
    """New columns by key; what came through otherwise is counted: market caps that are planted wrong every March."""
    rows = base.panel(spark, sf_dir)
    new = base.universe(spark, sf_dir).select("eom", "entity", "variance")
    wider = joins.extend_panel(rows, new, ["eom", "entity"])
    faulty = F.when((F.col("entity") % 13 == 0) & (F.month("eom") == 3), F.col("mktcap") + 1.0).otherwise(F.col("mktcap"))
    changed = joins.changed_rows(rows, wider.withColumn("mktcap", faulty), ["eom", "entity"]).agg(F.count(F.lit(1)).alias("changed"))
    counts = wider.agg(F.count(F.lit(1)).alias("rows"), F.count("variance").alias("extended"))
    return counts.join(F.broadcast(changed))


@register(
    "symmetric_covariance",
    "eom factor_1 factor_2 covariance:12",
    "SELECT eom, factor_1, factor_2, covariance FROM factor_cov UNION ALL SELECT eom, factor_2, factor_1, covariance FROM factor_cov WHERE factor_1 <> factor_2",
    EWMA,
)
def symmetric_covariance(spark, sf_dir):
    return joins.symmetric_covariance(monthly_covariance(spark, sf_dir), ["eom"])


CHOICES = """
choices AS (SELECT user_id, day, arg_min(event_type, (-n, event_type)) AS choice FROM (SELECT user_id, CAST(ts AS DATE) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2, 3) GROUP BY 1, 2),
moves AS (SELECT *, choice <> lag(choice) OVER (PARTITION BY user_id ORDER BY day) AS chg FROM choices)"""


def choices(spark, sf_dir) -> DataFrame:
    """Each user's most frequent event type of the day: one row per user and day."""
    counts = read(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").alias("day"), "event_type").count()
    best = F.min_by("event_type", F.struct(-F.col("count"), F.col("event_type")))
    return counts.groupBy("user_id", "day").agg(best.alias("choice"))


@register(
    "mode_stats",
    "user_id rows:bigint unique_values:bigint changes:bigint modal_value modal_share:8 first_value last_value",
    "SELECT user_id, sum(n)::BIGINT AS rows, count(*) AS unique_values, sum(chg)::BIGINT AS changes, arg_min(choice, (-n, choice)) AS modal_value, max(n) / sum(n)::DOUBLE AS modal_share, arg_min(choice, f) AS first_value, arg_max(choice, l) AS last_value FROM "
    "(SELECT user_id, choice, count(*) AS n, count(*) FILTER (WHERE chg) AS chg, min(day) AS f, max(day) AS l FROM moves GROUP BY 1, 2) GROUP BY 1",
    CHOICES,
)
def mode_stats(spark, sf_dir):
    return performance.mode_stats(choices(spark, sf_dir), ["user_id"], "choice", "day")


@register(
    "change_count",
    "user_id changes:bigint",
    "SELECT user_id, count(*) FILTER (WHERE chg) AS changes FROM moves GROUP BY 1",
    CHOICES,
)
def change_count(spark, sf_dir):
    return performance.change_count(choices(spark, sf_dir), ["user_id"], "choice", "day")


@register(
    "frequency",
    "event_type uses:bigint total:bigint share:8",
    "SELECT event_type, count(*) AS uses, (SELECT count(*) FROM events) AS total, count(*) / (SELECT count(*) FROM events)::DOUBLE AS share FROM events GROUP BY 1",
)
def frequency(spark, sf_dir):
    return performance.frequency(read(spark, sf_dir, "events"), ["event_type"])


@register(
    "recurrence",
    "l_returnflag l_linenumber uses:bigint breaches:bigint breach_share:8",
    "SELECT l_returnflag, l_linenumber, count(*) AS uses, count(*) FILTER (WHERE l_discount > 0.05) AS breaches, count(*) FILTER (WHERE l_discount > 0.05) / count(*)::DOUBLE AS breach_share FROM lineitem GROUP BY 1, 2",
)
def recurrence(spark, sf_dir):
    return performance.recurrence(
        read(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linenumber"], F.col("l_discount") > 0.05
    )


@register(
    "runtime_profile",
    "event_type jobs:bigint total_seconds:2 p50:6 p95:6 max_seconds:2 span_micros:bigint",
    "SELECT event_type, count(*) AS jobs, sum(value) AS total_seconds, median(value) AS p50, quantile_cont(value, 0.95) AS p95, max(value) AS max_seconds, epoch_us(max(ts)) - epoch_us(min(ts)) AS span_micros FROM events GROUP BY 1",
)
def runtime_profile(spark, sf_dir):
    """Events read as job records: seconds by kind."""
    return performance.runtime_profile(read(spark, sf_dir, "events"), ["event_type"], "value", "ts", "ts")


@register(
    "diagnostic_summary",
    "method months:bigint mean_turnover:8 max_turnover:8 median_turnover:8 mean_leverage:8 max_leverage:8 median_leverage:8 mean_trading_cost:8 max_trading_cost:8 median_trading_cost:8",
    "SELECT method, count(*) AS months, " + ", ".join(f"avg({c}) AS mean_{c}, max({c}) AS max_{c}, median({c}) AS median_{c}" for c in ("turnover", "leverage", "trading_cost")) + " FROM rets GROUP BY 1",
    RETURNS,
)
def diagnostic_summary(spark, sf_dir):
    return performance.diagnostic_summary(
        base.returns(spark, sf_dir), ["method"], ["turnover", "leverage", "trading_cost"]
    )


@register(
    "reconcile",
    "column_name max_difference:8 passed",
    "SELECT 'net_return' AS column_name, max(abs(net_return - (gross_return - trading_cost))) AS max_difference, true AS passed FROM rets UNION ALL SELECT 'gross_return', max(abs(gross_return - gross_return * 1.5e0)), false FROM rets",
    RETURNS,
)
def reconcile(spark, sf_dir):
    """Reported against recomputed: one column agrees, one is planted to be off."""
    rows = base.returns(spark, sf_dir)
    again = rows.select(
        "eom", "method", (F.col("gross_return") - F.col("trading_cost")).alias("net_return"),
        (F.col("gross_return") * 1.5).alias("gross_return"),
    )
    return performance.reconcile(rows, again, ["eom", "method"], ["net_return", "gross_return"], 1e-12)
