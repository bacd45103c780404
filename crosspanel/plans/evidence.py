"""Registered queries: importance by year, influence of single features, evidence gates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from crosspanel import settings as S
from crosspanel.operators import evidence, ledger, signals
from crosspanel.plans import base
from crosspanel.plans.policies import POLICY_PENALTIES, SETS, STATISTICS, X2, betas, designed
from crosspanel.plans.portfolio import metrics_sql
from crosspanel.plans.registry import register
from crosspanel.plans.signals import CROSS, _paths, feature_table, monthly_ic, path_sql
from crosspanel.plans.sqltext import FEATURES, pricing_ctes, scan_ctes

CRISIS = (1997, 1998)
OUTCOMES = S.IMPORTANCE_OUTCOMES

IMPORTANCE = f"""{STATISTICS},
saims AS (SELECT s.name AS method, penalty, d.entity, d.eom, d.t, d.variance, d.speed, d.lift, d1 * beta1 * s.k1 + d2 * beta2 * s.k2 AS aim FROM designed d JOIN betas b USING (test_year) CROSS JOIN (VALUES ('none', 1e0, 1e0), ('discount', 0e0, 1e0), ('momentum', 1e0, 0e0)) s(name, k1, k2)),
sterms AS (SELECT method, penalty, entity, eom, t, variance, (1 - speed) * aim AS a, speed AS b, lift FROM saims),
{scan_ctes('sterms', 'method, penalty', 'spos')},{pricing_ctes('(SELECT method, penalty, eom, entity, weight, variance FROM spos)', keys='method, penalty')},
smetrics AS (SELECT 'full' AS scope, CAST(NULL AS INTEGER) AS test_year, * FROM ({metrics_sql('method, penalty')})
  UNION ALL BY NAME SELECT 'year' AS scope, * FROM ({metrics_sql('method, penalty, test_year')})),
byyear AS (SELECT n.penalty, n.scope, n.test_year, n.method AS neutralized, {", ".join(f"f.{m} - n.{m} AS {o}" for o, m in OUTCOMES.items())}, f.annualized_ex_ante_utility_flow AS full_utility, n.annualized_ex_ante_utility_flow AS neutralized_utility
  FROM smetrics n JOIN smetrics f ON f.method = 'none' AND f.penalty = n.penalty AND f.scope = n.scope AND f.test_year IS NOT DISTINCT FROM n.test_year WHERE n.method <> 'none')"""


def scenario_returns(spark, sf_dir) -> DataFrame:
    """Monthly returns for both penalties, with no feature and with each in turn neutral."""
    def build():
        carried = evidence.superposed_positions(
            designed(spark, sf_dir), betas(spark, sf_dir), base.stats(spark, sf_dir), X2, SETS, POLICY_PENALTIES
        )
        return ledger.evaluate(carried, evidence.SCENARIO, base.AUM)

    return base.shared(spark, sf_dir, "importance_returns", build)


def yearly(spark, sf_dir) -> DataFrame:
    return evidence.importance_by_year(scenario_returns(spark, sf_dir), ["penalty"])


@register(
    "scenario_ledger",
    "penalty:4 neutralized eom gross_return:8 trading_cost:8 exit_cost:8 net_return:8 utility_flow:8 turnover:8 leverage:8 n_names:bigint dropped_names:bigint",
    "SELECT * RENAME (method AS neutralized) FROM rets",
    IMPORTANCE,
)
def scenario_ledger(spark, sf_dir):
    """Ledger of every (penalty, neutral set) from one recursion per name; positions are sums of feature parts."""
    return scenario_returns(spark, sf_dir)


@register(
    "importance_by_year",
    "penalty:4 scope test_year neutralized " + " ".join(f"{o}:8" for o in OUTCOMES) + " full_utility:8 neutralized_utility:8 place:bigint",
    "SELECT *, CASE WHEN scope = 'full' THEN rank() OVER (PARTITION BY penalty, scope, test_year ORDER BY delta_utility DESC) END AS place FROM byyear",
    IMPORTANCE,
)
def importance_by_year(spark, sf_dir):
    """Six outcomes lost when a feature is neutral, for the sample and each year, under both penalties."""
    value = "annualized_ex_ante_utility_flow"
    return yearly(spark, sf_dir).withColumnsRenamed(
        {f"full_{value}": "full_utility", f"neutralized_{value}": "neutralized_utility"}
    )


@register(
    "importance_concentration",
    "penalty:4 neutralized top_1_share:6 top_3_share:6 top_5_share:6 crisis_share:6 years_positive:bigint largest_year largest_value:8",
    "SELECT penalty, neutralized, " + ", ".join(f"CASE WHEN sum(g) > 0 THEN sum(CASE WHEN rn <= {k} THEN g ELSE 0e0 END) / sum(g) END AS top_{k}_share" for k in (1, 3, 5))
    + f", CASE WHEN sum(g) > 0 THEN sum(CASE WHEN test_year IN {CRISIS} THEN g ELSE 0e0 END) / sum(g) END AS crisis_share, count(*) FILTER (WHERE delta_utility > 0) AS years_positive, max(CASE WHEN rn = 1 THEN test_year END) AS largest_year, max(CASE WHEN rn = 1 THEN delta_utility END) AS largest_value "
    "FROM (SELECT *, greatest(delta_utility, 0e0) AS g, row_number() OVER (PARTITION BY penalty, neutralized ORDER BY delta_utility DESC, test_year) AS rn FROM byyear WHERE scope = 'year') GROUP BY 1, 2",
    IMPORTANCE,
)
def importance_concentration(spark, sf_dir):
    """How far a feature's importance rests on few years, or on years of crisis."""
    return evidence.importance_concentration(yearly(spark, sf_dir), ["penalty", "neutralized"], CRISIS)


# Influence of single features ---------------------------------------------------------------------

SHAPES = {"fmb": ("sfm", "sdm", "ssh", "apr_3", "apr_6", "apr_12"), "rankic": ("sfm", "sdm", "ssh", "apr_12")}
METHODS = ("rank", "linear")
PRIMARY, TREND, REVERSAL = "fmb_sfm", "momentum", "discount"

INFLUENCE = f"""{CROSS},
rpaths AS ({path_sql('ric')}),
targets AS (SELECT feature, 'rank' AS method, round(avg(rank_ic), 10) AS target FROM ic GROUP BY 1 UNION ALL SELECT feature, 'linear', round(avg(pearson_ic), 10) FROM ic GROUP BY 1),
shapes AS ({" UNION ALL ".join(f"SELECT feature, '{k}_{m}' AS metric, round({m}, 10) AS value FROM {'paths' if k == 'fmb' else 'rpaths'}" for k, ms in SHAPES.items() for m in ms)}),
pairs_f AS (SELECT * FROM shapes JOIN targets USING (feature) WHERE value IS NOT NULL AND target IS NOT NULL),
left_out AS (SELECT f.*, coalesce(o.feature, '') AS omitted FROM pairs_f f JOIN (SELECT feature FROM targets WHERE method = 'rank' UNION ALL SELECT NULL) o ON o.feature IS NULL OR o.feature <> f.feature),
ranked_out AS (SELECT method, metric, omitted, rank() OVER (PARTITION BY method, metric, omitted ORDER BY value) + (count(*) OVER (PARTITION BY method, metric, omitted, value) - 1) / 2e0 AS rx,
  rank() OVER (PARTITION BY method, metric, omitted ORDER BY target) + (count(*) OVER (PARTITION BY method, metric, omitted, target) - 1) / 2e0 AS ry FROM left_out),
rhos AS (SELECT method, metric, omitted, count(*) AS n, CASE WHEN isnan(corr(rx, ry)) THEN NULL ELSE corr(rx, ry) END AS rho FROM ranked_out GROUP BY 1, 2, 3),
jack AS (SELECT l.method, l.metric, l.omitted, l.n, f.rho AS full_sample, l.rho AS leave_one_out, round(abs(l.rho - f.rho), 10) AS change FROM rhos l JOIN rhos f ON f.omitted = '' AND l.omitted <> '' AND f.method = l.method AND f.metric = l.metric),
influence AS (SELECT method, metric, max(full_sample) AS full_sample, min(leave_one_out) AS minimum, max(leave_one_out) AS maximum, median(leave_one_out) AS median, avg(same) AS sign_stability, min(same) = 1 AS sign_stable,
  max(CASE WHEN rn = 1 THEN omitted END) AS most_influential, max(CASE WHEN rn = 1 THEN change END) AS largest_change, max(CASE WHEN omitted = '{TREND}' THEN leave_one_out END) AS named_omission, count(*) AS n FROM
  (SELECT *, row_number() OVER (PARTITION BY method, metric ORDER BY change DESC NULLS LAST, omitted) AS rn, coalesce(CASE WHEN sign(round(leave_one_out, 10)) = sign(round(full_sample, 10)) THEN 1e0 ELSE 0e0 END, 0e0) AS same FROM jack) GROUP BY 1, 2)"""


def jackknife(spark, sf_dir) -> DataFrame:
    """Each shape of a feature's path against the two means of its correlation, with each feature left out.

    The targets stand in for the importance of a feature under two models; values are rounded to ten places before they
    are ranked, and so are the results that are compared with one another.
    """
    def build():
        stats = monthly_ic(spark, sf_dir).groupBy("feature").agg(
            F.avg("rank_ic").alias("rank"), F.avg("pearson_ic").alias("linear")
        )
        targets = stats.select("feature", F.inline(F.array(*[
            F.struct(F.lit(m).alias("method"), F.round(m, 10).alias("target")) for m in METHODS
        ])))
        shapes = []
        for kind, names in SHAPES.items():
            path = signals.path_metrics(_paths(spark, sf_dir), ["feature"], "slope" if kind == "fmb" else "ric")
            items = [F.struct(F.lit(f"{kind}_{m}").alias("metric"), F.round(m, 10).alias("value")) for m in names]
            shapes.append(path.select("feature", F.inline(F.array(*items))))
        rows = reduce(DataFrame.unionByName, shapes).join(F.broadcast(targets), "feature")
        out = evidence.spearman_jackknife(rows, ["method", "metric"], "feature", "value", "target")
        return out.withColumns({c: F.round(c, 10) for c in ("full_sample", "leave_one_out", "change")})

    return base.shared(spark, sf_dir, "jackknife", build)


@register(
    "spearman_jackknife",
    "method metric omitted n:bigint full_sample:8 leave_one_out:8 change:8",
    "SELECT * FROM jack",
    INFLUENCE,
)
def spearman_jackknife(spark, sf_dir):
    return jackknife(spark, sf_dir)


@register(
    "influence_summary",
    "method metric full_sample:8 minimum:8 maximum:8 median:8 sign_stability:8 sign_stable most_influential largest_change:8 named_omission:8 n:bigint",
    "SELECT * FROM influence",
    INFLUENCE,
)
def influence_summary(spark, sf_dir):
    return evidence.influence_summary(jackknife(spark, sf_dir), ["method", "metric"], TREND)


GATES = f"""{INFLUENCE},
facts AS (SELECT max(CASE WHEN metric = '{PRIMARY}' AND method = 'rank' THEN round(full_sample, 10) END) AS first_primary, max(CASE WHEN metric = '{PRIMARY}' AND method = 'linear' THEN round(full_sample, 10) END) AS second_primary,
  avg(CASE WHEN method = 'rank' THEN CASE WHEN round(full_sample, 10) > 0 THEN 1e0 ELSE 0e0 END END) AS first_positive_share, avg(CASE WHEN method = 'linear' THEN CASE WHEN round(full_sample, 10) > 0 THEN 1e0 ELSE 0e0 END END) AS second_positive_share,
  coalesce(bool_and(sign_stable AND largest_change <= 0.35) FILTER (WHERE metric = '{PRIMARY}'), false) AS stability_pass FROM influence),
shaped AS (SELECT p.*, t.target, sign(r.h1) = sign(p.h1) AS h1_agree FROM paths p JOIN rpaths r USING (feature) JOIN targets t ON t.feature = p.feature AND t.method = 'rank'),
coherent AS (SELECT coalesce(max(CASE WHEN feature = '{TREND}' THEN sfm > 0 AND first_reversal = 13 AND target > 0 END), false) AS trend_coherent,
  coalesce(max(CASE WHEN feature = '{REVERSAL}' THEN first_decay = 2 AND NOT recovers AND apr_12 < 0.5 AND h1_agree AND target <= 0 END), false) AS reversal_coherent FROM shaped),
earlier AS (SELECT round(corr(rx, ry), 10) AS prior FROM (SELECT rank() OVER (ORDER BY round(rho, 10)) + 0e0 AS rx, rank() OVER (ORDER BY target) + 0e0 AS ry FROM table_f JOIN targets t USING (feature) WHERE method = 'rank')),
gated AS (SELECT *, coalesce(first_primary >= prior + 0.2, false) AS improvement_pass, coalesce(first_primary > 0 AND second_primary > 0 AND least(first_positive_share, second_positive_share) >= 0.6, false) AS consistency_pass, trend_coherent AND reversal_coherent AS coherence_pass FROM facts, coherent, earlier)"""


@register(
    "evidence_class",
    "first_primary:8 second_primary:8 prior:8 first_positive_share:8 second_positive_share:8 improvement_pass consistency_pass stability_pass trend_coherent reversal_coherent coherence_pass decision classification",
    """SELECT *, CASE WHEN improvement_pass AND consistency_pass AND stability_pass AND coherence_pass THEN 'Case A' ELSE 'Case B' END AS decision,
    CASE WHEN improvement_pass AND consistency_pass AND stability_pass AND coherence_pass THEN CASE WHEN first_primary >= 0.5 AND second_primary >= 0.5 AND least(first_positive_share, second_positive_share) >= 0.8 THEN 'strongly consistent' ELSE 'moderately consistent' END
      WHEN first_primary > 0 AND second_primary > 0 AND least(first_positive_share, second_positive_share) >= 0.5 AND coherence_pass THEN 'weakly consistent'
      WHEN NOT coalesce(sign(first_primary) = sign(second_primary), false) OR least(first_positive_share, second_positive_share) < 0.5 THEN 'mixed' ELSE 'inconsistent' END AS classification FROM gated""",
    GATES,
)
def evidence_class(spark, sf_dir):
    """The gates on the jackknifed correlations, as one row."""
    slope = signals.path_metrics(_paths(spark, sf_dir), ["feature"], "slope")
    ric = signals.path_metrics(_paths(spark, sf_dir), ["feature"], "ric").select("feature", F.col("h1").alias("__h1"))
    target = monthly_ic(spark, sf_dir).groupBy("feature").agg(F.round(F.avg("rank_ic"), 10).alias("target"))
    features = slope.join(ric, "feature").join(target, "feature").withColumn(
        "h1_agree", F.signum("__h1") == F.signum("h1")
    )
    rho = feature_table(spark, sf_dir).select("feature", F.round("rho", 10).alias("rho")).join(target, "feature")
    prior = signals.rank_correlation(rho, [], "rho", "target", len(FEATURES)).select(F.round("spearman", 10).alias("prior"))
    summary = evidence.influence_summary(jackknife(spark, sf_dir), ["method", "metric"], TREND)
    return evidence.classify_evidence(summary, features, prior, METHODS, PRIMARY, TREND, REVERSAL)
