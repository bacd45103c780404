"""Registered queries: cross-sectional ranks, windows, scaling and policy weights."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from crosspanel import settings as S
from crosspanel.operators import ledger, performance, policy, ranks, scaling, windows
from crosspanel.plans import base
from crosspanel.plans.registry import register
from crosspanel.plans.scans import LONG_SQL
from crosspanel.plans.sqltext import FEATURES, UNIVERSE, WEIGHTS, panel_ctes, pct_rank, returns_ctes
from crosspanel.sources import panel as source

PANEL = panel_ctes()
SPARSE = panel_ctes("l_partkey")
UNI = f"{PANEL},{UNIVERSE}"
HELD = f"{UNI},{WEIGHTS}"


@register(
    "cs_rank",
    "entity eom " + " ".join(f"rank_{f}:10" for f in FEATURES),
    "SELECT * FROM panel",
    PANEL,
)
def cs_rank(spark, sf_dir):
    """Average-tie percentile rank of every feature inside its month, null read as 0.5."""
    return base.panel(spark, sf_dir)


@register(
    "avg_rank",
    "entity eom rank:2",
    "SELECT entity, eom, CASE WHEN ret_exc_lead1m IS NOT NULL THEN rank() OVER (PARTITION BY eom ORDER BY ret_exc_lead1m NULLS LAST) "
    "+ (count(*) OVER (PARTITION BY eom, ret_exc_lead1m) - 1) / 2e0 END AS rank FROM panel",
    PANEL,
)
def avg_rank(spark, sf_dir):
    return ranks.average_rank(
        base.panel(spark, sf_dir), ["eom"], "ret_exc_lead1m", "rank", base.bound(spark, sf_dir)
    )


@register(
    "min_rank_desc",
    "entity eom rank:bigint",
    "SELECT entity, eom, CASE WHEN raw_tax IS NOT NULL THEN rank() OVER (PARTITION BY eom ORDER BY raw_tax DESC NULLS LAST) END AS rank FROM panel",
    PANEL,
)
def min_rank_desc(spark, sf_dir):
    return ranks.minimum_rank_descending(
        base.panel(spark, sf_dir), ["eom"], "raw_tax", "rank", base.bound(spark, sf_dir)
    )


@register(
    "row_rank",
    "entity eom rank:bigint",
    "SELECT entity, eom, row_number() OVER (PARTITION BY eom ORDER BY rank_discount, entity) AS rank FROM panel",
    PANEL,
)
def row_rank(spark, sf_dir):
    return ranks.ordinal_rank(
        base.panel(spark, sf_dir), ["eom"], [F.col("rank_discount"), F.col("entity")], "rank",
        base.bound(spark, sf_dir),
    )


@register(
    "bucketed_rank",
    "entity eom rank:10 place:bigint",
    f"SELECT entity, eom, {pct_rank('raw_tax')} AS rank, row_number() OVER (PARTITION BY eom ORDER BY rank_discount, entity) AS place FROM panel",
    PANEL,
)
def bucketed_rank(spark, sf_dir):
    """The same ranks by value buckets: the way taken when a month is too large for one task."""
    rows = base.panel(spark, sf_dir).drop("rank")
    rows = ranks.percentile_rank(rows, ["eom"], "raw_tax", "rank", bucket_rows=16)
    return ranks.ordinal_rank(
        rows, ["eom"], [F.col("rank_discount"), F.col("entity")], "place", bucket_rows=16
    )


@register(
    "bucketed_quantiles",
    "eom p01:10 p50:10 p99:10",
    "SELECT eom, quantile_cont(ret_1m, 0.01) AS p01, quantile_cont(ret_1m, 0.5) AS p50, quantile_cont(ret_1m, 0.99) AS p99 FROM panel GROUP BY eom",
    PANEL,
)
def bucketed_quantiles(spark, sf_dir):
    return ranks.quantiles(
        base.panel(spark, sf_dir), ["eom"], "ret_1m", {"p01": 0.01, "p50": 0.5, "p99": 0.99}, bucket_rows=16
    )


@register(
    "universe_flags",
    "entity eom universe_rank in_small in_mid in_large",
    "SELECT * FROM panel",
    PANEL,
)
def universe_flags(spark, sf_dir):
    return base.panel(spark, sf_dir)


@register(
    "liquidity_decile",
    "entity eom decile:bigint",
    "SELECT entity, eom, CASE WHEN n > 1 THEN greatest(1, ceil((rn - 1) * 10 / (n - 1)::DOUBLE)) ELSE 1 END AS decile FROM "
    "(SELECT *, row_number() OVER (PARTITION BY eom ORDER BY adv_6m, entity) AS rn, count(*) OVER (PARTITION BY eom) AS n FROM panel)",
    PANEL,
)
def liquidity_decile(spark, sf_dir):
    return windows.liquidity_decile(base.panel(spark, sf_dir), "adv_6m", base.bound(spark, sf_dir))


@register(
    "lag_month",
    "entity eom lag_size:8",
    "SELECT entity, eom, CASE WHEN month_index - lag(month_index) OVER w = 1 THEN lag(raw_size) OVER w END AS lag_size FROM panel_vol "
    "WINDOW w AS (PARTITION BY entity ORDER BY month_index)",
    SPARSE,
)
def lag_month(spark, sf_dir):
    """Last month's value, null across a gap; on the sparse panel, where most months are missing."""
    rows = source.build_panel(spark, sf_dir, entity="l_partkey")
    return windows.lag_month(rows, ["raw_size"]).withColumnRenamed("lag_raw_size", "lag_size")


@register(
    "row_lead",
    "entity eom next_ret:8",
    "SELECT entity, eom, lead(ret_1m) OVER (PARTITION BY entity ORDER BY eom) AS next_ret FROM panel",
    PANEL,
)
def row_lead(spark, sf_dir):
    return windows.row_lead(base.panel(spark, sf_dir), "ret_1m", "next_ret")


@register(
    "wealth_path",
    "method eom cumulative_return:8 drawdown:8",
    "SELECT method, eom, wealth - 1 AS cumulative_return, wealth / max(wealth) OVER (PARTITION BY method ORDER BY eom) - 1 AS drawdown FROM "
    "(SELECT *, product(1 + net_return) OVER (PARTITION BY method ORDER BY eom) AS wealth FROM rets)",
    returns_ctes(),
)
def wealth_path(spark, sf_dir):
    return performance.wealth_path(base.returns(spark, sf_dir), ["method"], "net_return")


def _unit_sql(f: str) -> str:
    return (
        f"CASE WHEN sqrt(sum(c_{f} * c_{f}) OVER (PARTITION BY eom)) > 1e-12 THEN c_{f} / sqrt(sum(c_{f} * c_{f}) OVER (PARTITION BY eom)) ELSE 0e0 END"
    )


@register(
    "cs_unit_norm",
    "entity eom z_rank_discount:8 z_rank_momentum:8 z_const:8",
    f"SELECT entity, eom, {_unit_sql('d')} AS z_rank_discount, {_unit_sql('m')} AS z_rank_momentum, 1e0 / sqrt(count(*) OVER (PARTITION BY eom)) AS z_const "
    "FROM (SELECT *, rank_discount - avg(rank_discount) OVER (PARTITION BY eom) AS c_d, rank_momentum - avg(rank_momentum) OVER (PARTITION BY eom) AS c_m FROM panel)",
    PANEL,
)
def cs_unit_norm(spark, sf_dir):
    return scaling.unit_norm(
        base.panel(spark, sf_dir), ["rank_discount", "rank_momentum"], constant="z_const"
    )


@register(
    "vol_scale",
    "entity eom scaled_discount:8 scaled_momentum:8",
    "SELECT entity, eom, rank_discount / v AS scaled_discount, rank_momentum / v AS scaled_momentum FROM (SELECT *, coalesce(CASE WHEN vol_12m >= 0.01e0 THEN vol_12m END, med, 0.05e0) AS v "
    "FROM panel JOIN (SELECT eom, median(CASE WHEN vol_12m >= 0.01e0 THEN vol_12m END) AS med FROM panel GROUP BY eom) USING (eom))",
    PANEL,
)
def vol_scale(spark, sf_dir):
    rows = scaling.clean_volatility(
        base.panel(spark, sf_dir), "vol_12m", "v", group_rows=base.bound(spark, sf_dir)
    ).withColumns({"scaled_discount": F.col("rank_discount"), "scaled_momentum": F.col("rank_momentum")})
    return scaling.volatility_scale(rows, ["scaled_discount", "scaled_momentum"], "v")


for _name, _method in (
    ("equal_weight", "equal_weight"),
    ("rank_long_short", "rank_long_short"),
    ("top_bottom", "top_bottom"),
    ("markowitz", "markowitz"),
):
    register(
        _name, "eom entity weight:10", f"SELECT * FROM weights WHERE method = '{_method}'", HELD
    )(lambda spark, sf_dir, m=_method: base.held(spark, sf_dir).where(F.col("method") == m))


@register(
    "value_weight",
    "eom entity weight:10",
    "SELECT eom, entity, CASE WHEN caps > 0 THEN CASE WHEN lag_mktcap > 0 THEN lag_mktcap / caps ELSE 0e0 END ELSE 1e0 / n END AS weight FROM "
    "(SELECT *, sum(CASE WHEN lag_mktcap > 0 THEN lag_mktcap END) OVER (PARTITION BY eom) AS caps, count(*) OVER (PARTITION BY eom) AS n FROM panel)",
    PANEL,
)
def value_weight(spark, sf_dir):
    return policy.value_weight(base.panel(spark, sf_dir))


@register(
    "count_jumps",
    "eom names:bigint change:8 jump",
    "SELECT eom, names, abs(names / lag(names) OVER (ORDER BY eom)::DOUBLE - 1) AS change, coalesce(abs(names / lag(names) OVER (ORDER BY eom)::DOUBLE - 1) > 0.02e0, false) AS jump "
    "FROM (SELECT eom, count(DISTINCT entity) AS names FROM panel_rets GROUP BY eom)",
    SPARSE,
)
def count_jumps(spark, sf_dir):
    rows = source.build_panel(spark, sf_dir, entity="l_partkey")
    return windows.count_jumps(rows, 0.02)


@register(
    "adv_lambda",
    "entity eom adv_6m:4 lambda_adv:12",
    "SELECT * FROM panel",
    PANEL,
)
def adv_lambda(spark, sf_dir):
    """Mean volume of the last six calendar months and the impact parameter it implies."""
    return windows.adv_lambda(base.panel(spark, sf_dir), "mktcap").select(
        "entity", "eom", "adv_6m", "lambda_adv"
    )


@register(
    "top_share",
    "eom share:8 names:bigint",
    "SELECT eom, sum(CASE WHEN rn <= greatest(1, ceil(0.1e0 * n)) THEN mktcap END) / sum(mktcap) AS share, count(*) FILTER (WHERE rn <= greatest(1, ceil(0.1e0 * n))) AS names FROM "
    "(SELECT *, row_number() OVER (PARTITION BY eom ORDER BY mktcap DESC, entity) AS rn, count(*) OVER (PARTITION BY eom) AS n FROM panel) GROUP BY eom",
    PANEL,
)
def top_share(spark, sf_dir):
    return windows.top_share(base.panel(spark, sf_dir), ["eom"], "mktcap", 0.1, base.bound(spark, sf_dir))


@register(
    "concentration",
    "eom method top10_abs_weight:8 top10_share:8 max_abs_weight:8",
    "SELECT eom, method, sum(CASE WHEN rn <= 10 THEN abs(weight) END) AS top10_abs_weight, CASE WHEN sum(abs(weight)) > 0 THEN sum(CASE WHEN rn <= 10 THEN abs(weight) END) / sum(abs(weight)) ELSE 0e0 END AS top10_share, "
    "max(abs(weight)) AS max_abs_weight FROM (SELECT *, row_number() OVER (PARTITION BY eom, method ORDER BY abs(weight) DESC, entity) AS rn FROM weights) GROUP BY eom, method",
    HELD,
)
def concentration(spark, sf_dir):
    return windows.concentration(base.held(spark, sf_dir), base.bound(spark, sf_dir))


@register(
    "cap_leverage",
    "eom method entity weight:10",
    "SELECT eom, method, entity, weight * CASE WHEN lev > 1.5e0 THEN 1.5e0 / lev ELSE 1e0 END AS weight FROM (SELECT *, sum(abs(weight)) OVER (PARTITION BY eom, method) AS lev FROM weights)",
    HELD,
)
def cap_leverage(spark, sf_dir):
    return policy.cap_leverage(base.held(spark, sf_dir), 1.5, by=["eom", "method"])


# Aggregates over the panel ------------------------------------------------------------------------


@register(
    "distribution",
    "count:bigint p50:10 p95:10 p99:10 p999:10 max:10",
    "SELECT count(*) AS count, quantile_cont(ret_1m, 0.5) AS p50, quantile_cont(ret_1m, 0.95) AS p95, quantile_cont(ret_1m, 0.99) AS p99, quantile_cont(ret_1m, 0.999) AS p999, max(ret_1m) AS max FROM panel WHERE ret_1m IS NOT NULL",
    PANEL,
)
def distribution(spark, sf_dir):
    """Exact quantiles of a whole column; past the measured bound they go by buckets."""
    return performance.distribution(base.panel(spark, sf_dir), "ret_1m", group_rows=base.rows(spark, sf_dir))


@register(
    "feature_coverage",
    "feature year rows:bigint missing_rate:8 neutral_fill_rate:8 fill_correct_fraction:8",
    f"SELECT feature, CAST(year(eom) AS INTEGER) AS year, count(*) AS rows, avg(CASE WHEN raw_value IS NULL THEN 1e0 ELSE 0e0 END) AS missing_rate, "
    "avg(CASE WHEN raw_value IS NULL AND rank_value = 0.5e0 THEN 1e0 ELSE 0e0 END) AS neutral_fill_rate, "
    "CASE WHEN count(*) FILTER (WHERE raw_value IS NULL) > 0 THEN count(*) FILTER (WHERE raw_value IS NULL AND rank_value = 0.5e0) / (count(*) FILTER (WHERE raw_value IS NULL))::DOUBLE ELSE 1e0 END AS fill_correct_fraction "
    f"FROM ({LONG_SQL}) GROUP BY 1, 2",
    PANEL,
)
def feature_coverage(spark, sf_dir):
    long = performance.unpivot_features(base.panel(spark, sf_dir), FEATURES, ["eom"])
    return performance.feature_coverage(long.withColumn("year", F.year("eom")), ["feature", "year"])


@register(
    "max_yearly_jump",
    "feature max_jump:8",
    "SELECT feature, max(abs(rate - prior)) AS max_jump FROM (SELECT *, lag(rate) OVER (PARTITION BY feature ORDER BY year) AS prior FROM "
    f"(SELECT feature, year(eom) AS year, avg(CASE WHEN raw_value IS NULL THEN 1e0 ELSE 0e0 END) AS rate FROM ({LONG_SQL}) GROUP BY 1, 2)) GROUP BY 1",
    PANEL,
)
def max_yearly_jump(spark, sf_dir):
    long = performance.unpivot_features(base.panel(spark, sf_dir), FEATURES, ["eom"])
    rates = performance.feature_coverage(long.withColumn("year", F.year("eom")), ["feature", "year"])
    return performance.yearly_jump(rates, ["feature"], "missing_rate")


@register(
    "cs_dispersion",
    "feature mean_std:8 median_std:8 p10_std:8 near_constant_share:8",
    "SELECT feature, avg(sd) AS mean_std, median(sd) AS median_std, quantile_cont(sd, 0.1) AS p10_std, avg(CASE WHEN sd < 0.01e0 THEN 1e0 ELSE 0e0 END) AS near_constant_share FROM "
    f"(SELECT feature, eom, stddev_samp(rank_value) AS sd FROM ({LONG_SQL}) GROUP BY 1, 2) GROUP BY 1",
    PANEL,
)
def cs_dispersion(spark, sf_dir):
    long = performance.unpivot_features(base.panel(spark, sf_dir), FEATURES, ["eom"])
    return performance.dispersion(long, ["feature"], "rank_value")


@register(
    "tie_fraction",
    "feature tie_fraction:8",
    f"SELECT feature, avg(tie) AS tie_fraction FROM (SELECT feature, eom, 1 - count(DISTINCT rank_value) / count(*)::DOUBLE AS tie FROM ({LONG_SQL}) GROUP BY 1, 2) GROUP BY 1",
    PANEL,
)
def tie_fraction(spark, sf_dir):
    long = performance.unpivot_features(base.panel(spark, sf_dir), FEATURES, ["eom"])
    return performance.tie_fraction(long, ["feature"], "rank_value")


@register(
    "equal_weight_return",
    "annualized_volatility:8",
    "SELECT sqrt(12) * stddev_samp(r) AS annualized_volatility FROM (SELECT eom, avg(ret_exc_lead1m) AS r FROM panel GROUP BY eom)",
    PANEL,
)
def equal_weight_return(spark, sf_dir):
    return performance.annualised_deviation(
        performance.equal_weight_return(base.panel(spark, sf_dir)), "equal_weight_return"
    )


@register(
    "weighted_avg",
    "eom weighted_return:8 weighted_adv:4",
    "SELECT eom, CASE WHEN sum(lag_mktcap) FILTER (WHERE ret_1m IS NOT NULL) > 0 THEN sum(ret_1m * lag_mktcap) / sum(lag_mktcap) FILTER (WHERE ret_1m IS NOT NULL) END AS weighted_return, "
    "CASE WHEN sum(lag_mktcap) > 0 THEN sum(adv_6m * lag_mktcap) / sum(lag_mktcap) END AS weighted_adv FROM panel GROUP BY eom",
    PANEL,
)
def weighted_avg(spark, sf_dir):
    cap = F.col("lag_mktcap")
    return base.panel(spark, sf_dir).groupBy("eom").agg(
        performance.weighted_average(F.col("ret_1m"), cap).alias("weighted_return"),
        performance.weighted_average(F.col("adv_6m"), cap).alias("weighted_adv"),
    )


@register(
    "weight_share",
    "eom method low_share:8 high_share:8",
    "SELECT eom, method, CASE WHEN sum(abs(weight)) > 0 THEN sum(CASE WHEN decile = 1 THEN abs(weight) ELSE 0e0 END) / sum(abs(weight)) END AS low_share, "
    "CASE WHEN sum(abs(weight)) > 0 THEN sum(CASE WHEN decile = 10 THEN abs(weight) ELSE 0e0 END) / sum(abs(weight)) END AS high_share FROM weights JOIN "
    "(SELECT entity, eom, greatest(1, ceil((rn - 1) * 10 / (n - 1)::DOUBLE)) AS decile FROM (SELECT *, row_number() OVER (PARTITION BY eom ORDER BY adv_6m, entity) AS rn, count(*) OVER (PARTITION BY eom) AS n FROM uni)) USING (eom, entity) "
    "GROUP BY eom, method",
    HELD,
)
def weight_share(spark, sf_dir):
    deciles = windows.liquidity_decile(
        base.universe(spark, sf_dir), "adv_6m", base.bound(spark, sf_dir)
    ).select("eom", "entity", "decile")
    rows = base.held(spark, sf_dir).join(deciles, ["eom", "entity"])
    weight = F.abs("weight")
    return rows.groupBy("eom", "method").agg(
        performance.weight_share(F.col("decile"), 1, weight).alias("low_share"),
        performance.weight_share(F.col("decile"), 10, weight).alias("high_share"),
    )
