"""Performance, drawdown, selection scores and result-table aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from crosspanel import settings as S
from crosspanel.operators import ranks


def drawdown_from(returns: Column) -> Column:
    """Worst drop from the running peak along an ordered return array; the peak starts at month one."""
    zero = F.struct(F.lit(1.0).alias("wealth"), F.lit(0.0).alias("peak"), F.lit(0.0).alias("worst"))

    def step(acc, r):
        wealth = acc["wealth"] * (F.lit(1.0) + F.greatest(r, F.lit(S.DRAWDOWN_CLIP)))
        peak = F.greatest(acc["peak"], wealth)
        return F.struct(
            wealth.alias("wealth"), peak.alias("peak"),
            F.least(acc["worst"], wealth / peak - 1.0).alias("worst"),
        )

    folded = F.aggregate(returns, zero, step, lambda acc: acc["worst"])
    return F.when(F.size(returns) > 0, folded)


def ordered_values(value: str, order: str) -> Column:
    """Non-null values as an array in time order: one value per month, calendar-bounded."""
    pair = F.when(F.col(value).isNotNull(), F.struct(F.col(order), F.col(value)))
    return F.transform(F.array_sort(F.collect_list(pair)), lambda p: p[value])


def max_drawdown(df: DataFrame, by: Sequence[str], value: str = "net_return", order: str = "eom") -> DataFrame:
    arrays = df.groupBy(*by).agg(ordered_values(value, order).alias("__r"))
    return arrays.select(*by, drawdown_from(F.col("__r")).alias("max_drawdown"))


def wealth_path(df: DataFrame, by: Sequence[str], value: str, order: str = "eom") -> DataFrame:
    """Cumulative return and unclipped running drawdown per month."""
    pair = F.struct(F.col(order).alias("o"), F.col(value).alias("r"))
    arrays = df.groupBy(*by).agg(F.array_sort(F.collect_list(pair)).alias("rows"))
    order_type = df.schema[order].dataType.simpleString()
    empty = F.array().cast(f"array<struct<o: {order_type}, r: double, wealth: double, peak: double>>")

    def step(acc, item):
        seen = F.size(acc) > 0
        last = F.element_at(acc, -1)
        wealth = F.when(seen, last["wealth"]).otherwise(F.lit(1.0)) * (F.lit(1.0) + item["r"])
        peak = F.when(seen, F.greatest(last["peak"], wealth)).otherwise(wealth)
        nxt = F.struct(item["o"].alias("o"), item["r"].alias("r"), wealth.alias("wealth"), peak.alias("peak"))
        return F.concat(acc, F.array(nxt))

    out = arrays.select(*by, F.inline(F.aggregate("rows", empty, step)))
    return out.select(
        *by,
        F.col("o").alias(order),
        F.col("r").alias(value),
        (F.col("wealth") - 1.0).alias("cumulative_return"),
        (F.col("wealth") / F.col("peak") - 1.0).alias("drawdown"),
    )


def _measures(gamma: float | str) -> list[Column]:
    aversion = F.max(gamma) if isinstance(gamma, str) else F.lit(float(gamma))
    net_var = F.var_samp("net_return")
    gross_vol = F.sqrt(F.lit(12.0)) * F.stddev_samp("gross_return")
    net_vol = F.sqrt(F.lit(12.0)) * F.stddev_samp("net_return")
    gross, net = F.lit(12.0) * F.avg("gross_return"), F.lit(12.0) * F.avg("net_return")
    return [
        F.count(F.lit(1)).alias("n_months"),
        gross.alias("annualized_gross_return"),
        (F.lit(12.0) * F.avg("trading_cost")).alias("annualized_trading_cost"),
        net.alias("annualized_net_return"),
        net_vol.alias("annualized_volatility"),
        gross_vol.alias("annualized_gross_volatility"),
        F.when(gross_vol > 0, gross / gross_vol).alias("gross_sharpe"),
        F.when(net_vol > 0, net / net_vol).alias("net_sharpe"),
        F.avg("turnover").alias("average_turnover"),
        F.avg("leverage").alias("average_leverage"),
        (net - F.lit(0.5) * aversion * F.lit(12.0) * net_var).alias("empirical_utility"),
        (F.lit(12.0) * F.avg("utility_flow")).alias("annualized_ex_ante_utility_flow"),
        drawdown_from(ordered_values("net_return", "eom")).alias("max_drawdown"),
    ]


def performance(returns: DataFrame, gamma: float | str = S.GAMMA, by: Sequence[str] = ("method",)) -> DataFrame:
    """Annualised metrics of a monthly return table; a ratio with no volatility is null."""
    return returns.groupBy(*by).agg(*_measures(gamma))


def performance_scopes(returns: DataFrame, gamma: float = S.GAMMA) -> DataFrame:
    """Full-sample and yearly metrics in one pass over the returns."""
    method, year = F.col("method"), F.col("test_year")
    out = returns.groupingSets([[method, year], [method]], method, year).agg(
        F.grouping(year).alias("__full"), *_measures(gamma)
    )
    return out.withColumn("scope", F.when(F.col("__full") == 1, "full").otherwise("year")).drop("__full")


def validation_utility(df: DataFrame, by: Sequence[str], gamma: float = S.GAMMA) -> DataFrame:
    """12 mean - gamma/2 * 12 variance of net returns; minus infinity below two months."""
    score = F.lit(12.0) * F.avg("net_return") - F.lit(0.5 * gamma * 12.0) * F.var_samp("net_return")
    return df.groupBy(*by).agg(
        F.when(F.count("net_return") < 2, F.lit(float("-inf"))).otherwise(score).alias("validation_utility")
    )


def selection_score(
    df: DataFrame, by: Sequence[str], static_methods: Sequence[str], gamma: float = S.GAMMA
) -> DataFrame:
    """Static policies: mean gross - mean cost - gamma/2 population variance; others mean utility flow."""
    static = (
        F.avg("gross_return") - F.avg("trading_cost") - F.lit(gamma / 2.0) * F.var_pop("gross_return")
    )
    keys = list(dict.fromkeys([*by, "method"]))
    return df.groupBy(*keys).agg(static.alias("__s"), F.avg("utility_flow").alias("__u")).select(
        *keys,
        F.when(F.col("method").isin(list(static_methods)), F.col("__s")).otherwise(F.col("__u")).alias("score"),
    )


def distribution(
    df: DataFrame, column: str, by: Sequence[str] = (), group_rows: int | None = None
) -> DataFrame:
    """Count, exact p50, p95, p99, p99.9 and maximum of the finite values."""
    value = F.col(column)
    rows = df.where(value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf")))
    points = {"p50": 0.5, "p95": 0.95, "p99": 0.99, "p999": 0.999}
    counts = [F.count(F.lit(1)).alias("count"), F.max(column).alias("max")]
    if ranks.fits_one_task(group_rows):
        exact = [F.percentile(column, F.lit(p)).alias(n) for n, p in points.items()]
        return rows.groupBy(*by).agg(*counts, *exact) if by else rows.agg(*counts, *exact)
    wide = ranks.quantiles(rows, by, column, {**points, "max": 1.0}, group_rows)
    if by:
        return wide.join(rows.groupBy(*by).agg(counts[0]), list(by))
    return wide.join(F.broadcast(rows.agg(counts[0])))


def distribution_summary(df: DataFrame, column: str, by: Sequence[str]) -> DataFrame:
    """Mean, median, sample deviation, p10 and p90 of a calendar-sized series."""
    return df.groupBy(*by).agg(
        F.avg(column).alias("mean"),
        F.percentile(column, F.lit(0.5)).alias("median"),
        F.stddev_samp(column).alias("std"),
        F.percentile(column, F.lit(0.1)).alias("p10"),
        F.percentile(column, F.lit(0.9)).alias("p90"),
    )


def weighted_average(value: Column, weight: Column) -> Column:
    """Null when the weights do not sum to something positive."""
    total = F.sum(F.when(value.isNotNull(), weight))
    return F.when(total > 0, F.sum(value * weight) / total)


def weight_share(bucket: Column, wanted, weight: Column) -> Column:
    total = F.sum(weight)
    return F.when(total > 0, F.sum(F.when(bucket == wanted, weight).otherwise(0.0)) / total)


def positive_topk_share(df: DataFrame, by: Sequence[str], value: str, ks: Sequence[int] = (1, 3, 5)) -> DataFrame:
    """Share of the k largest in the sum of positive values (result tables: one value per year)."""
    order = W.partitionBy(*by).orderBy(F.col(value).desc())
    rows = df.withColumn("__p", F.when(F.col(value) > 0, F.col(value))).withColumn(
        "__rn", F.row_number().over(order)
    )
    total = F.sum("__p")
    return rows.groupBy(*by).agg(
        *[
            F.when(total > 0, F.sum(F.when(F.col("__rn") <= k, F.col("__p"))) / total).alias(f"top_{k}_share")
            for k in ks
        ]
    )


def mode_stats(df: DataFrame, by: Sequence[str], value: str, order: str) -> DataFrame:
    """Distinct values, changes along an order, modal value and share, first and last value.

    Ties for the mode go to the smallest value, so the answer does not depend on row order.
    """
    path = W.partitionBy(*by).orderBy(order)
    changed = df.withColumn("__chg", F.col(value) != F.lag(value).over(path))
    per_value = changed.groupBy(*by, value).agg(
        F.count(F.lit(1)).alias("__n"),
        F.count_if("__chg").alias("__chg"),
        F.min(order).alias("__first"),
        F.max(order).alias("__last"),
    )
    best = F.min_by(value, F.struct(-F.col("__n"), F.col(value)))
    return per_value.groupBy(*by).agg(
        F.sum("__n").alias("rows"),
        F.count(F.lit(1)).alias("unique_values"),
        F.sum("__chg").alias("changes"),
        best.alias("modal_value"),
        (F.max("__n") / F.sum("__n")).alias("modal_share"),
        F.min_by(value, "__first").alias("first_value"),
        F.max_by(value, "__last").alias("last_value"),
    )


def change_count(df: DataFrame, by: Sequence[str], value: str, order: str) -> DataFrame:
    path = W.partitionBy(*by).orderBy(order)
    return (
        df.withColumn("__chg", F.col(value) != F.lag(value).over(path))
        .groupBy(*by)
        .agg(F.count_if("__chg").alias("changes"))
    )


def frequency(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    counts = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("uses"))
    total = df.agg(F.count(F.lit(1)).alias("total"))
    return counts.join(F.broadcast(total)).withColumn("share", F.col("uses") / F.col("total"))


def recurrence(df: DataFrame, keys: Sequence[str], breach: Column) -> DataFrame:
    """Uses and breaches of each parameter set."""
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("uses"), F.count_if(breach).alias("breaches")
    ).withColumn("breach_share", F.col("breaches") / F.col("uses"))


def best_worst(df: DataFrame, by: Sequence[str], value: str, label: str) -> DataFrame:
    """Best and worst label and value; the earlier label wins a tie."""
    return df.groupBy(*by).agg(
        F.min_by(label, F.struct(-F.col(value), F.col(label))).alias("best_year"),
        F.max(value).alias("best_value"),
        F.min_by(label, F.struct(F.col(value), F.col(label))).alias("worst_year"),
        F.min(value).alias("worst_value"),
    )


def win_years(annual: DataFrame, benchmark: str, values: Sequence[str], methods: str = "method") -> DataFrame:
    """Years in which each method beats the benchmark, for each value."""
    other = annual.where(F.col(methods) == benchmark).select(
        "test_year", *[F.col(v).alias(f"__b_{v}") for v in values]
    )
    rows = annual.where(F.col(methods) != benchmark).join(F.broadcast(other), "test_year")
    return rows.groupBy(methods).agg(
        F.count(F.lit(1)).alias("years"),
        *[F.count_if(F.col(v) > F.col(f"__b_{v}")).alias(f"wins_{v}") for v in values],
    )


def pivot_year(df: DataFrame, value: str, methods: Sequence[str], by: str = "test_year") -> DataFrame:
    """One row per year, one column per method, and each later method minus the first."""
    wide = df.groupBy(by).pivot("method", list(methods)).agg(F.first(value))
    base = methods[0]
    return wide.withColumns({f"{m}_minus_{base}": F.col(m) - F.col(base) for m in methods[1:]})


def completeness(df: DataFrame, by: Sequence[str], expected_months: int) -> DataFrame:
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_distinct("eom").alias("months"),
        F.count_distinct("test_year").alias("years"),
    ).withColumn("complete", (F.col("months") == expected_months) & (F.col("rows") == F.col("months")))


def yearly_jump(df: DataFrame, by: Sequence[str], value: str, year: str = "year") -> DataFrame:
    """Largest year-over-year change of a rate."""
    path = W.partitionBy(*by).orderBy(year)
    return (
        df.withColumn("__jump", F.abs(F.col(value) - F.lag(value).over(path)))
        .groupBy(*by)
        .agg(F.max("__jump").alias("max_jump"))
    )


def dispersion(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Monthly cross-sectional deviation, then its mean, median, p10 and near-constant share."""
    monthly = df.groupBy(*by, "eom").agg(F.stddev_samp(value).alias("__sd"))
    return monthly.groupBy(*by).agg(
        F.avg("__sd").alias("mean_std"),
        F.percentile("__sd", F.lit(0.5)).alias("median_std"),
        F.percentile("__sd", F.lit(0.1)).alias("p10_std"),
        F.avg((F.col("__sd") < 0.01).cast("double")).alias("near_constant_share"),
    )


def tie_fraction(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """1 - distinct / rows by month, averaged.  Values are pre-counted before the month is formed."""
    per_value = df.groupBy(*by, "eom", value).agg(F.count(F.lit(1)).alias("__n"))
    monthly = per_value.groupBy(*by, "eom").agg(
        (F.lit(1.0) - F.count(value) / F.sum("__n")).alias("__tie")
    )
    return monthly.groupBy(*by).agg(F.avg("__tie").alias("tie_fraction"))


def feature_coverage(long: DataFrame, by: Sequence[str]) -> DataFrame:
    """Missing and neutral-fill rates of unpivoted features (raw_value, rank_value)."""
    missing = F.col("raw_value").isNull()
    filled = missing & (F.col("rank_value") == S.NEUTRAL_RANK)
    return long.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"),
        F.avg(missing.cast("double")).alias("missing_rate"),
        F.avg(filled.cast("double")).alias("neutral_fill_rate"),
        F.when(F.count_if(missing) > 0, F.count_if(filled) / F.count_if(missing))
        .otherwise(1.0)
        .alias("fill_correct_fraction"),
    )


def unpivot_features(df: DataFrame, features: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """One row per entity-month and feature: narrow map work, no shuffle."""
    items = F.array(
        *[
            F.struct(
                F.lit(f).alias("feature"),
                F.col(f"raw_{f}").alias("raw_value"),
                F.col(f"rank_{f}").alias("rank_value"),
            )
            for f in features
        ]
    )
    return df.select(*keep, F.inline(items))


def reconcile(
    reported: DataFrame, recomputed: DataFrame, keys: Sequence[str], columns: Sequence[str], tolerance: float
) -> DataFrame:
    """Largest gap per column between two tables on the same keys; a one-sided value is infinite."""
    from crosspanel.functions.scalars import difference

    right = recomputed.select(*keys, *[F.col(c).alias(f"__r_{c}") for c in columns])
    rows = reported.select(*keys, *columns).join(right, list(keys), "full_outer")
    gaps = rows.agg(*[F.max(difference(F.col(c), F.col(f"__r_{c}"))).alias(c) for c in columns])
    items = F.array(
        *[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("max_difference")) for c in columns]
    )
    return gaps.select(F.inline(items)).withColumn("passed", F.col("max_difference") <= tolerance)


def runtime_profile(jobs: DataFrame, by: Sequence[str], seconds: str, started: str, ended: str) -> DataFrame:
    """Sum, median, p95, maximum and span of job records (one row per job, bookkeeping-sized)."""
    return jobs.groupBy(*by).agg(
        F.count(F.lit(1)).alias("jobs"),
        F.sum(seconds).alias("total_seconds"),
        F.percentile(seconds, F.lit(0.5)).alias("p50"),
        F.percentile(seconds, F.lit(0.95)).alias("p95"),
        F.max(seconds).alias("max_seconds"),
        (F.unix_micros(F.max(ended).cast("timestamp")) - F.unix_micros(F.min(started).cast("timestamp"))).alias("span_micros"),
    )


def equal_weight_return(df: DataFrame, ret: str = "ret_exc_lead1m") -> DataFrame:
    """Mean return of the month's names; the second stage annualises its deviation."""
    return df.groupBy("eom").agg(F.avg(ret).alias("equal_weight_return"))


def annualised_deviation(df: DataFrame, value: str) -> DataFrame:
    return df.agg((F.sqrt(F.lit(12.0)) * F.stddev_samp(value)).alias("annualized_volatility"))


def diagnostic_summary(df: DataFrame, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Mean, maximum and median of many columns at once; infinite values are left out of the median."""
    exprs = []
    for c in columns:
        finite = F.when(F.abs(F.col(c)) < float("inf"), F.col(c))
        exprs += [
            F.avg(c).alias(f"mean_{c}"),
            F.max(c).alias(f"max_{c}"),
            F.percentile(finite, F.lit(0.5)).alias(f"median_{c}"),
        ]
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("months"), *exprs)
