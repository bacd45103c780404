"""Newey-West, block bootstrap and yearly attribution of monthly series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from crosspanel import settings as S
from crosspanel.functions import scalars as X
from crosspanel.operators import joins, performance

# The outcome columns of a method comparison, in report order.
OUTCOMES = (
    "gross_return", "trading_cost", "net_return", "risk_penalty", "utility_flow", "turnover", "leverage",
)

PARTS = 32  # shares of a series' replications


def newey_west(
    df: DataFrame, value: str, lags: int, by: Sequence[str], order: str, full_weight: bool = False
) -> DataFrame:
    """Mean, robust standard error and t statistic of each monthly series (Bartlett weights).

    Autocovariances divide by n and lags stop at n-1.  ``full_weight`` keeps the weight of the asked
    lag number even where the series is too short for it.  Windows run over one series.
    """
    series = W.partitionBy(*by)
    rows = df.where(F.col(value).isNotNull()).withColumn("__c", F.col(value) - F.avg(value).over(series))
    path = series.orderBy(order)
    rows = rows.withColumns({f"__c{k}": F.lag("__c", k).over(path) for k in range(1, lags + 1)})
    n = F.count(F.lit(1))
    used = F.lit(lags) if full_weight else F.least(F.lit(lags), n - 1)
    total = F.sum(F.col("__c") ** 2) / n
    for k in range(1, lags + 1):
        weight = F.greatest(F.lit(1.0) - F.lit(float(k)) / (used + 1), F.lit(0.0))
        total = total + F.coalesce(F.lit(2.0) * weight * F.sum(F.col("__c") * F.col(f"__c{k}")) / n, F.lit(0.0))
    sums = rows.groupBy(*by).agg(
        n.alias("n"), F.avg(value).alias("mean"),
        F.sqrt(F.greatest(total, F.lit(0.0)) / n).alias("nw_se"),
        F.least(F.lit(lags), n - 1).cast("int").alias("lags"),
    )
    return sums.withColumn("nw_t", F.when(F.col("nw_se") > 0, F.col("mean") / F.col("nw_se")))


def t_stat(df: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    sd = F.stddev_samp(value)
    n = F.count(value)
    return df.groupBy(*by).agg(
        n.alias("n"), F.avg(value).alias("mean"),
        F.when(sd > 0, F.avg(value) / (sd / F.sqrt(n.cast("double")))).alias("t_stat"),
    )


def block_bootstrap(
    df: DataFrame,
    value: str,
    by: Sequence[str],
    order: str,
    block: int = S.BOOTSTRAP_BLOCK,
    replications: int = S.BOOTSTRAP_REPLICATIONS,
    seed: int | str = 0,
) -> DataFrame:
    """Circular block bootstrap of the mean: percentile interval and share of positive means.

    Each series becomes one array; replications are rows, dealt in ``PARTS`` shares so that the draws of a single
    series run on many tasks while its array is sent once a share.  Block starts come from a digest of (seed,
    replication, block), so a rerun on another executor draws the same blocks.  Only series that are
    one value per month belong here.  ``seed`` is a number, or one of ``by`` that holds each series' own.
    """
    pair = F.when(F.col(value).isNotNull(), F.struct(F.col(order).alias("o"), F.col(value).alias("v")))
    series = df.groupBy(*by).agg(
        F.transform(F.array_sort(F.collect_list(pair)), lambda p: p["v"]).alias("s")
    ).where(F.size("s") > 0)
    n = F.size("s")
    width = F.least(F.lit(block), n)
    blocks = F.ceil(n / width).cast("int")

    def start(b: Column) -> Column:
        own = F.col(seed).cast("string") if isinstance(seed, str) else F.lit(str(seed))
        text = F.concat_ws("|", own, F.col("rep").cast("string"), b.cast("string"))
        return F.pmod(F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint"), n)

    shares = series.withColumn("part", F.explode(F.sequence(F.lit(1), F.lit(min(PARTS, replications)))))
    shares = shares.repartition(PARTS, *by, "part")
    reps = shares.withColumn("rep", F.explode(F.sequence("part", F.lit(replications), F.lit(PARTS))))
    starts = F.transform(F.sequence(F.lit(0), blocks - 1), start)
    drawn = F.transform(
        starts,
        lambda at: F.transform(
            F.sequence(F.lit(0), width - 1),
            lambda i: F.element_at("s", (F.pmod(at + i, n) + 1).cast("int")),
        ),
    )
    draws = F.slice(F.flatten(drawn), F.lit(1), n)
    mean = F.aggregate(draws, F.lit(0.0), lambda a, v: a + v) / n
    means = reps.select(*by, mean.alias("m"))
    return means.groupBy(*by).agg(
        F.percentile("m", F.lit(0.025)).alias("ci_lower"),
        F.percentile("m", F.lit(0.975)).alias("ci_upper"),
        F.avg((F.col("m") > 0).cast("double")).alias("probability_positive"),
        F.count(F.lit(1)).alias("replications"),
    )


def method_differences(
    returns: DataFrame, pairs: Sequence[tuple[str, str]], gamma: float = S.GAMMA, fields: Sequence[str] = OUTCOMES
) -> DataFrame:
    """Monthly candidate minus benchmark for each outcome, as it is: small differences are not rounded to zero."""
    penalty = F.lit(0.5 * gamma) * F.col("ex_ante_monthly_variance")
    return joins.method_pairs(returns.withColumn("risk_penalty", penalty), pairs, fields, rounding=0.0)


def identity_error(differences: DataFrame) -> DataFrame:
    """Net difference minus risk difference must equal the utility difference."""
    gap = F.abs(F.col("delta_net_return") - F.col("delta_risk_penalty") - F.col("delta_utility_flow"))
    return differences.groupBy("candidate_method", "benchmark_method").agg(
        F.max(gap).alias("max_error"), (F.max(gap) <= 1e-10).alias("passed"),
        F.count_if(~F.col("years_agree")).alias("year_disagreements"),
    )


PAIR = ("candidate_method", "benchmark_method")


def long_outcomes(differences: DataFrame, fields: Sequence[str] = OUTCOMES, extra: Sequence[str] = ()) -> DataFrame:
    items = F.array(
        *[F.struct(F.lit(f).alias("outcome"), F.col(f"delta_{f}").alias("delta")) for f in fields]
    )
    return differences.select("eom", "test_year", *extra, *PAIR, F.inline(items))


def annual_delta(differences: DataFrame) -> DataFrame:
    """Year sums and annualised means of each outcome."""
    return long_outcomes(differences).groupBy(*PAIR, "outcome", "test_year").agg(
        F.count("delta").alias("n_months"),
        F.sum("delta").alias("annual_sum"),
        (F.lit(12.0) * F.avg("delta")).alias("annualized_mean"),
    )


def inference(
    differences: DataFrame,
    lags: int = S.HAC_LAGS,
    block: int = S.BOOTSTRAP_BLOCK,
    replications: int = S.BOOTSTRAP_REPLICATIONS,
    seed: int = 0,
    bootstrap: bool = True,
) -> DataFrame:
    """One row per method pair and outcome: mean, robust test, bootstrap, years won."""
    keys = [*PAIR, "outcome"]
    long = long_outcomes(differences)
    robust = newey_west(long, "delta", lags, keys, "eom")
    years = annual_delta(differences).groupBy(*keys).agg(
        F.percentile("annual_sum", F.lit(0.5)).alias("median_annual"),
        F.count_if(F.col("annual_sum") > 0).alias("years_won"),
        F.count(F.lit(1)).alias("years_total"),
        F.sum("annual_sum").alias("cumulative"),
    )
    out = robust.join(years, keys).withColumns(
        {"annualized_mean": F.lit(12.0) * F.col("mean"), "annualized_se": F.lit(12.0) * F.col("nw_se")}
    )
    if bootstrap:
        drawn = block_bootstrap(long, "delta", keys, "eom", block, replications, seed)
        out = out.join(drawn, keys).withColumns(
            {"ci_lower": F.lit(12.0) * F.col("ci_lower"), "ci_upper": F.lit(12.0) * F.col("ci_upper")}
        )
    return out


def concentration(differences: DataFrame, named_years: Sequence[int] = ()) -> DataFrame:
    """How much of the gain comes from few years: wins, top shares, best and worst, named years."""
    keys = [*PAIR, "outcome"]
    annual = annual_delta(differences)
    shares = performance.positive_topk_share(annual, keys, "annual_sum")
    best = performance.best_worst(annual, keys, "annual_sum", "test_year")
    wins = annual.groupBy(*keys).agg(
        F.count_if(F.col("annual_sum") > 0).alias("years_won"),
        F.count(F.lit(1)).alias("years_total"),
        *[F.sum(F.when(F.col("test_year") == y, F.col("annual_sum"))).alias(f"year_{y}") for y in named_years],
    )
    return wins.join(shares, keys).join(best, keys)


def period_attribution(differences: DataFrame, label: Column) -> DataFrame:
    """Year sums by calendar bucket, and the monthly hit rate."""
    long = long_outcomes(differences).withColumn("period", label)
    return long.groupBy(*PAIR, "outcome", "period").agg(
        F.count("delta").alias("n_months"),
        F.sum("delta").alias("total"),
        (F.lit(12.0) * F.avg("delta")).alias("annualized_mean"),
        F.avg((F.col("delta") > 0).cast("double")).alias("positive_month_share"),
    )


def yearly_attribution(returns: DataFrame, selection: DataFrame | None, gamma: float = S.GAMMA) -> DataFrame:
    """Yearly metrics with predicted and realised volatility, period and the chosen parameters."""
    predicted = F.sqrt(F.lit(12.0) * F.avg("ex_ante_monthly_variance"))
    risk = returns.groupBy("method", "test_year").agg(predicted.alias("predicted_volatility"))
    out = performance.performance(returns, gamma, ["method", "test_year"]).join(risk, ["method", "test_year"])
    out = out.withColumn("period", X.five_year_period(F.col("test_year"))).withColumn(
        "realized_to_predicted",
        F.when(F.col("predicted_volatility") > 0, F.col("annualized_volatility") / F.col("predicted_volatility")),
    )
    if selection is not None:
        chosen = selection.where("selected").select("method", "test_year", "parameters")
        out = out.join(chosen, ["method", "test_year"], "left")
        out = out.withColumn("parameters", F.coalesce("parameters", F.lit("prediction_mse_only")))
    return out


def samples(df: DataFrame, excluded: dict[str, Sequence[int]]) -> DataFrame:
    """Each row once per named sample that keeps its year."""
    items = F.array(
        *[
            F.struct(F.lit(name).alias("sample"), F.array(*[F.lit(int(y)) for y in years]).cast("array<int>").alias("__out"))
            for name, years in excluded.items()
        ]
    )
    rows = df.select("*", F.inline(items))
    return rows.where(~F.array_contains("__out", F.col("test_year"))).drop("__out")


def sample_inference(
    differences: DataFrame,
    excluded: dict[str, Sequence[int]],
    fields: Sequence[str] = ("utility_flow",),
    lags: int = S.HAC_LAGS,
    block: int = S.BOOTSTRAP_BLOCK,
    replications: int = S.BOOTSTRAP_REPLICATIONS,
    seed: int = 0,
) -> DataFrame:
    """Inference on each sample that leaves years out: mean, robust test, bootstrap, years won.

    The months left are one series, in order: lags and blocks go on over a year that is cut out.  Sample i in the
    order given draws with ``seed + i``.  A sample that keeps no month of a pair has no row for it.
    """
    items = F.create_map(*[F.lit(v) for i, name in enumerate(excluded) for v in (name, seed + i)])
    rows = samples(differences, excluded).withColumn("seed", F.try_element_at(items, F.col("sample")))
    keys = ["sample", "seed", *PAIR, "outcome"]
    long = long_outcomes(rows, fields, ("sample", "seed"))
    years = long.groupBy(*keys, "test_year").agg(F.sum("delta").alias("year"))
    won = years.groupBy(*keys).agg(
        F.percentile("year", F.lit(0.5)).alias("median_annual"), F.count_if(F.col("year") > 0).alias("years_won"),
        F.count(F.lit(1)).alias("years_total"), F.sum("year").alias("cumulative"),
    )
    drawn = block_bootstrap(long, "delta", keys, "eom", block, replications, "seed")
    out = newey_west(long, "delta", lags, keys, "eom").join(won, keys).join(drawn, keys)
    return out.withColumns(
        {"annualized_mean": F.lit(12.0) * F.col("mean"), **{c: F.lit(12.0) * F.col(c) for c in ("ci_lower", "ci_upper")}}
    )


def decomposition(left: DataFrame, right: DataFrame, values: Sequence[str]) -> DataFrame:
    """Year-by-year difference between two result sets and each year's share of the positive part."""
    rows = joins.compare_wide(left, right, ["method", "test_year"], ("a", "b"))
    gain = F.greatest(F.col(f"{values[0]}_difference"), F.lit(0.0))
    total = F.sum(gain).over(W.partitionBy("method"))  # one row per year
    return rows.select(
        "method", "test_year", *[F.col(f"{v}_difference").alias(f"{v}_difference") for v in values],
        F.when(total > 0, gain / total).alias("positive_share"),
    )


def ols_hc3(df: DataFrame, y: str, x: tuple[str, str]) -> DataFrame:
    """Standardised regression on two columns of a small table, with HC3 standard errors.

    Sums give the 3x3 inverse in closed form; leverage and residual are row expressions; a second
    aggregate gives the sandwich.
    """
    names = [y, *x]
    stats = df.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.avg(c).alias(f"m_{c}") for c in names],
        *[F.stddev_samp(c).alias(f"s_{c}") for c in names],
    )
    a, b = F.col("za"), F.col("zb")
    z = df.join(F.broadcast(stats)).select(
        "n",
        ((F.col(x[0]) - F.col(f"m_{x[0]}")) / F.col(f"s_{x[0]}")).alias("za"),
        ((F.col(x[1]) - F.col(f"m_{x[1]}")) / F.col(f"s_{x[1]}")).alias("zb"),
        ((F.col(y) - F.col(f"m_{y}")) / F.col(f"s_{y}")).alias("zy"),
    )
    # Standardised columns sum to zero, so the intercept separates.
    sums = z.agg(
        F.max("n").alias("n"), F.sum(a * a).alias("aa"), F.sum(b * b).alias("bb"), F.sum(a * b).alias("ab"),
        F.sum(a * F.col("zy")).alias("ay"), F.sum(b * F.col("zy")).alias("by"),
    )
    det = F.col("aa") * F.col("bb") - F.col("ab") ** 2
    fit = sums.select(
        "n", (F.col("bb") / det).alias("iaa"), (F.col("aa") / det).alias("ibb"), (-F.col("ab") / det).alias("iab"),
        ((F.col("bb") * F.col("ay") - F.col("ab") * F.col("by")) / det).alias("ba"),
        ((F.col("aa") * F.col("by") - F.col("ab") * F.col("ay")) / det).alias("bb_"),
    )
    rows = z.drop("n").join(F.broadcast(fit))
    ua = F.col("iaa") * a + F.col("iab") * b
    ub = F.col("iab") * a + F.col("ibb") * b
    leverage = F.lit(1.0) / F.col("n") + a * ua + b * ub
    residual = F.col("zy") - F.col("ba") * a - F.col("bb_") * b
    scaled = (residual / (F.lit(1.0) - leverage)) ** 2
    return rows.agg(
        F.max("n").alias("n"), F.max("ba").alias("beta_1"), F.max("bb_").alias("beta_2"),
        F.sqrt(F.sum(scaled * ua * ua)).alias("se_1"), F.sqrt(F.sum(scaled * ub * ub)).alias("se_2"),
        F.sqrt(F.sum(scaled) / F.max(F.col("n").cast("double") ** 2)).alias("se_0"),
        (F.lit(1.0) - F.sum(residual**2) / F.sum(F.col("zy") ** 2)).alias("r2"),
    )
