"""Diagonal and factored risk, portfolio variance, decomposition, calibration and gates.

Covariance is never formed between entities.  A month's factor covariance is a K x K nested array on a
calendar-sized table that is broadcast; entity and portfolio variances are row expressions and sums.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from crosspanel import settings as S
from crosspanel.functions import scalars as X
from crosspanel.operators import joins, performance, ranks, scaling


def diagonal_risk(
    df: DataFrame, volatility: str = "vol_12m", floor: float = S.VARIANCE_FLOOR, group_rows: int | None = None
) -> DataFrame:
    """Squared volatility, month median where it is missing, floored; ``variance_imputed`` marks those."""
    filled = scaling.impute_median(df, volatility, "__vol", group_rows=group_rows, default=floor**0.5)
    return filled.withColumn("variance", F.greatest(F.col("__vol") ** 2, F.lit(floor))).withColumnRenamed(
        "__vol_imputed", "variance_imputed"
    ).drop("__vol")


def covariance_matrices(
    cov: DataFrame, factors: Sequence[str], by: Sequence[str] = ("eom",), multiplier: float = S.DAILY_TO_MONTHLY
) -> DataFrame:
    """Long factor covariances to one nested array per month, rows and columns in ``factors`` order."""
    full = joins.symmetric_covariance(cov, by).where(
        F.col("factor_1").isin(list(factors)) & F.col("factor_2").isin(list(factors))
    )
    cells = F.map_from_entries(
        F.collect_list(F.struct(F.concat_ws("|", "factor_1", "factor_2"), F.col("covariance") * F.lit(multiplier)))
    )
    names = F.array(*[F.lit(f) for f in factors])
    matrix = F.transform(
        names,
        lambda a: F.transform(
            names, lambda b: F.coalesce(F.try_element_at("__cells", F.concat_ws("|", a, b)), F.lit(0.0))
        ),
    )
    return full.groupBy(*by).agg(cells.alias("__cells")).select(*by, matrix.alias("factor_cov"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, v: acc + v)


def quadratic(b: Column, matrix: Column) -> Column:
    """b'Mb of an array and a nested array."""
    return dot(b, F.transform(matrix, lambda row: dot(row, b)))


def factor_risk(
    panel: DataFrame,
    exposures: DataFrame,
    idio: DataFrame,
    factors: Sequence[str],
    on: Sequence[str] = ("eom", "entity"),
    multiplier: float = S.DAILY_TO_MONTHLY,
    group_rows: int | None = None,
) -> DataFrame:
    """Factored risk rows: loadings array and monthly idiosyncratic variance, median-imputed.

    ``no_exposure`` marks names without exposures; ``idio_imputed`` those whose variance was filled.
    """
    loads = exposures.select(*on, loadings_of(factors).alias("loadings"))
    rows = panel.join(loads, list(on), "left").join(idio.select(*on, "idio_var"), list(on), "left")
    return _with_idio_variance(rows, multiplier, group_rows)


def own_factor_risk(
    panel: DataFrame,
    exposures: Mapping[str, Column],
    idio_var: Column,
    factors: Sequence[str],
    multiplier: float = S.DAILY_TO_MONTHLY,
    group_rows: int | None = None,
) -> DataFrame:
    """``factor_risk`` of a panel whose own columns give its exposures and variances: nothing is joined or shuffled by name."""
    rows = panel.withColumns({"loadings": loadings_of([exposures[f] for f in factors]), "idio_var": idio_var})
    return _with_idio_variance(rows, multiplier, group_rows)


def loadings_of(factors: Sequence[str | Column]) -> Column:
    columns = [F.col(f) if isinstance(f, str) else f for f in factors]
    return F.array(*[F.coalesce(c.cast("double"), F.lit(0.0)) for c in columns])


def _with_idio_variance(rows: DataFrame, multiplier: float, group_rows: int | None) -> DataFrame:
    filled = scaling.impute_median(rows, "idio_var", "__idio", group_rows=group_rows)
    return (
        filled.withColumn("no_exposure", F.col("loadings").isNull())
        .withColumn("idio_variance", F.col("__idio") * F.lit(multiplier))
        .withColumnRenamed("__idio_imputed", "idio_imputed")
        .drop("__idio", "idio_var")
    )


def risk_coverage(rows: DataFrame, cov: DataFrame, max_missing: float = S.MAX_IDIO_MISSING) -> DataFrame:
    """Is a month's factor risk usable, and why not."""
    counts = rows.groupBy("eom").agg(
        F.count(F.lit(1)).alias("names"),
        F.count_if("no_exposure").alias("missing_exposures"),
        F.count_if("idio_imputed").alias("missing_idio"),
        F.min("idio_variance").alias("min_idio_variance"),
    ).join(F.broadcast(cov.select("eom", F.lit(True).alias("has_cov"))), "eom", "left")
    share = F.col("missing_idio") / F.col("names")
    reason = (
        F.when(F.col("missing_exposures") > 0, "missing exposures")
        .when(F.col("has_cov").isNull(), "missing factor covariance")
        .when((share > max_missing) | F.col("min_idio_variance").isNull(), "missing idiosyncratic variance")
        .when(F.col("min_idio_variance") < S.VARIANCE_FLOOR, "idiosyncratic variance under the floor")
    )
    return counts.withColumn("reason", reason).withColumn("usable", F.col("reason").isNull()).drop("has_cov")


def entity_variance(rows: DataFrame, matrices: DataFrame, output: str = "factor_total_variance") -> DataFrame:
    """b'Fb + d of each name."""
    joined = ranks.attach(rows, matrices, ["eom"])
    return joined.withColumn(output, quadratic(F.col("loadings"), F.col("factor_cov")) + F.col("idio_variance"))


def risk_gate(
    rows: DataFrame,
    variance: str = "factor_total_variance",
    reference: str = "variance",
    group_rows: int | None = None,
) -> DataFrame:
    """Month medians of factor and diagonal variance and the model the month may use."""
    a = ranks.quantiles(rows, ["eom"], variance, {"median_variance": 0.5}, group_rows)
    b = ranks.quantiles(rows, ["eom"], reference, {"median_reference": 0.5}, group_rows)
    both = a.join(b, "eom")
    ratio = F.col("median_variance") / F.greatest(F.col("median_reference"), F.lit(S.VARIANCE_FLOOR))
    annual = F.sqrt(F.lit(12.0) * F.col("median_variance"))
    bad = (F.col("variance_ratio") > S.VARIANCE_RATIO_MAX) | (F.col("annual_volatility") > S.ANNUAL_VOL_MAX)
    return both.withColumns({"variance_ratio": ratio, "annual_volatility": annual}).withColumns(
        {
            "used_model": F.when(F.coalesce(bad, F.lit(True)), "diagonal").otherwise("factor"),
            "fallback_reason": F.when(F.coalesce(bad, F.lit(True)), "factor covariance failed the scale gate"),
        }
    )


def gated_variance(rows: DataFrame, gate: DataFrame) -> DataFrame:
    """Use the diagonal variance in months whose factor model fell back."""
    joined = ranks.attach(rows, gate.select("eom", "used_model"), ["eom"])
    return joined.withColumn(
        "used_variance",
        F.when(F.col("used_model") == "factor", F.col("factor_total_variance")).otherwise(F.col("variance")),
    )


def portfolio_exposures(held: DataFrame, factors: Sequence[str], by: Sequence[str] = ("eom", "method")) -> DataFrame:
    """f = B'w and w'Dw as plain sums: one combined pass over the holdings."""
    w = F.col("weight")
    exposure = [F.sum(w * F.element_at("loadings", i + 1)) for i in range(len(factors))]
    return held.groupBy(*by).agg(
        F.array(*exposure).alias("exposure"), F.sum(w * w * F.col("idio_variance")).alias("idio_part")
    )


def portfolio_variance(held: DataFrame, matrices: DataFrame, factors: Sequence[str], by=("eom", "method")) -> DataFrame:
    """Factor and idiosyncratic parts of w'(BFB'+D)w."""
    rows = ranks.attach(portfolio_exposures(held, factors, by), matrices, ["eom"])
    factor = F.greatest(quadratic(F.col("exposure"), F.col("factor_cov")), F.lit(0.0))
    out = rows.withColumn("factor_variance", factor).withColumn("idio_variance", F.greatest("idio_part", F.lit(0.0)))
    return out.withColumn(
        "ex_ante_monthly_variance", F.col("factor_variance") + F.col("idio_variance")
    ).withColumn("annual_volatility", F.sqrt(F.lit(12.0) * F.col("ex_ante_monthly_variance"))).drop("factor_cov", "idio_part")


def risk_decomposition(variances: DataFrame, factors: Sequence[str]) -> DataFrame:
    """Shares, exposure norms by factor family and the dominant factor of each month."""
    def norm(keep):
        picks = [i for i, f in enumerate(factors) if keep(f)]
        if not picks:
            return F.lit(0.0)
        total = F.lit(0.0)
        for i in picks:
            total = total + F.element_at("exposure", i + 1) ** 2
        return F.sqrt(total)

    sizes = F.transform("exposure", lambda v: F.abs(v))
    names = F.array(*[F.lit(f) for f in factors])
    top = F.element_at(names, F.array_position(sizes, F.array_max(sizes)).cast("int"))
    total = F.col("ex_ante_monthly_variance")
    intercept = (
        F.abs(F.element_at("exposure", list(factors).index("intercept") + 1))
        if "intercept" in factors
        else F.lit(None).cast("double")
    )
    return variances.withColumns(
        {
            "factor_share": F.col("factor_variance") / F.greatest(total, F.lit(1e-16)),
            "exposure_l2": norm(lambda f: True),
            "style_l2": norm(lambda f: f.startswith("rank_")),
            "industry_l2": norm(lambda f: f.startswith("industry_")),
            "intercept_abs": intercept,
            "dominant_factor": top,
        }
    )


def yearly_decomposition(monthly: DataFrame, factors: Sequence[str], returns: DataFrame) -> DataFrame:
    """Year form: annualised parts, mean norms, dominant factor, weight of the worst month."""
    rows = monthly.join(returns.select("eom", "method", "net_return", "test_year"), ["eom", "method"])
    means = [F.avg(F.abs(F.element_at("exposure", i + 1))).alias(f"__e{i}") for i in range(len(factors))]
    net = F.col("net_return")
    out = rows.groupBy("method", "test_year").agg(
        (F.lit(12.0) * F.avg("factor_variance")).alias("annual_factor_variance"),
        (F.lit(12.0) * F.avg("idio_variance")).alias("annual_idio_variance"),
        (F.sum("factor_variance") / F.greatest(F.sum("ex_ante_monthly_variance"), F.lit(1e-16))).alias("factor_share"),
        F.avg("exposure_l2").alias("exposure_l2_mean"),
        F.max("exposure_l2").alias("exposure_l2_max"),
        F.avg("style_l2").alias("style_l2_mean"),
        F.max(F.abs(net)).alias("max_abs_net_return"),
        F.collect_list(net).alias("__net"),
        F.avg(net).alias("__mean"),
        *means,
    )
    squares = F.transform("__net", lambda v: F.pow(v - F.col("__mean"), F.lit(2.0)))
    share = F.array_max(squares) / F.greatest(
        F.aggregate(squares, F.lit(0.0), lambda a, v: a + v), F.lit(1e-16)
    )
    sizes = F.array(*[F.col(f"__e{i}") for i in range(len(factors))])
    names = F.array(*[F.lit(f) for f in factors])
    return out.withColumns(
        {
            "largest_month_share": share,
            "dominant_factor": F.element_at(names, F.array_position(sizes, F.array_max(sizes)).cast("int")),
            "dominant_exposure": F.array_max(sizes),
        }
    ).drop("__net", "__mean", *[f"__e{i}" for i in range(len(factors))])


def risk_calibration(returns: DataFrame, by: Sequence[str]) -> DataFrame:
    """Predicted against realised volatility."""
    predicted = F.sqrt(F.lit(12.0) * F.avg("ex_ante_monthly_variance"))
    gross = F.sqrt(F.lit(12.0)) * F.stddev_samp("gross_return")
    return returns.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_months"),
        predicted.alias("predicted"),
        gross.alias("realized_gross"),
        (F.sqrt(F.lit(12.0)) * F.stddev_samp("net_return")).alias("realized_net"),
        F.when(predicted > 0, gross / predicted).alias("ratio"),
        (gross - predicted).alias("error"),
    )


def fallback_counts(returns: DataFrame, by: Sequence[str] = ("method",)) -> DataFrame:
    """Months that did not use the factor model, and repairs."""
    return returns.groupBy(*by).agg(
        F.count_if((F.col("risk_model_used") != "factor") | F.col("risk_fallback_reason").isNotNull()).alias("fallbacks"),
        F.sum("covariance_repair_count").alias("repairs"),
    )


def calibration_report(returns: DataFrame, by: Sequence[str] = ("method",)) -> DataFrame:
    """Year, full and summary rows with the quality gate, from one grouping-sets pass."""
    keys, year = [F.col(c) for c in by], F.col("test_year")
    predicted = F.sqrt(F.lit(12.0) * F.avg("ex_ante_monthly_variance"))
    realized = F.sqrt(F.lit(12.0)) * F.stddev_samp("net_return")
    rows = returns.groupingSets([[*keys, year], keys], *keys, year).agg(
        F.grouping(year).alias("__full"),
        F.count(F.lit(1)).alias("n_months"),
        predicted.alias("predicted"),
        realized.alias("realized"),
        F.when(predicted > 0, realized / predicted).alias("ratio"),
        F.count_if((F.col("risk_model_used") != "factor") | F.col("risk_fallback_reason").isNotNull()).alias("fallbacks"),
        F.sum("covariance_repair_count").alias("repairs"),
        F.min("covariance_min_eigenvalue").alias("min_eigenvalue"),
        F.max("covariance_condition_number").alias("condition_number"),
    ).withColumn("scope", F.when(F.col("__full") == 1, "full").otherwise("year"))
    years, full = rows.where("scope = 'year'"), rows.where("scope = 'full'")
    ratio = F.col("ratio")
    spread = years.groupBy(*by).agg(
        F.percentile("ratio", F.lit(0.5)).alias("ratio_median"),
        F.percentile("ratio", F.lit(0.1)).alias("ratio_p10"),
        F.percentile("ratio", F.lit(0.9)).alias("ratio_p90"),
        F.max("ratio").alias("ratio_max"),
        F.avg(ratio.between(*S.RATIO_WITHIN).cast("double")).alias("within_share"),
        F.count_if(ratio > S.RATIO_BREACH).alias("above_two"),
        F.count("ratio").alias("__years"),
    )
    allowed = F.greatest(F.lit(1).cast("bigint"), F.ceil(F.lit(S.BREACH_YEARS) * F.col("__years")))
    passed = (
        (F.col("__years") > 0)
        & F.col("ratio_median").between(*S.RATIO_MEDIAN)
        & (F.col("within_share") >= S.WITHIN_SHARE)
        & (F.col("above_two") <= allowed)
        & (F.col("fallbacks") == 0)
    )
    summary = full.drop("predicted", "realized", "ratio").join(F.broadcast(spread), list(by)).withColumns(
        {"scope": F.lit("summary"), "passed": F.coalesce(passed, F.lit(False))}
    ).drop("__years")
    return joins.union_frames(rows, summary).drop("__full")


def breach_source(yearly: DataFrame) -> DataFrame:
    """Why a year's realised volatility was over twice the predicted one.

    Needs method, ratio, leverage and factor_share per year.
    """
    breach = F.col("ratio") > S.RATIO_BREACH
    normal = yearly.groupBy("method").agg(
        F.percentile(F.when(~breach, F.col("leverage")), F.lit(0.5)).alias("__normal")
    )
    limit = F.lit(S.LEVERAGE_BREACH) * F.greatest(F.col("__normal"), F.lit(S.NORM_FLOOR))
    source = (
        F.when(~breach, S.SOURCE_NONE)
        .when(F.col("leverage") > limit, S.SOURCE_SCALING)
        .when(F.col("factor_share") >= S.FACTOR_SHARE, S.SOURCE_FACTOR)
        .otherwise(S.SOURCE_IDIO)
    )
    return yearly.join(F.broadcast(normal), "method").withColumn("risk_failure_source", source).drop("__normal")


def risk_quality(monthly: DataFrame, factor_returns: DataFrame, limit: float = 0.25) -> DataFrame:
    """Usable months, tail of factor returns, predicted and realised equal-weight volatility, verdict.

    ``monthly`` has used_model, predicted_volatility, median_asset_volatility, equal_weight_return.
    """
    tail = ranks.quantiles(
        factor_returns.withColumn("__abs", F.abs("factor_return")), [], "__abs", {"p50": 0.5, "p999": 0.999}
    )
    out = monthly.agg(
        F.count(F.lit(1)).alias("months"),
        F.avg((F.col("used_model") == "factor").cast("double")).alias("usable_share"),
        F.count_if(F.col("used_model") != "factor").alias("fallback_months"),
        F.avg("predicted_volatility").alias("predicted"),
        (F.sqrt(F.lit(12.0)) * F.stddev_samp("equal_weight_return")).alias("realized"),
        F.percentile("median_asset_volatility", F.lit(0.5)).alias("median_asset_volatility"),
    ).join(F.broadcast(tail))
    return out.withColumn(
        "ratio", F.when(F.col("predicted") > 0, F.col("realized") / F.col("predicted"))
    ).withColumn(
        "passed",
        (F.col("usable_share") >= 0.95) & (F.col("p999") <= limit) & (F.col("median_asset_volatility") <= S.ANNUAL_VOL_MAX),
    )


def scale_to_volatility(held: DataFrame, variances: DataFrame, target: float, columns: Sequence[str] = ("weight",)) -> DataFrame:
    """Scale a month's weights to a target annual volatility; no volatility gives zero."""
    annual = F.sqrt(F.lit(12.0) * F.greatest("ex_ante_monthly_variance", F.lit(0.0)))
    factor = F.when(annual > 0, F.lit(target) / annual).otherwise(0.0)
    table = variances.select("eom", "method", factor.alias("risk_scale_factor"))
    joined = ranks.attach(held, table, ["eom", "method"])
    return joined.withColumns({c: F.col(c) * F.col("risk_scale_factor") for c in columns})


def raw_profile(df: DataFrame, column: str) -> DataFrame:
    """Count, extremes, quantiles and large values of a raw daily return column."""
    value = X.finite(X.to_numeric(F.col(column).cast("string")))
    rows = df.select(value.alias("v"))
    points = ranks.quantiles(rows, [], "v", {"p001": 0.001, "p50": 0.5, "p999": 0.999})
    counts = rows.agg(
        F.count("v").alias("count"), F.min("v").alias("min"), F.max("v").alias("max"),
        F.count_if(F.abs("v") > 1).alias("abs_above_one"),
    )
    return counts.join(F.broadcast(points))


def _low_rank_solve(
    rows: DataFrame, matrices: DataFrame, d: Column, rhs: Column, k: int, gamma: float, output: str
) -> DataFrame:
    """(gamma BFB' + diag(d))^-1 rhs by month, without an entity-by-entity matrix.

    w = (rhs - B s) / d where (I + gamma F A) s = gamma F r, A = B'd^-1B and r = B'd^-1 rhs.  A and r are month
    sums; the K x K system is solved per month in a batch.
    """
    rows = rows.withColumns({"__d": d, "__rhs": rhs})
    b = [F.element_at("loadings", i + 1) for i in range(k)]
    sums = rows.groupBy("eom").agg(
        F.array(*[F.sum(b[i] * b[j] / F.col("__d")) for i in range(k) for j in range(k)]).alias("a"),
        F.array(*[F.sum(b[i] * F.col("__rhs") / F.col("__d")) for i in range(k)]).alias("r"),
    )

    @F.pandas_udf("array<double>")
    def solve(a: pd.Series, r: pd.Series, f: pd.Series) -> pd.Series:
        out = []
        for aa, rr, ff in zip(a, r, f):
            scaled = gamma * np.array([np.asarray(x, dtype=float) for x in ff])
            inner = np.asarray(aa, dtype=float).reshape(k, k)
            out.append(np.linalg.solve(np.eye(k) + scaled @ inner, scaled @ np.asarray(rr, dtype=float)))
        return pd.Series(out)

    solved = sums.join(F.broadcast(matrices), "eom").select("eom", solve("a", "r", "factor_cov").alias("__s"))
    joined = ranks.attach(rows, solved, ["eom"])
    weight = (F.col("__rhs") - dot(F.col("loadings"), F.col("__s"))) / F.col("__d")
    return joined.withColumn(output, weight).drop("__s", "__d", "__rhs")


def markowitz_factored(
    rows: DataFrame, matrices: DataFrame, mu: str, factors: Sequence[str], gamma: float = S.GAMMA,
    ridge: float = S.COVARIANCE_RIDGE, output: str = "weight",
) -> DataFrame:
    """(gamma (BFB' + D + ridge I))^-1 mu."""
    d = F.lit(gamma) * (F.col("idio_variance") + F.lit(ridge))
    return _low_rank_solve(rows, matrices, d, F.col(mu), len(factors), gamma, output)


def static_factored(
    rows: DataFrame, matrices: DataFrame, mu: str, inherited: str, factors: Sequence[str], return_scale: float,
    cost_scale: float, diagonal_shrinkage: float = 0.0, gamma: float = S.GAMMA, aum: float = S.AUM,
    ridge: float = S.COVARIANCE_RIDGE, output: str = "weight",
) -> DataFrame:
    """The static policies with inherited weights, under factored risk S = BFB' + D.

    Solves (gamma (S + v diag(S) + ridge I) + A c L) w = s mu + A c L inherited, where ``rows`` has loadings,
    idio_variance, factor_total_variance (the diagonal of S) and lambda_adv (L).  With v = 0 and c = 1 / phi it is
    the static policy, else the adjusted one.
    """
    pull = F.lit(aum) * F.lit(cost_scale) * F.col("lambda_adv")
    own = F.col("idio_variance") + F.lit(diagonal_shrinkage) * F.col("factor_total_variance") + F.lit(ridge)
    rhs = F.lit(return_scale) * F.col(mu) + pull * F.col(inherited)
    return _low_rank_solve(rows, matrices, F.lit(gamma) * own + pull, rhs, len(factors), gamma, output)
