"""Portfolio weights from predictions, costs and diagonal risk, one row per entity-month."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from crosspanel import settings as S
from crosspanel.operators import ranks


def equal_weight(df: DataFrame, output: str = "weight") -> DataFrame:
    counts = df.groupBy("eom").agg(F.count(F.lit(1)).alias("__names"))
    return ranks.attach(df, counts, ["eom"]).withColumn(output, F.lit(1.0) / F.col("__names")).drop("__names")


def value_weight(df: DataFrame, cap: str = "lag_mktcap", output: str = "weight") -> DataFrame:
    """Share of the month's positive caps; a month without any gets equal weights."""
    ok = F.coalesce(F.col(cap) > 0, F.lit(False))
    sums = df.groupBy("eom").agg(
        F.count(F.lit(1)).alias("__names"), F.sum(F.when(ok, F.col(cap))).alias("__caps")
    )
    share = F.when(ok, F.col(cap) / F.col("__caps")).otherwise(0.0)
    fallback = F.lit(1.0) / F.col("__names")
    return (
        ranks.attach(df, sums, ["eom"])
        .withColumn(output, F.when(F.col("__caps") > 0, share).otherwise(fallback))
        .drop("__names", "__caps")
    )


def rank_long_short(
    df: DataFrame,
    prediction: str,
    gross: float | Column = 1.0,
    output: str = "weight",
    group_rows: int | None = None,
    by: Sequence[str] = ("eom",),
) -> DataFrame:
    """Ordinal rank (ties by entity), centred, scaled to the wished gross leverage.

    The centred ranks of n names are fixed by n alone: mean (n+1)/2 and absolute sum floor(n*n/2)/2.
    """
    ranked = ranks.ordinal_rank(
        df, by, [F.col(prediction), F.col("entity")], "__rn", group_rows, count="__names"
    )
    n = F.col("__names")
    centred = F.col("__rn") - (n + 1) / F.lit(2.0)
    total = F.floor(n * n / F.lit(2.0)) / F.lit(2.0)
    leverage = gross if isinstance(gross, Column) else F.lit(float(gross))
    weight = F.when(total > 0, centred * (leverage / total)).otherwise(0.0)
    return ranked.withColumn(output, weight).drop("__rn", "__names")


def top_bottom(
    df: DataFrame,
    prediction: str,
    fraction: float | Column = 0.1,
    output: str = "weight",
    group_rows: int | None = None,
    by: Sequence[str] = ("eom",),
) -> DataFrame:
    """Half a unit spread over the highest names and minus half over the lowest."""
    ranked = ranks.ordinal_rank(
        df, by, [F.col(prediction), F.col("entity")], "__rn", group_rows, count="__names"
    )
    part = fraction if isinstance(fraction, Column) else F.lit(float(fraction))
    k = F.greatest(F.lit(1).cast("bigint"), F.floor(F.col("__names") * part))
    weight = (
        F.when(F.col("__rn") > F.col("__names") - k, F.lit(0.5) / k)
        .when(F.col("__rn") <= k, F.lit(-0.5) / k)
        .otherwise(0.0)
    )
    return ranked.withColumn(output, weight).drop("__rn", "__names")


def cap_leverage(df: DataFrame, limit: float, weight: str = "weight", by: Sequence[str] = ("eom",)) -> DataFrame:
    """Scale a month down to ``limit`` when its absolute weights exceed it."""
    sums = df.groupBy(*by).agg(F.sum(F.abs(weight)).alias("__lev"))
    factor = F.when(F.col("__lev") > limit, F.lit(float(limit)) / F.col("__lev")).otherwise(1.0)
    return ranks.attach(df, sums, by).withColumn(weight, F.col(weight) * factor).drop("__lev")


def markowitz(
    df: DataFrame,
    mu: str,
    variance: str,
    gamma: float = S.GAMMA,
    ridge: float = S.COVARIANCE_RIDGE,
    max_leverage: float | None = None,
    output: str = "weight",
) -> DataFrame:
    """Mean-variance weights under diagonal risk: mu / (gamma * (variance + ridge))."""
    out = df.withColumn(output, F.col(mu) / (F.lit(gamma) * (F.col(variance) + F.lit(ridge))))
    return cap_leverage(out, max_leverage, output) if max_leverage is not None else out


def static_terms(
    mu: Column,
    variance: Column,
    lam: Column,
    gamma: Column | float,
    aum: Column | float,
    phi: Column | float,
    shrinkage: Column | float,
    ridge: float = S.COVARIANCE_RIDGE,
) -> tuple[Column, Column]:
    """Static-ML under diagonal risk as w = a + b * inherited."""
    pull = F.lit(aum) / F.lit(phi) * lam
    lhs = F.lit(gamma) * (variance + F.lit(ridge)) + pull
    return F.lit(shrinkage) * mu / lhs, pull / lhs


def static_star_terms(
    mu: Column,
    variance: Column,
    lam: Column,
    gamma: Column | float,
    aum: Column | float,
    u: Column | float,
    v: Column | float,
    k: Column | float,
    ridge: float = S.COVARIANCE_RIDGE,
) -> tuple[Column, Column]:
    """The adjusted static policy under diagonal risk as w = a + b * inherited."""
    pull = F.lit(aum) * F.lit(k) * lam
    lhs = F.lit(gamma) * (variance * (F.lit(1.0) + F.lit(v)) + F.lit(ridge)) + pull
    return F.lit(u) * mu / lhs, pull / lhs


def trading_speed(
    variance: Column,
    lam: Column,
    gamma: Column | float = S.GAMMA,
    aum: Column | float = S.AUM,
    expected_market_return: float = S.EXPECTED_MARKET_RETURN,
    risk_free_rate: float = S.RISK_FREE_RATE,
    updates: int = S.SPEED_UPDATES,
) -> Column:
    """Share m of the inherited position that is kept, under diagonal risk; 0 when nothing costs.

    With risk per unit of cost r and the growth of an unhedged position c = 1 + variance / growth^2, the
    optimality condition is m (r + 1 + c - c m) = 1.  It is solved by ``updates`` substitutions from the share
    without growth risk (c = 1), whose smaller root of m^2 - (r + 2) m + 1 is written without a difference of
    close numbers, so that a large r keeps its digits.
    """
    r = F.lit(gamma) * variance / (F.lit(aum) * lam)
    c = F.lit(1.0) + variance / F.lit((1.0 + expected_market_return + risk_free_rate) ** 2)
    without_growth = F.lit(2.0) / (r + 2.0 + F.sqrt(r * (r + 4.0)))
    kept = F.aggregate(
        F.array_repeat(F.lit(1), updates), without_growth, lambda m, _: F.lit(1.0) / (r + 1.0 + (F.lit(1.0) - m) * c)
    )
    return F.when(F.lit(aum) == 0, F.lit(0.0)).otherwise(kept)
