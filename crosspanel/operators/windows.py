"""Lags along an entity's months, deciles, count jumps and concentration."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from crosspanel import settings as S
from crosspanel.operators import ranks


def lag_month(df: DataFrame, columns: Sequence[str], prefix: str = "lag_") -> DataFrame:
    """Last row's value when that row is exactly one month earlier.

    The window holds one entity's months: at most one row per month.
    """
    path = W.partitionBy("entity").orderBy("month_index")
    consecutive = F.col("month_index") - F.lag("month_index").over(path) == 1
    return df.withColumns({f"{prefix}{c}": F.when(consecutive, F.lag(c).over(path)) for c in columns})


def row_lead(df: DataFrame, column: str, output: str) -> DataFrame:
    """Next row's value whatever its month; for the label audit only."""
    return df.withColumn(output, F.lead(column).over(W.partitionBy("entity").orderBy("eom")))


def liquidity_decile(df: DataFrame, column: str, group_rows: int | None = None, output: str = "decile") -> DataFrame:
    """Ten equal-count bins of the first-method rank."""
    ranked = ranks.ordinal_rank(
        df, ["eom"], [F.col(column), F.col("entity")], "__rn", group_rows, count="__names"
    )
    place = F.ceil((F.col("__rn") - 1) * 10 / F.nullif(F.col("__names") - 1, F.lit(0)))
    return ranked.withColumn(output, F.greatest(F.lit(1).cast("bigint"), F.coalesce(place, F.lit(1)))).drop(
        "__rn", "__names"
    )


def count_jumps(df: DataFrame, fraction: float) -> DataFrame:
    """Relative change of the monthly count of entities, flagged above ``fraction``."""
    counts = df.groupBy("eom").agg(F.count_distinct("entity").alias("names"))
    prior = F.lag("names").over(W.orderBy("eom"))  # one row per month
    return counts.withColumn("change", F.abs(F.col("names") / prior - 1)).withColumn(
        "jump", F.coalesce(F.col("change") > fraction, F.lit(False))
    )


def adv_lambda(
    df: DataFrame, volume: str, k: float = S.LAMBDA_MULTIPLIER, months: int = S.ADV_MONTHS
) -> DataFrame:
    """Average daily volume over the trailing calendar months, and k over it."""
    trailing = W.partitionBy("entity").orderBy("month_index").rangeBetween(-(months - 1), 0)
    return df.withColumn("adv_6m", F.avg(volume).over(trailing) / float(S.TRADING_DAYS)).withColumn(
        "lambda_adv", F.lit(k) / F.col("adv_6m")
    )


def top_share(
    df: DataFrame, by: Sequence[str], value: str, fraction: float, group_rows: int | None = None
) -> DataFrame:
    """Share of the total held by the largest names: n = max(1, ceil(fraction * names))."""
    ranked = ranks.ordinal_rank(
        df, by, [-F.col(value), F.col("entity")], "__rn", group_rows, count="__names"
    )
    top = F.col("__rn") <= F.greatest(F.lit(1).cast("bigint"), F.ceil(F.lit(fraction) * F.col("__names")))
    return ranked.groupBy(*by).agg(
        F.when(F.sum(value) > 0, F.sum(F.when(top, F.col(value))) / F.sum(value)).alias("share"),
        F.count_if(top).alias("names"),
    )


def concentration(
    held: DataFrame, group_rows: int | None = None, k: int = 10, by: Sequence[str] = ("eom", "method")
) -> DataFrame:
    """Sum of the k largest absolute weights, its share of leverage, and the largest one."""
    rows = held.withColumn("__abs", F.abs("weight"))
    ranked = ranks.ordinal_rank(rows, by, [-F.col("__abs"), F.col("entity")], "__rn", group_rows)
    top = F.sum(F.when(F.col("__rn") <= k, F.col("__abs")))
    return ranked.groupBy(*by).agg(
        top.alias("top10_abs_weight"),
        F.when(F.sum("__abs") > 0, top / F.sum("__abs")).otherwise(0.0).alias("top10_share"),
        F.max("__abs").alias("max_abs_weight"),
    )
