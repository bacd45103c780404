"""Cross-sectional scaling of signals inside a month.

Month statistics are two-stage sums joined back by month; no window holds a whole month.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from crosspanel import settings as S
from crosspanel.functions import scalars as X
from crosspanel.operators import ranks


def impute_median(
    df: DataFrame,
    column: str,
    output: str,
    floor: float | None = None,
    by: Sequence[str] = ("eom",),
    group_rows: int | None = None,
    default: float | None = None,
) -> DataFrame:
    """A positive finite value stays; any other takes the month median of the valid ones.

    Adds ``<output>_imputed`` and applies ``floor`` to the result.
    """
    value = F.col(column)
    ok = X.is_finite(value) & F.coalesce(value > 0, F.lit(False))
    flagged = df.withColumn("__valid", F.when(ok, value))
    medians = ranks.quantiles(flagged, by, "__valid", {"__median": 0.5}, group_rows)
    fill = F.col("__median") if default is None else F.coalesce("__median", F.lit(default))
    out = ranks.attach(flagged, medians, by).withColumn(output, F.coalesce("__valid", fill))
    if floor is not None:
        out = out.withColumn(output, F.greatest(output, F.lit(floor)))
    return out.withColumn(f"{output}_imputed", F.col("__valid").isNull()).drop("__valid", "__median")


def clean_volatility(
    df: DataFrame,
    column: str,
    output: str,
    floor: float = S.VOLATILITY_FLOOR,
    group_rows: int | None = None,
    by: Sequence[str] = ("eom",),
) -> DataFrame:
    """Volatility at or over the floor stays; any other takes the month median of those."""
    value = F.col(column)
    flagged = df.withColumn("__valid", F.when(X.is_finite(value) & (value >= floor), value))
    medians = ranks.quantiles(flagged, by, "__valid", {"__median": 0.5}, group_rows)
    default = F.lit(max(floor, S.VOLATILITY_DEFAULT))
    return (
        ranks.attach(flagged, medians, by)
        .withColumn(output, F.coalesce("__valid", "__median", default))
        .drop("__valid", "__median")
    )


def unit_norm(
    df: DataFrame, columns: Sequence[str], prefix: str = "z_", constant: str | None = None,
    by: Sequence[str] = ("eom",),
) -> DataFrame:
    """Demean each signal inside the month and scale it to unit length; a flat signal becomes 0.

    The squared length is summed around the mean in a second pass, so it is exact for a signal whose
    mean is large against its spread.
    """
    means = df.groupBy(*by).agg(
        *[F.avg(c).alias(f"__m_{c}") for c in columns], F.count(F.lit(1)).alias("__names")
    )
    centred = ranks.attach(df, means, by).withColumns(
        {f"__c_{c}": F.coalesce(F.col(c) - F.col(f"__m_{c}"), F.lit(0.0)) for c in columns}
    )
    lengths = centred.groupBy(*by).agg(
        *[F.sqrt(F.sum(F.col(f"__c_{c}") ** 2)).alias(f"__l_{c}") for c in columns]
    )
    out = ranks.attach(centred, lengths, by)
    scaled = {
        f"{prefix}{c}": F.when(
            F.col(f"__l_{c}") > S.NORM_FLOOR, F.col(f"__c_{c}") / F.col(f"__l_{c}")
        ).otherwise(0.0)
        for c in columns
    }
    if constant:
        scaled[constant] = F.lit(1.0) / F.sqrt(F.col("__names").cast("double"))
    drop = [f"{tag}{c}" for c in columns for tag in ("__m_", "__c_", "__l_")]
    return out.withColumns(scaled).drop(*drop, "__names")


def volatility_scale(df: DataFrame, columns: Sequence[str], volatility: str) -> DataFrame:
    return df.withColumns({c: F.col(c) / F.col(volatility) for c in columns})
