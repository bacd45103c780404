"""The entity-month panel that Spark derives from the line-item table.

Sums are taken over whole cents and whole percent points, so they do not depend on the order in which
partitions are merged; tied values stay tied.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from crosspanel import settings as S
from crosspanel.operators import ranks

FEATURES = ("discount", "tax", "qty", "returned", "size", "momentum")
THEMES = {
    "discount": "Pricing",
    "tax": "Pricing",
    "qty": "Volume",
    "returned": "Quality",
    "size": "Volume",
    "momentum": "Momentum",
}

_SIZES: dict[tuple[str, str, str], tuple[int, int]] = {}  # for one application: files may change after it


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _hundredths(name: str) -> Column:
    return F.round(F.col(name) * 100).cast("bigint")


def monthly_aggregates(spark: SparkSession, sf_dir: str, entity: str = "l_suppkey") -> DataFrame:
    """Month sums of the line items: the one wide shuffle of the panel, combined on the map side."""
    lines = read(spark, sf_dir, "lineitem")
    return lines.groupBy(
        F.col(entity).alias("entity"),
        F.last_day("l_shipdate").alias("eom"),
        (F.year("l_shipdate") * 12 + F.month("l_shipdate")).cast("int").alias("month_index"),
    ).agg(
        F.sum(_hundredths("l_extendedprice")).alias("cents"),
        F.sum(F.col("l_quantity").cast("bigint")).alias("units"),
        F.sum(_hundredths("l_discount")).alias("discount_points"),
        F.sum(_hundredths("l_tax")).alias("tax_points"),
        F.sum(F.when(F.col("l_returnflag") == "R", 1).otherwise(0)).alias("returned_lines"),
        F.count(F.lit(1)).alias("lines"),
    )


def panel_sizes(spark: SparkSession, sf_dir: str, entity: str = "l_suppkey") -> tuple[int, int]:
    """Entities in the largest month and rows of the panel: the measured group sizes that let a month,
    or a whole column, be ordered in one task."""
    key = (spark.sparkContext.applicationId, sf_dir, entity)
    if key not in _SIZES:
        pairs = read(spark, sf_dir, "lineitem").select(entity, F.last_day("l_shipdate").alias("eom")).distinct()
        row = pairs.groupBy("eom").count().agg(F.max("count"), F.sum("count")).first()
        _SIZES[key] = (int(row[0] or 0), int(row[1] or 0))
    return _SIZES[key]


def month_rows(spark: SparkSession, sf_dir: str, entity: str = "l_suppkey") -> int:
    return panel_sizes(spark, sf_dir, entity)[0]


def build_panel(
    spark: SparkSession,
    sf_dir: str,
    features: Sequence[str] = (),
    universe: bool = False,
    entity: str = "l_suppkey",
) -> DataFrame:
    """Prices, returns, costs, raw features, and on request universe flags and feature ranks.

    Windows run over one entity's months, at most one row per month, so no task grows with the panel.
    """
    base = monthly_aggregates(spark, sf_dir, entity).select(
        "entity",
        "eom",
        "month_index",
        "cents",
        (F.col("cents") / F.lit(100.0) / F.col("units")).alias("price"),
        (F.col("cents") / F.lit(100.0)).alias("mktcap"),
        (F.col("discount_points") / (F.col("lines") * F.lit(100.0))).alias("raw_discount"),
        (F.col("tax_points") / (F.col("lines") * F.lit(100.0))).alias("raw_tax"),
        (F.col("units") / F.col("lines").cast("double")).alias("raw_qty"),
        (F.col("returned_lines") / F.col("lines").cast("double")).alias("raw_returned"),
        F.log(F.col("cents") / F.lit(100.0)).alias("raw_size"),
    )
    months = W.partitionBy("entity").orderBy("month_index")
    gap = F.col("month_index") - F.lag("month_index").over(months)
    ahead = F.lead("month_index").over(months) - F.col("month_index")
    six = F.col("month_index") - F.lag("month_index", 6).over(months)
    trailing = months.rangeBetween(-(S.ADV_MONTHS - 1), 0)
    volume = F.sum("cents").over(trailing) / F.count("cents").over(trailing)
    panel = base.select(
        "*",
        F.when(gap == 1, F.lag("mktcap").over(months)).alias("lag_mktcap"),
        F.when(gap == 1, F.col("price") / F.lag("price").over(months) - 1).alias("ret_1m"),
        F.when(ahead == 1, F.lead("price").over(months) / F.col("price") - 1).alias("ret_exc_lead1m"),
        (volume / F.lit(100.0) / F.lit(float(S.TRADING_DAYS))).alias("adv_6m"),
        F.when(six == 6, F.col("price") / F.lag("price", 6).over(months) - 1).alias("raw_momentum"),
    ).drop("cents")
    panel = panel.withColumn("lambda_adv", F.lit(S.LAMBDA_MULTIPLIER) / F.col("adv_6m")).withColumn(
        "vol_12m", F.stddev_samp("ret_1m").over(months.rangeBetween(-11, 0))
    )
    planted = (F.col("entity") % 17 == 0) & (F.col("month_index") % 5 == 0)
    panel = panel.withColumns(
        {f"raw_{f}": F.when(~planted, F.col(f"raw_{f}")) for f in FEATURES}
    )
    if not (universe or features):
        return panel
    (bound, rows), by = panel_sizes(spark, sf_dir, entity), ["eom"]
    if ranks.fits_one_task(bound):
        panel, by = ranks.deal(panel, by, rows, F.col("month_index"))
    if universe:
        panel = universe_flags(panel, bound, by)
    if features:
        columns = {f"raw_{f}": f"rank_{f}" for f in features}
        panel = ranks.percentile_ranks(panel, by, columns, bound, neutral=S.NEUTRAL_RANK)
    return panel.drop("__part")


def universe_flags(panel: DataFrame, group_rows: int | None = None, by: Sequence[str] = ("eom",)) -> DataFrame:
    """Rank by lagged size inside the month and three nested flags (20%, 60%, all)."""
    order = [F.col("lag_mktcap").isNull(), -F.col("lag_mktcap"), F.col("entity")]
    ranked = ranks.ordinal_rank(panel, by, order, "universe_rank", group_rows, count="__names")
    share = F.col("universe_rank") / F.col("__names").cast("double")
    return ranked.withColumns(
        {
            "in_small": share <= F.lit(0.2),
            "in_mid": share <= F.lit(0.6),
            "in_large": share <= F.lit(1.0),
        }
    ).drop("__names")
