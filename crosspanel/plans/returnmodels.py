"""Registered queries: competing return models, their windows, predictions and a policy on them."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, functions as F

from crosspanel import settings as S
from crosspanel.operators import joins, returnmodels, signals
from crosspanel.plans import base
from crosspanel.plans.learned import INPUTS, MAPS
from crosspanel.plans.models import LABEL
from crosspanel.plans.registry import register
from crosspanel.plans.sqltext import panel_ctes

PANEL = panel_ctes()


def calendar(spark, sf_dir) -> list[dt.date]:
    return [r.eom for r in base.panel(spark, sf_dir).select("eom").distinct().orderBy("eom").collect()]


def rows(spark, sf_dir) -> DataFrame:
    """The whole panel with its month number, six filled ranks and the label."""
    months = [(m, i + 1) for i, m in enumerate(calendar(spark, sf_dir))]
    numbered = spark.createDataFrame(months, "eom date, t int")
    return base.panel(spark, sf_dir).join(F.broadcast(numbered), "eom").select(
        "eom", "entity", "t", F.year("eom").alias("test_year"), F.col(LABEL).alias("label"),
        F.array(*[F.coalesce(F.col(c), F.lit(S.NEUTRAL_RANK)) for c in INPUTS]).alias("features"),
    )


def fits(spark, sf_dir) -> DataFrame:
    def build():
        months = calendar(spark, sf_dir)
        moments = returnmodels.month_moments(rows(spark, sf_dir), len(months), len(INPUTS), MAPS)
        years = sorted({m.year for m in months})
        return returnmodels.compete(moments, months, years, len(INPUTS), MAPS, S.RETURN_LAMBDAS)

    return base.shared(spark, sf_dir, "competing_fits", build)


def predictions(spark, sf_dir) -> DataFrame:
    def build():
        chosen = fits(spark, sf_dir).where("selected").collect()  # one row per year
        return returnmodels.predict(rows(spark, sf_dir), chosen, len(INPUTS), MAPS)

    return base.shared(spark, sf_dir, "competing_predictions", build)


@register(
    "adaptive_validation_window",
    "test_year known_months:bigint validation_months:bigint first_month last_month train_end",
    f"""SELECT test_year, known AS known_months, count(*) FILTER (WHERE back <= wanted) AS validation_months, min(CASE WHEN back <= wanted THEN eom END) AS first_month, max(CASE WHEN back <= wanted THEN eom END) AS last_month, max(CASE WHEN back > wanted THEN eom END) AS train_end FROM
    (SELECT *, CASE WHEN known - {S.RETURN_MIN_TRAIN} >= {S.RETURN_MIN_VALIDATION} THEN least({S.RETURN_VALIDATION_MONTHS}, known - {S.RETURN_MIN_TRAIN}) ELSE 0 END AS wanted FROM
    (SELECT CAST(y AS INTEGER) AS test_year, eom, row_number() OVER (PARTITION BY y ORDER BY eom DESC) AS back, count(*) OVER (PARTITION BY y) AS known FROM (SELECT DISTINCT eom FROM panel) JOIN (SELECT DISTINCT year(eom) AS y FROM panel)
    ON eom <= make_date(CAST(y - 1 AS INTEGER), 11, 30))) GROUP BY 1, 2""",
    PANEL,
)
def adaptive_validation_window(spark, sf_dir):
    """The last months that leave enough to train on; none where the history is too short."""
    months = base.panel(spark, sf_dir).select("eom").distinct()
    years = months.select(F.year("eom").alias("test_year")).distinct()
    parted = joins.adaptive_window(
        joins.training_rows(months, years), ["test_year"], S.RETURN_VALIDATION_MONTHS, S.RETURN_MIN_TRAIN, S.RETURN_MIN_VALIDATION
    )
    inside = F.col("part") == "validation"
    return parted.groupBy("test_year").agg(
        F.count(F.lit(1)).alias("known_months"), F.count_if(inside).alias("validation_months"),
        F.min(F.when(inside, F.col("eom"))).alias("first_month"), F.max(F.when(inside, F.col("eom"))).alias("last_month"),
        F.max(F.when(~inside, F.col("eom"))).alias("train_end"),
    )


@register(
    "competing_return_models",
    "test_year candidate kind eta:2 p penalty:4 train_months validation_months validation_start train_rows:bigint validation_rows:bigint validation_mse:10 selected",
)
def competing_return_models(spark, sf_dir):
    """Thirty candidates of two kinds a year, on six features; a year without history has null fits."""
    return fits(spark, sf_dir)


@register("competing_predictions", "eom entity test_year mu_hat:8")
def competing_predictions(spark, sf_dir):
    return predictions(spark, sf_dir)


@register("competing_diagnostics", "test_year prediction_mean:8 mean_prediction_std:8 mean_rank_ic:8 test_mse:8")
def competing_diagnostics(spark, sf_dir):
    """Mean, spread, rank correlation and error of the chosen models' predictions by year."""
    labels = base.panel(spark, sf_dir).select("eom", "entity", LABEL)
    found = predictions(spark, sf_dir).join(labels, ["eom", "entity"]).withColumn("mu_key", F.round("mu_hat", 12))
    return signals.prediction_diagnostics(found, "mu_hat", "mu_key", LABEL, base.bound(spark, sf_dir))
