"""Shared plan pieces: the universe panel, the policy weights and their monthly returns."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, functions as F

from crosspanel import settings as S
from crosspanel.operators import ledger, policy, ranks, scaling
from crosspanel.sources import panel as source

AUM = 1.0e5  # fits the volumes of the derived panel
METHODS = ("equal_weight", "rank_long_short", "top_bottom", "markowitz")

_SHARED: dict[tuple[str, str, str], tuple[DataFrame, str | None]] = {}


def shared_folder(spark: SparkSession) -> str | None:
    """The folder the cluster names for checkpoints; a one-machine session without one is given its own."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named and re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        named = spark.sparkContext.getCheckpointDir()
    return named


def sink_folder(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder for files that a query writes and reads back; gone with the application."""
    folder = shared_folder(spark)
    if folder is None:
        raise ValueError("name a shared folder in spark.checkpoint.dir")
    path = f"{folder}/crosspanel-{uuid.uuid4().hex}/{name}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def shared(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """A table many reports start from: written once as Parquet to the shared folder and read back.

    That cuts its lineage, so later plans stay small, keeps pruning and real size statistics for the
    joins on it, and outlives any executor.  Without a shared folder it is persisted instead.
    """
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _SHARED:
        folder = shared_folder(spark)
        if folder is None:
            _SHARED[key] = build().persist(StorageLevel.MEMORY_AND_DISK), None
        else:
            path = f"{folder}/crosspanel-{uuid.uuid4().hex}/{name}"
            build().write.parquet(path)
            _SHARED[key] = spark.read.parquet(path), path
    return _SHARED[key][0]


def bound(spark: SparkSession, sf_dir: str) -> int:
    """Measured rows of the largest month."""
    return source.month_rows(spark, sf_dir)


def rows(spark: SparkSession, sf_dir: str) -> int:
    """Measured rows of the panel, for statistics over a whole column."""
    return source.panel_sizes(spark, sf_dir)[1]


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived panel with universe flags and all feature ranks."""
    return shared(
        spark, sf_dir, "panel", lambda: source.build_panel(spark, sf_dir, source.FEATURES, universe=True)
    )


def universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mid universe with diagonal variances and a prediction."""

    def build() -> DataFrame:
        rows = scaling.impute_median(
            panel(spark, sf_dir).where("in_mid"), "vol_12m", "vol",
            group_rows=bound(spark, sf_dir), default=S.VARIANCE_FLOOR**0.5,
        )
        return rows.withColumn(
            "variance", F.greatest(F.col("vol") ** 2, F.lit(S.VARIANCE_FLOOR))
        ).withColumn("mu", F.lit(0.01) * (F.col("rank_momentum") - 0.5))

    return shared(spark, sf_dir, "universe", build)


def weights(rows: DataFrame, group_rows: int | None, size: int | None = None) -> DataFrame:
    """Four policies that need no inherited position, from one pass over the universe (``size`` rows at most, if known)."""
    rows, by = policy.equal_weight(rows, "equal_weight"), ["eom"]
    if size is not None and ranks.fits_one_task(group_rows):
        rows, by = ranks.deal(rows, by, size, ranks.month_number("eom"))
    rows = policy.rank_long_short(rows, "rank_momentum", output="rank_long_short", group_rows=group_rows, by=by)
    rows = policy.top_bottom(rows, "rank_discount", 0.1, output="top_bottom", group_rows=group_rows, by=by)
    rows = policy.markowitz(rows, "mu", "variance", max_leverage=2.0, output="markowitz")
    if size is not None:
        rows = ranks.by_entity(rows, size, len(METHODS))
    items = F.array(*[F.struct(F.lit(m).alias("method"), F.col(m).alias("weight")) for m in METHODS])
    return rows.select(
        "eom", "entity", "ret_exc_lead1m", "lambda_adv", "adv_6m", "variance", F.inline(items)
    )


def stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared(
        spark, sf_dir, "month_stats",
        lambda: ledger.month_stats(universe(spark, sf_dir), bound(spark, sf_dir)),
    )


def held(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weights(universe(spark, sf_dir), bound(spark, sf_dir), rows(spark, sf_dir))


def returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly returns of the four policies."""
    return shared(
        spark, sf_dir, "returns", lambda: ledger.ledger(held(spark, sf_dir), stats(spark, sf_dir), aum=AUM)
    )


def release(keep: tuple[str, ...] = ()) -> None:
    """Forget shared tables, but for the named ones, and delete their files; they are built again when asked for."""
    for key in [k for k in _SHARED if k[2] not in keep]:
        df, path = _SHARED.pop(key)
        context = df.sparkSession.sparkContext
        if path is None:
            df.unpersist()
        elif key[0] == context.applicationId:
            folder = context._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)
