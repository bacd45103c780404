"""What the operators share: written intermediate tables and scans."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from crosspanel.plans.base import shared_folder
from crosspanel.session import ship_package


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def scan(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def written(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read back.

    Cuts the lineage, outlives executors, and fixes values that depend on how rows were dealt out.
    The files go when the application ends.
    """
    spark = df.sparkSession
    folder = shared_folder(spark)
    if folder is None:
        raise ValueError("name a shared folder in spark.checkpoint.dir")
    path = f"{folder}/llm-{uuid.uuid4().hex}/{tag}"
    # The shuffle files of a written table serve nothing more.
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return spark.read.schema(df.schema).parquet(path)


def keep_columns(df: DataFrame, extra: str) -> DataFrame:
    """All columns of ``df`` as one struct named ``extra``, so that working columns can't clash with them."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(extra))


def crc_fold(column, folds: int):
    """crc32 of the value written as text, modulo ``folds``: fixes which rows are held out."""
    return F.pmod(F.crc32(column.cast("string").cast("binary")), F.lit(folds))


def released(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same batches; at their end what Arrow's pool and the C heap no longer need goes back to the system.

    A worker lives on between tasks, and both would keep the most that any task has used.
    """
    yield from batches
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # a C library that has no such call
        pass
