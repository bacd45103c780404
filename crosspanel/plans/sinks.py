"""Registered queries: what the sinks write, read back whole from the shared folder."""

from __future__ import annotations

from pyspark.sql import functions as F

from crosspanel.plans import base
from crosspanel.plans.registry import register
from crosspanel.plans.sqltext import panel_ctes
from crosspanel.sources import tables

PANEL = panel_ctes()


@register(
    "year_partitions",
    "year months rows total:2",
    "SELECT CAST(year(eom) AS INTEGER) AS year, count(DISTINCT eom) AS months, count(*) AS rows, sum(mktcap) AS total FROM panel GROUP BY 1",
    PANEL,
)
def year_partitions(spark, sf_dir):
    """Year directories read as one table, after the even years were written wrong and replaced."""
    rows = base.panel(spark, sf_dir).select("eom", "entity", "mktcap")
    even = F.year("eom") % 2 == 0
    path = base.sink_folder(spark, "years")
    tables.write_year_partitions(rows.withColumn("mktcap", F.when(even, F.lit(-1.0)).otherwise(F.col("mktcap"))), path)
    tables.replace_year_partitions(rows.where(even), path)
    return tables.read_year_partitions(spark, path).groupBy("year").agg(
        F.count_distinct("eom").alias("months"), F.count(F.lit(1)).alias("rows"), F.sum("mktcap").alias("total")
    )


@register("parquet_overwrite", "eom entity mktcap:4", "SELECT * FROM panel WHERE in_mid", PANEL)
def parquet_overwrite(spark, sf_dir):
    """A whole table written twice: the second replaces the first."""
    rows = base.panel(spark, sf_dir)
    path = base.sink_folder(spark, "table")
    tables.write_parquet(rows.select("eom", "entity", "mktcap"), path)
    tables.write_parquet(rows.where("in_mid").select("eom", "entity", "mktcap"), path)
    return spark.read.parquet(path)


@register(
    "csv_result",
    "year months rows:bigint total:6 bad",
    "SELECT CAST(year(eom) AS INTEGER) AS year, count(*) AS months, sum(n) AS rows, sum(s) AS total, count(*) FILTER (WHERE month(eom) = 6) AS bad FROM (SELECT eom, count(*) AS n, sum(ret_1m) AS s FROM panel GROUP BY eom) GROUP BY 1",
    PANEL,
)
def csv_result(spark, sf_dir):
    """A result table as CSV; every June also has a line whose numbers can't be read."""
    monthly = base.panel(spark, sf_dir).groupBy("eom").agg(F.count(F.lit(1)).alias("rows"), F.sum("ret_1m").alias("total"))
    lines = monthly.select(*[F.col(c).cast("string") for c in monthly.columns])
    faulty = lines.where(F.month("eom") == 6).withColumns({"rows": F.lit("many"), "total": F.lit("n/a")})
    path = base.sink_folder(spark, "result")
    tables.write_csv(lines.unionByName(faulty), path)
    found = tables.read_csv(spark, path, "eom date, rows long, total double", "_bad")
    good = F.col("_bad").isNull()
    return found.groupBy(F.year("eom").alias("year")).agg(
        F.count_if(good).alias("months"), F.sum(F.when(good, F.col("rows"))).alias("rows"),
        F.sum(F.when(good, F.col("total"))).alias("total"), F.count_if(~good).alias("bad"),
    )


@register(
    "json_records",
    "year months members:bigint low:8 high:8 bad",
    "SELECT CAST(year(eom) AS INTEGER) AS year, count(*) AS months, CAST(sum(n) AS BIGINT) AS members, min(lo) AS low, max(hi) AS high, count(*) FILTER (WHERE month(eom) = 12) AS bad FROM (SELECT eom, count(*) FILTER (WHERE in_mid) AS n, min(ret_1m) AS lo, max(ret_1m) AS hi FROM panel GROUP BY eom) GROUP BY 1",
    PANEL,
)
def json_records(spark, sf_dir):
    """Month records with nested fields; every December also has a record that was cut off."""
    monthly = base.panel(spark, sf_dir).groupBy("eom").agg(
        F.struct(F.count_if(F.coalesce("in_mid", F.lit(False))).alias("members")).alias("params"),
        F.array(F.min("ret_1m"), F.max("ret_1m")).alias("span"),
    )
    path = base.sink_folder(spark, "records")
    tables.write_json(monthly, path)
    text = F.to_json(F.struct("eom", "params", "span"))
    monthly.where(F.month("eom") == 12).select(F.left(text, F.length(text) - 4).alias("value")).write.mode("append").text(path)
    found = tables.read_json(spark, path, "eom date, params struct<members: long>, span array<double>", "_bad")
    good = F.col("_bad").isNull()
    year = F.when(good, F.year("eom")).otherwise(F.regexp_extract("_bad", '"eom":"([0-9]{4})', 1).try_cast("int"))
    return found.groupBy(year.alias("year")).agg(
        F.count_if(good).alias("months"), F.sum(F.when(good, F.col("params.members"))).alias("members"),
        F.min(F.when(good, F.get("span", F.lit(0)))).alias("low"), F.max(F.when(good, F.get("span", F.lit(1)))).alias("high"),
        F.count_if(~good).alias("bad"),
    )


@register(
    "sample_export",
    "entity eom ret_1m:8 mktcap:4 raw_tax:8 rank_tax:10",
    "SELECT * FROM panel WHERE in_small AND eom BETWEEN DATE '1996-06-30' AND DATE '1998-03-31'",
    PANEL,
)
def sample_export(spark, sf_dir):
    """The rows of a universe and date range with one feature, written and read back."""
    path = base.sink_folder(spark, "sample")
    tables.export_sample(base.panel(spark, sf_dir), path, "1996-06-30", "1998-03-31", "small", ["tax"])
    return spark.read.parquet(path)
