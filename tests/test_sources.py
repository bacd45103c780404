"""Scans, contracts and sinks on the small master panel."""

from __future__ import annotations

import pytest
from conftest import month
from pyspark.sql import functions as F

from crosspanel.functions import scalars as X
from crosspanel.operators import joins, performance, quality
from crosspanel.sources import tables

FEATURES = ("a", "b")


@pytest.fixture(scope="module")
def master(spark):
    """500 names x 3 months with nested flags and one missing raw value per feature and month."""
    rows = []
    for m in range(3):
        for i in range(500):
            cap, adv = 1e7 - 1e4 * i, 1e6 + 1e4 * i
            raw = [None if i == j else (i + j) / (499 + j) for j in (0, 1)]
            rows.append(
                (10000 + i, month(m), 0.001 * m + 1e-5 * i, 0.001 * (m + 1) + 1e-5 * i, 10 + i / 10, cap, cap, adv, 0.2 / adv,
                 0.2, i + 1, i < 100, i < 300, True, *raw, *[0.5 if r is None else r for r in raw])
            )
    schema = (
        "entity long, eom date, ret_1m double, ret_exc_lead1m double, price double, mktcap double, lag_mktcap double,"
        " adv_6m double, lambda_adv double, vol_12m double, universe_rank int, in_small boolean, in_mid boolean,"
        " in_large boolean, raw_a double, raw_b double, rank_a double, rank_b double"
    )
    return spark.createDataFrame(rows, schema).cache()


def test_scan_counts(master):
    for universe, rows in (("small", 300), ("mid", 900), ("large", 1500)):
        assert tables.scan_panel(master, universe=universe).count() == rows
    assert tables.scan_panel(master, str(month(1)), str(month(1)), "small", FEATURES).count() == 100
    assert tables.scan_costs(master, universe="mid").columns == list(tables.COST_COLUMNS)


def test_null_flag_is_false(master):
    rows = master.withColumn("in_small", F.when(F.col("entity") > 10000, F.col("in_small")))
    assert tables.scan_panel(rows, universe="small").count() == 297


def test_column_rules(master):
    for bad in ([], ["eom", "eom"], ["eom", "nope"]):
        with pytest.raises(ValueError):
            tables.require_columns(master, bad)


def test_filters_reach_the_scan(spark, master, tmp_path):
    path = str(tmp_path / "panel")
    tables.write_parquet(master, path)
    plan = tables.scan_panel(spark.read.parquet(path), "2020-02-01", "2020-02-29", columns=["eom", "price"])
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(eom" in text and "ReadSchema: struct<eom:date,price:double>" in text


def test_year_partitions_and_fill(spark, master, tmp_path):
    path = str(tmp_path / "years")
    rows = master.withColumn("eom", F.when(F.col("entity") < 10100, F.lit("2019-12-31").cast("date")).otherwise(F.col("eom")))
    tables.write_year_partitions(rows.where(F.year("eom") == 2019), path)
    years = rows.select(F.year("eom").alias("year")).distinct()
    todo = tables.missing_partitions(years, tables.read_year_partitions(spark, path), ["year"])
    assert [r["year"] for r in todo.collect()] == [2020]
    tables.write_year_partitions(rows.join(todo, F.year("eom") == F.col("year"), "left_semi"), path)
    assert tables.read_year_partitions(spark, path).count() == 1500


def test_sample_csv_and_json(spark, master, tmp_path):
    tables.export_sample(master, str(tmp_path / "s"), "2020-01-01", "2020-01-31", "small", FEATURES)
    assert spark.read.parquet(str(tmp_path / "s")).count() == 100
    table = master.groupBy("eom").agg(F.count("*").alias("n"))
    tables.write_csv(table, str(tmp_path / "c"))
    back = tables.read_csv(spark, str(tmp_path / "c"), "eom date, n long")
    assert back.exceptAll(table).isEmpty()
    jobs = spark.createDataFrame([("static", 2.5), ("static", 1.5), ("aim", 4.0)], "method string, seconds double")
    jobs.write.json(str(tmp_path / "j"))
    found = tables.read_json(spark, str(tmp_path / "j"), "method string, seconds double")
    sums = {r["method"]: r["s"] for r in found.groupBy("method").agg(F.sum("seconds").alias("s")).collect()}
    assert sums == {"static": 4.0, "aim": 4.0}


def test_replaced_years_leave_others(spark, master, tmp_path):
    path = str(tmp_path / "years")
    rows = master.withColumn("eom", F.when(F.col("entity") < 10100, F.lit("2019-12-31").cast("date")).otherwise(F.col("eom")))
    tables.write_year_partitions(rows, path)
    before = {r["year"]: r["count"] for r in tables.read_year_partitions(spark, path).groupBy("year").count().collect()}
    tables.replace_year_partitions(rows.where("eom = '2019-12-31' AND entity < 10010"), path)
    after = {r["year"]: r["count"] for r in tables.read_year_partitions(spark, path).groupBy("year").count().collect()}
    assert after[2020] == before[2020] and 0 < after[2019] < before[2019]


def test_bad_lines_and_records_are_told(spark, tmp_path):
    lines = spark.createDataFrame([("2020-01-31", "5"), ("2020-02-29", "five"), ("soon", "6"), ("2020-03-31", None)], "d string, n string")
    tables.write_csv(lines, str(tmp_path / "c"))
    rows = tables.read_csv(spark, str(tmp_path / "c"), "d date, n long", "_bad").collect()
    assert sorted(r["_bad"] for r in rows if r["_bad"] is not None) == ["2020-02-29,five", "soon,6"]
    assert sorted((r.d.month, r.n) for r in rows if r["_bad"] is None) == [(1, 5), (3, None)]
    path = str(tmp_path / "j")
    tables.write_json(lines.select("d"), path)
    spark.createDataFrame([('{"d": "2020-',), ("[",)], "value string").write.mode("append").text(path)
    rows = tables.read_json(spark, path, "d string", "_bad").collect()
    assert sorted(r["_bad"] for r in rows if r["_bad"] is not None) == ["[", '{"d": "2020-']
    assert sorted(r.d for r in rows if r["_bad"] is None) == ["2020-01-31", "2020-02-29", "2020-03-31", "soon"]


def test_status_and_alias(spark, master):
    status = {r["table_name"]: r["status"] for r in tables.table_status({"a": master, "b": master.limit(0), "c": None}).collect()}
    assert status == {"a": "available", "b": "empty", "c": "unavailable"}
    renamed = master.select(F.col("entity").alias("ENTITY"), F.col("mktcap").alias("ME"))
    out = tables.coalesce_alias(renamed, {"mktcap": ["cap", "me"], "beta": ["b"]})
    assert out.columns == ["entity", "me", "mktcap", "beta"]
    assert out.where("beta is null").count() == 1500


def test_checks_pass_and_planted_faults_fail(master):
    clean = quality.report(
        quality.check_unique(master), quality.check_nested(master, ["in_small", "in_mid", "in_large"]),
        quality.check_range(master, ["rank_a", "rank_b"]), quality.check_neutral(master, FEATURES),
        quality.check_lambda(master), quality.check_coverage(master, "in_large", 450),
    )
    assert clean.where("not passed").isEmpty()
    bad = (
        master.withColumn("in_mid", F.when(F.col("entity") == 10000, False).otherwise(F.col("in_mid")))
        .withColumn("rank_a", F.when(F.col("entity") == 10001, 1.5).otherwise(F.col("rank_a")))
        .withColumn("lambda_adv", F.when(F.col("entity") == 10002, F.col("lambda_adv") * 2).otherwise(F.col("lambda_adv")))
    )
    found = quality.report(
        quality.check_nested(bad, ["in_small", "in_mid", "in_large"]), quality.check_range(bad, ["rank_a", "rank_b"]),
        quality.check_lambda(bad), quality.check_unique(bad.unionByName(bad.limit(1))),
    )
    assert found.where("passed").isEmpty()
    assert not quality.check_panel_shape(master, 1500, 3, "2020-01-31", "2020-04-30").first()["passed"]


def test_label_follows_next_month(master):
    assert quality.check_lookahead(master).first()["passed"]
    shifted = master.withColumn("ret_exc_lead1m", F.hash("entity", "eom") % 100 / 100.0).withColumn("ret_1m", F.col("ret_exc_lead1m"))
    assert not quality.check_lookahead(shifted).first()["passed"]


def test_joins_refuse_bad_keys(spark, master):
    twice = master.unionByName(master)
    with pytest.raises(ValueError, match="not unique"):
        joins.join_one_to_one(master, twice, ["eom", "entity"])
    with pytest.raises(ValueError, match="rows without"):
        joins.align(master.select("eom", "entity"), master.where("entity > 10000").withColumn("v", F.lit(1)), ["eom", "entity"], "v")
    with pytest.raises(ValueError, match="already there"):
        joins.extend_panel(master, master, ["eom", "entity"])
    clash = spark.createDataFrame([("a", "b", 1.0), ("b", "a", 2.0)], "factor_1 string, factor_2 string, covariance double")
    with pytest.raises(Exception, match="conflicting covariance"):
        joins.symmetric_covariance(clash.withColumn("eom", F.lit(1)), ["eom"]).collect()


def test_missing_on_one_side_is_infinite(spark):
    df = spark.createDataFrame([(1, 1.0, 1.5), (2, None, None), (3, None, 2.0)], "id int, a double, b double")
    got = {r["id"]: r["d"] for r in df.select("id", X.difference(F.col("a"), F.col("b")).alias("d")).collect()}
    assert got == {1: 0.5, 2: 0.0, 3: float("inf")}
    gap = performance.reconcile(df.select("id", "a"), df.select("id", F.col("b").alias("a")), ["id"], ["a"], 1.0).first()
    assert gap["max_difference"] == float("inf") and not gap["passed"]


def test_casts_and_months(spark):
    row = spark.range(1).select(
        X.to_numeric(F.lit("x")).alias("n"), X.to_date(F.lit("2020-13-01")).alias("d"),
        X.month_end(F.lit("2020-01-31").cast("date"), 1).alias("e"), X.finite(F.lit(float("nan"))).alias("f"),
        X.clip(F.lit(None).cast("double"), 0.0, 1.0).alias("c"),
    ).first()
    assert row["n"] is None and row["d"] is None and row["f"] is None and row["c"] is None
    assert row["e"] == month(1)


def test_candidate_id_ignores_field_order(spark):
    a, b = F.lit(1.0), F.lit(2.0)
    one, two = spark.range(1).select(
        X.candidate_id(F.lit("m"), X.params_text({"u": a, "k": b})), X.candidate_id(F.lit("m"), X.params_text({"k": b, "u": a}))
    ).first()
    assert one == two and len(one) == 16
