"""Ranks and quantiles: the bucketed way must equal the one-task way and pandas, whatever the skew."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from crosspanel.operators import ranks


@pytest.fixture(scope="module")
def skewed(spark):
    """One month with two thirds of the rows, one value held by a third of them, nulls and ties."""
    rng = np.random.default_rng(3)
    sizes = {"a": 700, "b": 250, "c": 49, "d": 1}
    frames = []
    for group, n in sizes.items():
        values = np.round(rng.normal(size=n), 2)
        values[: n // 3] = 0.25
        column = pd.Series(values, dtype=object)
        column[rng.random(n) < 0.05] = None
        frames.append(pd.DataFrame({"g": group, "v": column}))
    pdf = pd.concat(frames, ignore_index=True)
    pdf["id"] = np.arange(len(pdf))
    pdf["v"] = pdf["v"].astype(object).where(pdf["v"].notna(), None)
    rows = [(r.g, None if r.v is None else float(r.v), int(r.id)) for r in pdf.itertuples()]
    return spark.createDataFrame(rows, "g string, v double, id long"), pdf.assign(v=pd.to_numeric(pdf["v"]))


@pytest.mark.parametrize("size", [None, 10_000])
def test_percentile_rank(skewed, size):
    df, pdf = skewed
    got = ranks.percentile_rank(df, ["g"], "v", "r", size, bucket_rows=20).toPandas().set_index("id")["r"]
    want = pdf.groupby("g")["v"].rank(pct=True, method="average").fillna(0.5)
    np.testing.assert_allclose(got.sort_index().to_numpy(), want.to_numpy(), rtol=0, atol=1e-15)


@pytest.mark.parametrize("size", [None, 10_000])
def test_several_ranks_at_once(skewed, size):
    df, pdf = skewed
    both = ranks.percentile_ranks(
        df.withColumn("w", -F.col("v")), ["g"], {"v": "r", "w": "q"}, size, bucket_rows=20
    ).toPandas().set_index("id").sort_index()
    want = pdf.groupby("g")["v"].rank(pct=True).fillna(0.5)
    np.testing.assert_allclose(both["r"].to_numpy(), want.to_numpy(), atol=1e-15)
    opposite = (-pdf["v"]).groupby(pdf["g"]).rank(pct=True).fillna(0.5)
    np.testing.assert_allclose(both["q"].to_numpy(), opposite.to_numpy(), atol=1e-15)


@pytest.mark.parametrize("size", [None, 10_000])
def test_ordinal_rank_is_a_permutation(skewed, size):
    df, pdf = skewed
    order = [F.col("v").isNull(), F.col("v"), F.col("id")]
    got = ranks.ordinal_rank(df, ["g"], order, "p", size, count="n", bucket_rows=20).toPandas()
    want = pdf.sort_values(["g", "v", "id"], na_position="last")
    want["p"] = want.groupby("g").cumcount() + 1
    joined = got.merge(want[["id", "p"]], on="id")
    assert (joined["p_x"] == joined["p_y"]).all()
    assert (joined["n"] == joined["g"].map(pdf["g"].value_counts())).all()


@pytest.mark.parametrize("size", [None, 10_000])
def test_quantiles(skewed, size):
    df, pdf = skewed
    points = {"p01": 0.01, "p50": 0.5, "p999": 0.999}
    got = ranks.quantiles(df, ["g"], "v", points, size, bucket_rows=20).toPandas().set_index("g").sort_index()
    for name, p in points.items():
        np.testing.assert_allclose(got[name], pdf.groupby("g")["v"].quantile(p), atol=1e-12)
    whole = ranks.quantiles(df, [], "v", points, size, bucket_rows=20).first()
    assert whole["p50"] == pytest.approx(pdf["v"].median())


def test_minimum_rank_descending(skewed):
    df, pdf = skewed
    got = ranks.minimum_rank_descending(df, ["g"], "v", "r", bucket_rows=20).toPandas().set_index("id")["r"].sort_index()
    want = pdf.groupby("g")["v"].rank(ascending=False, method="min")
    assert got.fillna(-1).tolist() == want.fillna(-1).tolist()


def test_hot_group_is_cut(skewed):
    """No bucket of the hot month holds more than a small share of its distinct keys."""
    df, _ = skewed
    keyed = df.where("v is not null").withColumn("k", F.struct("v", "id"))
    buckets = ranks.bucket_by_value(keyed, ["g"], "k", bucket_rows=20).where("g = 'a'").groupBy("__bucket").count().toPandas()
    assert len(buckets) > 10
    assert buckets["count"].max() < 150


@pytest.mark.parametrize("bucket_rows", [1, 3, 40, 5000])
def test_splitter_tree_orders_buckets(spark, bucket_rows):
    """Buckets follow the values for any number of cuts, and a row carries about the root of the cuts."""
    rng = np.random.default_rng(5)
    values = {"a": rng.permutation(3000).astype(float), "b": rng.normal(size=40), "c": np.array([7.0])}
    rows = [(g, float(v)) for g, vs in values.items() for v in vs]
    df = spark.createDataFrame(rows, "g string, v double")
    out = ranks.bucket_by_value(df, ["g"], "v", bucket_rows=bucket_rows).toPandas()
    assert len(out) == len(rows)
    for g, part in out.groupby("g"):
        part = part.sort_values("v")
        assert (part["__bucket"].diff().dropna() >= 0).all() and part["__bucket"].min() >= 0
        wanted = -(-len(part) // bucket_rows)
        assert part["__bucket"].nunique() > min(wanted, len(part) / 8) / 3
        assert part["__bucket"].value_counts().max() <= max(40, 4 * bucket_rows)


def test_a_hot_value_is_spread(spark):
    """Half of the rows hold one value and a quarter none: no task of the join gets more than its share."""
    rows = spark.range(40_000).select(
        (F.col("id") % 2).alias("g"), "id", F.when(F.col("id") % 8 < 4, 0.5).when(F.col("id") % 8 < 6, F.col("id") / 7.0).alias("v")
    )
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        for k, v in zip(before, ("64", "false", "-1")):
            spark.conf.set(k, v)
        counts = ranks.cumulative_counts(rows, ["g"], "v", bucket_rows=500).withColumnsRenamed({"n": "__n", "below": "__below", "total": "__total"})
        out = ranks.join_counts(rows, counts, ["g"], "v", ["__n", "__below", "__total"])
        sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(sizes) == 40_000 and max(sizes) < 3 * 40_000 / 64
        got = out.where("v = 0.5").select("__n", "__total").distinct().collect()
        assert sorted(map(tuple, got)) == [(10_000, 15_000)] * 1 and out.where("v IS NULL AND __n IS NOT NULL").count() == 0
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_a_task_of_large_months_holds_one(spark, sf_dir, monkeypatch):
    """Months are dealt out in turn, not hashed or merged by their bytes; ranks and rows stay what they were."""
    from crosspanel.sources import panel as source

    few = source.build_panel(spark, sf_dir, ("tax",), universe=True)
    want = {(r["entity"], r["eom"]): (r["rank_tax"], r["universe_rank"]) for r in few.collect()}
    monkeypatch.setattr(ranks, "TASK_ROWS", 5)
    many = source.build_panel(spark, sf_dir, ("tax",), universe=True)
    held = many.groupBy(F.spark_partition_id().alias("task")).agg(F.count_distinct("eom").alias("months")).collect()
    assert len(held) > 50 and {r["months"] for r in held} == {1}
    assert {(r["entity"], r["eom"]): (r["rank_tax"], r["universe_rank"]) for r in many.collect()} == want
