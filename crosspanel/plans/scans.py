"""Registered queries: scans, contracts, projections, scalar functions, sorts and set operations."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame, Window as W, functions as F

from crosspanel import settings as S
from crosspanel.functions import scalars as X
from crosspanel.operators import joins, ranks, scaling
from crosspanel.plans import base
from crosspanel.plans.registry import register
from crosspanel.plans.sqltext import FEATURES, UNIVERSE, panel_ctes
from crosspanel.sources import tables
from crosspanel.sources.panel import THEMES, read

PANEL = panel_ctes()
PANEL_OUT = (
    "entity eom ret_1m:8 ret_exc_lead1m:8 price:10 mktcap:4 lag_mktcap:4 adv_6m:4 lambda_adv:12 vol_12m:8 "
    "universe_rank"
)
RANKS = " ".join(f"rank_{f}:10" for f in FEATURES)


@register(
    "scan_panel",
    f"{PANEL_OUT} raw_discount:8 raw_momentum:8 rank_discount:10 rank_momentum:10",
    "SELECT * FROM panel WHERE in_mid AND eom BETWEEN DATE '1996-01-31' AND DATE '2000-12-31'",
    PANEL,
)
def scan_panel(spark, sf_dir):
    return tables.scan_panel(
        base.panel(spark, sf_dir), "1996-01-31", "2000-12-31", "mid", ["discount", "momentum"]
    )


@register(
    "scan_costs",
    "eom entity price:10 mktcap:4 lag_mktcap:4 adv_6m:4 lambda_adv:12",
    "SELECT * FROM panel WHERE in_small AND eom >= DATE '1997-01-01'",
    PANEL,
)
def scan_costs(spark, sf_dir):
    return tables.scan_costs(base.panel(spark, sf_dir), start="1997-01-01", universe="small")


@register(
    "date_between",
    "month_rows first_month last_month",
    "SELECT count(*) AS month_rows, min(eom) AS first_month, max(eom) AS last_month FROM panel "
    "WHERE eom BETWEEN DATE '1998-01-15' AND DATE '1999-06-30'",
    PANEL,
)
def date_between(spark, sf_dir):
    rows = X.date_between(base.panel(spark, sf_dir), "eom", "1998-01-15", "1999-06-30")
    return rows.agg(
        F.count(F.lit(1)).alias("month_rows"), F.min("eom").alias("first_month"), F.max("eom").alias("last_month")
    )


@register(
    "missing_partitions",
    "year line_rows:bigint",
    "SELECT CAST(year(l_shipdate) AS INTEGER) AS year, count(*) AS line_rows FROM lineitem "
    "WHERE year(l_shipdate) NOT IN (SELECT year(o_orderdate) FROM orders WHERE o_orderstatus = 'F' AND year(o_orderdate) <= 1997) GROUP BY 1",
)
def missing_partitions(spark, sf_dir):
    """Years of line items with no finished order year on file, and the rows each would add."""
    lines = read(spark, sf_dir, "lineitem").groupBy(F.year("l_shipdate").alias("year")).agg(
        F.count(F.lit(1)).alias("line_rows")
    )
    orders = read(spark, sf_dir, "orders").where(F.col("o_orderstatus") == "F")
    done = orders.select(F.year("o_orderdate").alias("year")).where(F.col("year") <= 1997)
    return tables.missing_partitions(lines, done, ["year"])


@register(
    "eligible_rows",
    "l_returnflag l_linestatus rows:bigint units:bigint",
    "SELECT l_returnflag, l_linestatus, count(*) AS rows, CAST(sum(l_quantity) AS BIGINT) AS units FROM lineitem "
    "WHERE l_returnflag = 'N' AND l_linestatus = 'O' AND l_linenumber = 1 GROUP BY 1, 2",
)
def eligible_rows(spark, sf_dir):
    rows = tables.eligible(
        read(spark, sf_dir, "lineitem"), {"l_returnflag": "N", "l_linestatus": "O", "l_linenumber": 1}
    )
    return rows.groupBy("l_returnflag", "l_linestatus").agg(
        F.count(F.lit(1)).alias("rows"), F.sum(F.col("l_quantity").cast("bigint")).alias("units")
    )


@register(
    "restrict_to_keys",
    "o_orderpriority orders:bigint total:2",
    "SELECT o_orderpriority, count(*) AS orders, sum(o_totalprice) AS total FROM orders WHERE o_custkey IN "
    "(SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') GROUP BY 1",
)
def restrict_to_keys(spark, sf_dir):
    keys = read(spark, sf_dir, "customer").where(F.col("c_mktsegment") == "BUILDING")
    kept = tables.restrict_to_keys(
        read(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey"), keys, ["c_custkey"]
    )
    return kept.groupBy("o_orderpriority").agg(
        F.count(F.lit(1)).alias("orders"), F.sum("o_totalprice").alias("total")
    )


@register(
    "key_coverage",
    "wanted found complete",
    "SELECT count(*) AS wanted, count(o_custkey) AS found, count(*) = count(o_custkey) AS complete FROM "
    "(SELECT DISTINCT c_custkey FROM customer) c LEFT JOIN (SELECT DISTINCT o_custkey FROM orders) o ON c_custkey = o_custkey",
)
def key_coverage(spark, sf_dir):
    orders = read(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey")
    return tables.key_coverage(orders, read(spark, sf_dir, "customer"), ["c_custkey"])


@register(
    "panel_profile",
    "rows months first_month last_month " + " ".join(f"missing_{f}:8" for f in FEATURES),
    "SELECT count(*) AS rows, count(DISTINCT eom) AS months, min(eom) AS first_month, max(eom) AS last_month, "
    + ", ".join(f"avg(CASE WHEN raw_{f} IS NULL THEN 1e0 ELSE 0e0 END) AS missing_{f}" for f in FEATURES)
    + " FROM panel",
    PANEL,
)
def panel_profile(spark, sf_dir):
    return tables.profile(base.panel(spark, sf_dir), FEATURES)


@register(
    "table_status",
    "table_name rows status",
    "SELECT 'orders' AS table_name, count(*) AS rows, CASE WHEN count(*) > 0 THEN 'available' ELSE 'empty' END AS status FROM orders "
    "UNION ALL SELECT 'late_orders', count(*), CASE WHEN count(*) > 0 THEN 'available' ELSE 'empty' END FROM orders WHERE o_orderdate > TIMESTAMP '2099-01-01' "
    "UNION ALL SELECT 'prices', 0, 'unavailable'",
)
def table_status(spark, sf_dir):
    orders = read(spark, sf_dir, "orders")
    late = orders.where(F.col("o_orderdate") > F.lit("2099-01-01").cast("timestamp"))
    return tables.table_status({"orders": orders, "late_orders": late, "prices": None})


@register(
    "coalesce_alias",
    "s_suppkey mktcap:2 beta:2 sic",
    "SELECT s_suppkey, s_acctbal AS mktcap, CAST(NULL AS DOUBLE) AS beta, s_nationkey AS sic FROM supplier",
)
def coalesce_alias(spark, sf_dir):
    rows = read(spark, sf_dir, "supplier").toDF("S_SUPPKEY", "S_NAME", "S_NATIONKEY", "S_ACCTBAL")
    return tables.coalesce_alias(
        rows, {"mktcap": ["me", "s_acctbal"], "beta": ["raw_beta"], "sic": ["siccd", "s_nationkey"]}
    )


@register(
    "safe_casts",
    "numbers:bigint bad_numbers:bigint number_sum dates:bigint bad_dates:bigint last_date",
    "SELECT count(n) AS numbers, count(*) FILTER (WHERE n IS NULL) AS bad_numbers, sum(n) AS number_sum, count(d) AS dates, "
    "count(*) FILTER (WHERE d IS NULL) AS bad_dates, max(d) AS last_date FROM (SELECT "
    "TRY_CAST(CASE WHEN l_orderkey % 7 = 0 THEN 'n/a' ELSE CAST(l_partkey AS VARCHAR) END AS DOUBLE) AS n, "
    "TRY_CAST(CASE WHEN l_orderkey % 5 = 0 THEN 'unknown' ELSE strftime(l_shipdate, '%Y-%m-%d') END AS DATE) AS d FROM lineitem)",
)
def safe_casts(spark, sf_dir):
    lines = read(spark, sf_dir, "lineitem")
    text = F.when(F.col("l_orderkey") % 7 == 0, "n/a").otherwise(F.col("l_partkey").cast("string"))
    day = F.when(F.col("l_orderkey") % 5 == 0, "unknown").otherwise(F.date_format("l_shipdate", "yyyy-MM-dd"))
    rows = lines.select(X.to_numeric(text).alias("n"), X.to_date(day).alias("d"))
    return rows.agg(
        F.count("n").alias("numbers"),
        F.count_if(F.col("n").isNull()).alias("bad_numbers"),
        F.sum("n").alias("number_sum"),
        F.count("d").alias("dates"),
        F.count_if(F.col("d").isNull()).alias("bad_dates"),
        F.max("d").alias("last_date"),
    )


@register(
    "finite_filter",
    "eom finite_rows:bigint mean_ratio:8",
    "SELECT eom, count(*) AS finite_rows, avg(ret_1m / ret_exc_lead1m) AS mean_ratio FROM panel "
    "WHERE ret_1m IS NOT NULL AND ret_exc_lead1m <> 0 GROUP BY eom",
    PANEL,
)
def finite_filter(spark, sf_dir):
    """A ratio with a missing side or a zero below is not finite and is left out."""
    top, low = F.col("ret_1m"), F.col("ret_exc_lead1m")
    ratio = F.when(low == 0, F.lit(float("inf"))).otherwise(F.coalesce(top / F.nullif(low, F.lit(0.0)), F.lit(float("nan"))))
    rows = base.panel(spark, sf_dir).withColumn("ratio", ratio).where(X.is_finite(F.col("ratio")))
    return rows.groupBy("eom").agg(F.count(F.lit(1)).alias("finite_rows"), F.avg("ratio").alias("mean_ratio"))


@register(
    "neutral_fill",
    "entity eom momentum_fill:8",
    "SELECT entity, eom, coalesce(raw_momentum, 0.5e0) AS momentum_fill FROM panel",
    PANEL,
)
def neutral_fill(spark, sf_dir):
    return base.panel(spark, sf_dir).withColumn("momentum_fill", X.neutral_fill(F.col("raw_momentum")))


VALID_VOL = "CASE WHEN vol_12m > 0 THEN vol_12m END"


@register(
    "impute_cs_median",
    "entity eom filled:10 filled_imputed",
    f"SELECT entity, eom, greatest(coalesce({VALID_VOL}, med, 0.05e0), 0.02e0) AS filled, {VALID_VOL} IS NULL AS filled_imputed "
    f"FROM panel JOIN (SELECT eom, median({VALID_VOL}) AS med FROM panel GROUP BY eom) USING (eom)",
    PANEL,
)
def impute_cs_median(spark, sf_dir):
    """Months without one valid value take the default volatility."""
    return scaling.impute_median(
        base.panel(spark, sf_dir), "vol_12m", "filled", 0.02, group_rows=base.bound(spark, sf_dir),
        default=S.VOLATILITY_DEFAULT,
    )


@register(
    "clean_volatility",
    "entity eom vol_clean:10",
    "SELECT entity, eom, coalesce(CASE WHEN vol_12m >= 0.15e0 THEN vol_12m END, med, 0.15e0) AS vol_clean FROM panel "
    "JOIN (SELECT eom, median(CASE WHEN vol_12m >= 0.15e0 THEN vol_12m END) AS med FROM panel GROUP BY eom) USING (eom)",
    PANEL,
)
def clean_volatility(spark, sf_dir):
    return scaling.clean_volatility(
        base.panel(spark, sf_dir), "vol_12m", "vol_clean", 0.15, base.bound(spark, sf_dir)
    )


@register(
    "clip",
    "entity eom clipped:8 floored:8",
    "SELECT entity, eom, CASE WHEN ret_1m < -0.1e0 THEN -0.1e0 WHEN ret_1m > 0.1e0 THEN 0.1e0 ELSE ret_1m END AS clipped, "
    "CASE WHEN ret_1m < -0.05e0 THEN -0.05e0 ELSE ret_1m END AS floored FROM panel",
    PANEL,
)
def clip(spark, sf_dir):
    ret = F.col("ret_1m")
    return base.panel(spark, sf_dir).withColumns(
        {"clipped": X.clip(ret, -0.1, 0.1), "floored": X.clip(ret, low=-0.05)}
    )


@register(
    "is_close",
    "eom close_rows:bigint far_rows:bigint",
    "SELECT eom, count(*) FILTER (WHERE coalesce(abs(rank_tax - rank_discount) <= 0.01e0 + 0.05e0 * abs(rank_discount), false)) AS close_rows, "
    "count(*) FILTER (WHERE NOT coalesce(abs(rank_tax - rank_discount) <= 0.01e0 + 0.05e0 * abs(rank_discount), false)) AS far_rows FROM panel GROUP BY eom",
    PANEL,
)
def is_close(spark, sf_dir):
    near = X.is_close(F.col("rank_tax"), F.col("rank_discount"), rtol=0.05, atol=0.01)
    return base.panel(spark, sf_dir).groupBy("eom").agg(
        F.count_if(near).alias("close_rows"), F.count_if(~near).alias("far_rows")
    )


@register(
    "max_difference",
    "eom price_gap:8 return_gap",
    "SELECT eom, max(abs(price - raw_qty)) FILTER (WHERE raw_qty IS NOT NULL) AS price_gap, "
    "max(CASE WHEN (ret_1m IS NULL) <> (ret_exc_lead1m IS NULL) THEN 1e300 ELSE coalesce(abs(ret_1m - ret_exc_lead1m), 0e0) END) > 1e299 AS return_gap "
    "FROM panel GROUP BY eom",
    PANEL,
)
def max_difference(spark, sf_dir):
    """The largest gap; a value missing on one side only makes it infinite."""
    gap = X.difference(F.col("ret_1m"), F.col("ret_exc_lead1m"))
    return base.panel(spark, sf_dir).groupBy("eom").agg(
        F.max(F.when(F.col("raw_qty").isNotNull(), X.difference(F.col("price"), F.col("raw_qty")))).alias("price_gap"),
        (F.max(gap) == F.lit(X.INFINITY)).alias("return_gap"),
    )


@register(
    "month_end_shift",
    "eom next_end prior_end quarter_end months_from_start",
    "SELECT DISTINCT eom, CAST(last_day(eom + INTERVAL 1 MONTH) AS DATE) AS next_end, CAST(last_day(eom - INTERVAL 1 MONTH) AS DATE) AS prior_end, "
    "CAST(last_day(eom + INTERVAL 3 MONTH) AS DATE) AS quarter_end, CAST(month_index - (1995 * 12 + 1) AS INTEGER) AS months_from_start FROM panel",
    PANEL,
)
def month_end_shift(spark, sf_dir):
    months = base.panel(spark, sf_dir).select("eom").distinct()
    day = F.col("eom")
    return months.select(
        "eom",
        X.month_end(day, 1).alias("next_end"),
        X.month_end(day, -1).alias("prior_end"),
        X.month_end(day, 3).alias("quarter_end"),
        (X.month_index(day) - (1995 * 12 + 1)).alias("months_from_start"),
    )


@register(
    "year_filters",
    "year kept:bigint",
    "SELECT CAST(year(eom) AS INTEGER) AS year, count(*) AS kept FROM panel WHERE year(eom) IN (1996, 1997, 1998, 1999) AND year(eom) NOT IN (1998) GROUP BY 1",
    PANEL,
)
def year_filters(spark, sf_dir):
    rows = X.exclude_years(X.in_years(base.panel(spark, sf_dir), [1996, 1997, 1998, 1999]), [1998])
    return rows.groupBy(F.year("eom").alias("year")).agg(F.count(F.lit(1)).alias("kept"))


@register(
    "calendar_buckets",
    "year period crisis rows:bigint",
    "SELECT CAST(y AS INTEGER) AS year, CASE WHEN y BETWEEN 2005 AND 2009 THEN '2005-2009' WHEN y BETWEEN 2010 AND 2014 THEN '2010-2014' "
    "WHEN y BETWEEN 2015 AND 2019 THEN '2015-2019' ELSE '2020-2024' END AS period, "
    "CASE WHEN y IN (2008, 2009) THEN 'global_financial_crisis_2008_2009' WHEN y = 2020 THEN 'covid_2020' "
    "WHEN y = 2022 THEN 'inflation_tightening_2022' ELSE 'non_crisis' END AS crisis, count(*) AS rows "
    "FROM (SELECT year(o_orderdate) + 10 + o_orderkey % 17 AS y FROM orders) GROUP BY 1, 2, 3",
)
def calendar_buckets(spark, sf_dir):
    year = (F.year("o_orderdate") + 10 + F.col("o_orderkey") % 17).cast("int")
    rows = read(spark, sf_dir, "orders").select(year.alias("year"))
    return rows.groupBy(
        "year", X.five_year_period(F.col("year")).alias("period"), X.crisis_label(F.col("year")).alias("crisis")
    ).agg(F.count(F.lit(1)).alias("rows"))


@register(
    "parse_params",
    "k:bigint events:bigint mean_value:8",
    "SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, count(*) AS events, avg(value) AS mean_value FROM events GROUP BY 1",
)
def parse_params(spark, sf_dir):
    rows = read(spark, sf_dir, "events").withColumn("p", X.parse_params(F.col("props"), {"k": "bigint"}))
    return rows.groupBy(F.col("p.k").alias("k")).agg(
        F.count(F.lit(1)).alias("events"), F.avg("value").alias("mean_value")
    )


@register(
    "candidate_id",
    "method parameters id",
    "SELECT method, parameters, substr(sha256(method || '|' || parameters), 1, 16) AS id FROM (SELECT DISTINCT o_orderpriority AS method, "
    "'{\"phi\":' || (o_orderkey % 4) || ',\"shrink\":' || (o_custkey % 3) || '}' AS parameters FROM orders)",
)
def candidate_id(spark, sf_dir):
    text = X.params_text({"shrink": F.col("o_custkey") % 3, "phi": F.col("o_orderkey") % 4})
    rows = read(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("method"), text.alias("parameters"))
    return rows.distinct().withColumn("id", X.candidate_id(F.col("method"), F.col("parameters")))


@register(
    "text_predicates",
    "feature parts:bigint has_metal:bigint",
    "SELECT regexp_replace(p_brand, '^Brand#', '') AS feature, count(*) AS parts, count(*) FILTER (WHERE contains(p_type, 'STEEL')) AS has_metal "
    "FROM part WHERE starts_with(p_brand, 'Brand#') GROUP BY 1",
)
def text_predicates(spark, sf_dir):
    rows = read(spark, sf_dir, "part").where(F.col("p_brand").startswith("Brand#"))
    return rows.groupBy(F.regexp_replace("p_brand", "^Brand#", "").alias("feature")).agg(
        F.count(F.lit(1)).alias("parts"), F.count_if(F.col("p_type").contains("STEEL")).alias("has_metal")
    )


@register(
    "first_available",
    "o_orderstatus mean_leverage:6",
    "SELECT o_orderstatus, avg(o_totalprice) AS mean_leverage FROM orders GROUP BY 1",
)
def first_available(spark, sf_dir):
    orders = read(spark, sf_dir, "orders")
    column = tables.first_available(orders, ["actual_leverage", "o_totalprice", "o_custkey"])
    return orders.groupBy("o_orderstatus").agg(F.avg(column).alias("mean_leverage"))


LABELS = {"AIR": "Air freight", "BUILDING": "Construction", "MACHINERY": "Machines"}


@register(
    "map_labels",
    "c_mktsegment label customers:bigint",
    "SELECT c_mktsegment, CASE c_mktsegment WHEN 'BUILDING' THEN 'Construction' WHEN 'MACHINERY' THEN 'Machines' ELSE c_mktsegment END AS label, "
    "count(*) AS customers FROM customer GROUP BY 1, 2",
)
def map_labels(spark, sf_dir):
    rows = X.map_labels(read(spark, sf_dir, "customer"), "c_mktsegment", LABELS, "label")
    return rows.groupBy("c_mktsegment", "label").agg(F.count(F.lit(1)).alias("customers"))


SPLIT = {
    "train": ("1995-01-01", "1998-12-31"),
    "validation": ("1999-01-01", "1999-12-31"),
    "test": ("2000-01-01", "2001-12-31"),
}


@register(
    "split_masks",
    "train_rows:bigint validation_rows:bigint test_rows:bigint overlap_rows:bigint",
    "SELECT count(*) FILTER (WHERE eom BETWEEN DATE '1995-01-01' AND DATE '1998-12-31') AS train_rows, "
    "count(*) FILTER (WHERE eom BETWEEN DATE '1999-01-01' AND DATE '1999-12-31') AS validation_rows, "
    "count(*) FILTER (WHERE eom BETWEEN DATE '2000-01-01' AND DATE '2001-12-31') AS test_rows, CAST(0 AS BIGINT) AS overlap_rows FROM panel",
    PANEL,
)
def split_masks(spark, sf_dir):
    rows = joins.split_masks(base.panel(spark, sf_dir), SPLIT)
    return joins.split_counts(rows)


ROLLING = (
    "SELECT CAST(y AS INTEGER) AS test_year, make_date(1995, 1, 1) AS train_start, make_date(y - 3, 12, 31) AS train_end, "
    "make_date(y - 2, 1, 1) AS validation_start, make_date(y - 1, 12, 31) AS validation_end, make_date(y, 1, 1) AS test_start, "
    "make_date(y, 12, 31) AS test_end FROM (SELECT DISTINCT CAST(year(eom) AS INTEGER) AS y FROM panel WHERE year(eom) >= 1998)"
)


@register(
    "rolling_splits",
    "test_year part rows:bigint first_month last_month",
    f"SELECT s.test_year, part, count(*) AS rows, min(eom) AS first_month, max(eom) AS last_month FROM panel p JOIN (SELECT test_year, part, lo, hi FROM ({ROLLING}) r, "
    "LATERAL (VALUES ('train', train_start, train_end), ('validation', validation_start, validation_end), ('test', test_start, test_end)) v(part, lo, hi)) s "
    "ON p.eom BETWEEN s.lo AND s.hi GROUP BY 1, 2",
    PANEL,
)
def rolling_splits(spark, sf_dir):
    rows = base.panel(spark, sf_dir)
    years = rows.select(F.year("eom").alias("test_year")).distinct().where("test_year >= 1998")
    splits = joins.rolling_splits(years, "1995-01-01", validation_years=2)
    return joins.split_rows(rows.select("eom", "entity"), splits).groupBy("test_year", "part").agg(
        F.count(F.lit(1)).alias("rows"), F.min("eom").alias("first_month"), F.max("eom").alias("last_month")
    )


@register(
    "training_cut",
    "test_year training_rows:bigint last_training_month",
    "SELECT CAST(y AS INTEGER) AS test_year, count(*) AS training_rows, max(eom) AS last_training_month FROM panel JOIN "
    "(SELECT DISTINCT year(eom) AS y FROM panel) ON eom <= make_date(CAST(y - 1 AS INTEGER), 11, 30) GROUP BY 1",
    PANEL,
)
def training_cut(spark, sf_dir):
    """Rows known before each test year: the label at t is next month's return, so the cut is November."""
    rows = base.panel(spark, sf_dir).select("eom", "entity")
    monthly = rows.groupBy("eom").agg(F.count(F.lit(1)).alias("n"))
    cut = joins.training_rows(monthly, monthly.select(F.year("eom").alias("test_year")).distinct())
    return cut.groupBy("test_year").agg(
        F.sum("n").alias("training_rows"), F.max("eom").alias("last_training_month")
    )


@register(
    "validation_window",
    "test_year validation_months:bigint first_month last_month",
    "SELECT test_year, count(*) AS validation_months, min(eom) AS first_month, max(eom) AS last_month FROM (SELECT CAST(y AS INTEGER) AS test_year, eom, "
    "row_number() OVER (PARTITION BY y ORDER BY eom DESC) AS back FROM (SELECT DISTINCT eom FROM panel) JOIN (SELECT DISTINCT year(eom) AS y FROM panel) "
    "ON eom <= make_date(CAST(y - 1 AS INTEGER), 11, 30)) WHERE back <= 24 GROUP BY 1",
    PANEL,
)
def validation_window(spark, sf_dir):
    months = base.panel(spark, sf_dir).select("eom").distinct()
    years = months.select(F.year("eom").alias("test_year")).distinct()
    window = joins.validation_window(joins.training_rows(months, years), ["test_year"], 24)
    return window.groupBy("test_year").agg(
        F.count(F.lit(1)).alias("validation_months"), F.min("eom").alias("first_month"), F.max("eom").alias("last_month")
    )


@register(
    "overlapping_periods",
    "left_name right_name",
    "WITH p AS (SELECT o_orderpriority || '/' || o_orderstatus AS name, min(o_orderdate) AS s, max(o_orderdate) AS e FROM orders GROUP BY 1) "
    "SELECT a.name AS left_name, b.name AS right_name FROM p a JOIN p b ON a.name < b.name AND greatest(a.s, b.s) <= least(a.e, b.e)",
)
def overlapping_periods(spark, sf_dir):
    periods = read(spark, sf_dir, "orders").groupBy(
        F.concat_ws("/", "o_orderpriority", "o_orderstatus").alias("name")
    ).agg(F.min("o_orderdate").alias("start"), F.max("o_orderdate").alias("end"))
    return joins.overlapping_periods(periods)


@register(
    "sorted_panel",
    "eom universe_rank entity place:bigint",
    "SELECT eom, universe_rank, entity, row_number() OVER (ORDER BY eom, universe_rank, entity) AS place FROM panel",
    PANEL,
)
def sorted_panel(spark, sf_dir):
    """Sort by month, rank, entity, with each row's place in that order."""
    order = [F.col("eom"), F.col("universe_rank"), F.col("entity")]
    placed = ranks.ordinal_rank(base.panel(spark, sf_dir), [], order, "place")
    return tables.sort_panel(placed)


@register(
    "sort_by_label",
    "o_orderpriority orders:bigint place:bigint",
    "SELECT o_orderpriority, count(*) AS orders, row_number() OVER (ORDER BY CASE o_orderpriority WHEN '5-LOW' THEN 1 WHEN '1-URGENT' THEN 2 ELSE 3 END, o_orderpriority) AS place "
    "FROM orders GROUP BY o_orderpriority",
)
def sort_by_label(spark, sf_dir):
    counts = read(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("orders"))
    ordered = X.sort_by_label(counts, "o_orderpriority", ["5-LOW", "1-URGENT"])
    place = F.array_position(F.array(F.lit("5-LOW"), F.lit("1-URGENT")), F.col("o_orderpriority"))
    key = F.when(place > 0, place).otherwise(3)
    return ordered.withColumn("place", F.row_number().over(W.orderBy(key, "o_orderpriority")))


@register(
    "top_k",
    "l_suppkey revenue:2",
    "SELECT l_suppkey, sum(CAST(round(l_extendedprice * 100) AS BIGINT)) / 100e0 AS revenue FROM lineitem GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
)
def top_k(spark, sf_dir):
    revenue = F.sum(F.round(F.col("l_extendedprice") * 100).cast("bigint")) / F.lit(100.0)
    sums = read(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(revenue.alias("revenue"))
    return joins.top_k(sums, [F.col("revenue").desc(), F.col("l_suppkey")], 10)


@register(
    "first_best",
    "eom entity rank_tax:10",
    "SELECT eom, entity, rank_tax FROM (SELECT *, row_number() OVER (PARTITION BY eom ORDER BY rank_tax DESC, entity) AS rn FROM panel) WHERE rn = 1",
    PANEL,
)
def first_best(spark, sf_dir):
    return joins.first_best(base.panel(spark, sf_dir), ["eom"], "rank_tax", "entity", ["rank_tax"])


@register(
    "union_frames",
    "source rows:bigint with_balance:bigint with_size:bigint",
    "SELECT 'supplier' AS source, count(*) AS rows, count(s_acctbal) AS with_balance, CAST(0 AS BIGINT) AS with_size FROM supplier "
    "UNION ALL SELECT 'customer', count(*), count(c_acctbal), 0 FROM customer UNION ALL SELECT 'part', count(*), 0, count(p_size) FROM part",
)
def union_frames(spark, sf_dir):
    """Union of tables with different columns; the missing ones are null."""
    parts = [
        read(spark, sf_dir, "supplier").select(F.lit("supplier").alias("source"), F.col("s_acctbal").alias("balance")),
        read(spark, sf_dir, "customer").select(F.lit("customer").alias("source"), F.col("c_acctbal").alias("balance")),
        read(spark, sf_dir, "part").select(F.lit("part").alias("source"), F.col("p_size").alias("size")),
    ]
    rows = joins.union_frames(*parts)
    return rows.groupBy("source").agg(
        F.count(F.lit(1)).alias("rows"), F.count("balance").alias("with_balance"), F.count("size").alias("with_size")
    )


@register(
    "union_distinct",
    "nation:bigint",
    "SELECT s_nationkey AS nation FROM supplier UNION SELECT c_nationkey FROM customer",
)
def union_distinct(spark, sf_dir):
    return joins.union_distinct(
        read(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation")),
        read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation")),
    )


@register(
    "key_difference",
    "entity:bigint month_index:int",
    "SELECT entity, month_index + 1 AS month_index FROM panel WHERE in_mid EXCEPT SELECT entity, month_index FROM panel WHERE in_mid",
    PANEL,
)
def key_difference(spark, sf_dir):
    """Names of every month's universe that the next month's has no longer."""
    rows = base.panel(spark, sf_dir).where("in_mid")
    return joins.key_difference(rows.withColumn("month_index", F.col("month_index") + 1), rows, ["entity", "month_index"])


@register(
    "key_intersection",
    "entity:bigint month_index:int",
    "SELECT entity, month_index + 1 AS month_index FROM panel WHERE in_mid INTERSECT SELECT entity, month_index FROM panel WHERE in_mid",
    PANEL,
)
def key_intersection(spark, sf_dir):
    """Names of every month's universe that the month before had too."""
    rows = base.panel(spark, sf_dir).where("in_mid")
    return joins.key_intersection(rows.withColumn("month_index", F.col("month_index") + 1), rows, ["entity", "month_index"])


THEME_SQL = "CASE feature " + " ".join(f"WHEN '{f}' THEN '{t}'" for f, t in THEMES.items()) + " END"
LONG_SQL = " UNION ALL ".join(
    f"SELECT '{f}' AS feature, entity, eom, month_index, raw_{f} AS raw_value, rank_{f} AS rank_value, ret_exc_lead1m, ret_1m FROM panel"
    for f in FEATURES
)


@register(
    "feature_themes",
    "theme features:bigint rows:bigint mean_rank:8",
    f"SELECT {THEME_SQL} AS theme, count(DISTINCT feature) AS features, count(*) AS rows, avg(rank_value) AS mean_rank FROM ({LONG_SQL}) GROUP BY 1",
    PANEL,
)
def feature_themes(spark, sf_dir):
    """Feature to theme through a label map; the map is a literal of the feature list."""
    from crosspanel.operators.performance import unpivot_features

    long = unpivot_features(base.panel(spark, sf_dir), FEATURES, ["eom"])
    return X.map_labels(long, "feature", THEMES, "theme").groupBy("theme").agg(
        F.count_distinct("feature").alias("features"),
        F.count(F.lit(1)).alias("rows"),
        F.avg("rank_value").alias("mean_rank"),
    )
