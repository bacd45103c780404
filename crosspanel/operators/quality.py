"""Data-quality checks: each is one row (check, passed, severity, details map<string, double>).

Row checks are single combined aggregates over the panel; checks that need order (quantiles, months)
first reduce to a calendar-sized or value-counted table.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from crosspanel import settings as S
from crosspanel.functions import scalars as X
from crosspanel.operators import joins, performance, ranks, signals, windows


def _row(df: DataFrame, check: str, passed: Column, severity: str, details: Mapping[str, Column]) -> DataFrame:
    pairs = [x for name, c in details.items() for x in (F.lit(name), c.cast("double"))]
    return df.select(
        F.lit(check).alias("check"),
        F.coalesce(passed, F.lit(False)).alias("passed"),
        F.lit(severity).alias("severity"),
        F.create_map(*pairs).alias("details"),
    )


def report(*checks: DataFrame) -> DataFrame:
    """All checks under one another."""
    return reduce(DataFrame.unionByName, checks)


def _schema_row(df: DataFrame, check: str, missing: int, severity: str = "error") -> DataFrame:
    """A verdict on the schema alone, as a row that reads no data column."""
    return _row(
        df.limit(1).agg(F.count(F.lit(1)).alias("__n")), check, F.lit(missing == 0), severity,
        {"missing_columns": F.lit(float(missing))},
    )


def check_columns(df: DataFrame, required: Sequence[str]) -> DataFrame:
    return _schema_row(df, "required_columns", len(set(required) - set(df.columns)))


def check_unique(df: DataFrame, keys: Sequence[str] = ("eom", "entity")) -> DataFrame:
    """Rows that share their key with another row."""
    repeated = joins.duplicate_keys(df, keys).agg(F.coalesce(F.sum("copies"), F.lit(0)).alias("n"))
    return _row(repeated, "unique_key", F.col("n") == 0, "error", {"duplicate_rows": F.col("n")})


def check_nested(df: DataFrame, flags: Sequence[str]) -> DataFrame:
    """Each flag implies the next wider one."""
    held = [F.coalesce(F.col(f), F.lit(False)) for f in flags]
    counts = {f"{a}_not_{b}": F.count_if(x & ~y) for a, b, x, y in zip(flags, flags[1:], held, held[1:])}
    sums = df.agg(*[c.alias(n) for n, c in counts.items()])
    total = reduce(lambda p, q: p + q, [F.col(n) for n in counts])
    return _row(sums, "nested_universes", total == 0, "error", {n: F.col(n) for n in counts})


def check_coverage(df: DataFrame, flag: str, minimum: int) -> DataFrame:
    """Names per month inside a universe; a panel smaller than the threshold is not judged."""
    monthly = df.where(F.coalesce(F.col(flag), F.lit(False))).groupBy("eom").agg(
        F.count_distinct("entity").alias("n")
    )
    universe = df.agg(F.count_distinct("entity").alias("all"))
    sums = monthly.agg(
        F.min("n").alias("lo"), F.percentile("n", F.lit(0.5)).alias("mid"), F.max("n").alias("hi"),
        F.count_if(F.col("n") < minimum).alias("low"),
    ).join(F.broadcast(universe))
    small = F.col("all") < minimum
    return _row(
        sums, "monthly_coverage", small | (F.col("low") == 0), "warning",
        {
            "small_panel": small.cast("int"), "min": F.col("lo"), "median": F.col("mid"), "max": F.col("hi"),
            "months_below": F.col("low"), "threshold": F.lit(minimum),
        },
    )


def check_missing(df: DataFrame, columns: Sequence[str], limit: float = S.RAW_MISSING_RATE) -> DataFrame:
    sums = df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in columns])
    passed = reduce(lambda a, b: a & b, [F.col(c) <= limit for c in columns])
    return _row(sums, "raw_feature_coverage", passed, "warning", {c: F.col(c) for c in columns})


def check_range(df: DataFrame, columns: Sequence[str], low: float = 0.0, high: float = 1.0) -> DataFrame:
    """Values outside the range; a null is a violation."""
    inside = lambda c: F.coalesce(F.col(c).between(low, high), F.lit(False))
    sums = df.agg(*[F.count_if(~inside(c)).alias(c) for c in columns])
    total = reduce(lambda a, b: a + b, [F.col(c) for c in columns])
    return _row(sums, "ranks_in_range", total == 0, "error", {c: F.col(c) for c in columns})


def check_neutral(df: DataFrame, features: Sequence[str], value: float = S.NEUTRAL_RANK) -> DataFrame:
    """A missing raw value must have the neutral rank."""
    bad = lambda f: F.col(f"raw_{f}").isNull() & ~X.is_close(F.col(f"rank_{f}"), F.lit(value))
    sums = df.agg(*[F.count_if(bad(f)).alias(f) for f in features])
    total = reduce(lambda a, b: a + b, [F.col(f) for f in features])
    return _row(sums, "missing_features_neutral", total == 0, "error", {f: F.col(f) for f in features})


def check_label(df: DataFrame, label: str = "ret_exc_lead1m", limit: float = S.LABEL_MISSING_RATE) -> DataFrame:
    sums = df.agg(F.avg(F.col(label).isNull().cast("double")).alias("rate"))
    return _row(sums, "label_coverage", F.col("rate") <= limit, "warning", {"missing_rate": F.col("rate")})


def _invalid(column: str) -> Column:
    return ~(X.is_finite(F.col(column)) & F.coalesce(F.col(column) > 0, F.lit(False)))


def check_positive(df: DataFrame, column: str = "adv_6m") -> DataFrame:
    sums = df.agg(F.count_if(_invalid(column)).alias("n"))
    return _row(sums, f"positive_{column}", F.col("n") == 0, "error", {"invalid_rows": F.col("n")})


def check_lambda(df: DataFrame, k: float = S.LAMBDA_MULTIPLIER, rtol: float = 1e-10) -> DataFrame:
    """The impact parameter is valid and equals k over volume."""
    expected = F.lit(k) / F.nullif(F.col("adv_6m"), F.lit(0.0))
    both = X.is_finite(F.col("lambda_adv")) & X.is_finite(expected)
    sums = df.agg(
        F.count_if(_invalid("lambda_adv")).alias("invalid"),
        F.count_if(both & ~X.is_close(F.col("lambda_adv"), expected, rtol, 0.0)).alias("formula"),
    )
    return _row(
        sums, "transaction_cost_lambda", (F.col("invalid") == 0) & (F.col("formula") == 0), "error",
        {"invalid_rows": F.col("invalid"), "formula_violations": F.col("formula")},
    )


def check_tail(
    df: DataFrame, column: str = "lambda_adv", limit: float = S.LAMBDA_TAIL_RATIO, rows: int | None = None
) -> DataFrame:
    """``rows`` is a known bound of the panel's size; without it the quantiles go by value buckets."""
    points = ranks.quantiles(df, [], column, {"median": 0.5, "p99": 0.99}, rows)
    ratio = F.when(F.col("median") > 0, F.col("p99") / F.col("median"))
    return _row(
        points, "transaction_cost_extremes", F.coalesce(ratio <= limit, F.lit(True)), "warning",
        {"median": F.col("median"), "p99": F.col("p99"), "ratio": ratio},
    )


def check_min_price(df: DataFrame, flag: str, minimum: float = S.MIN_PRICE) -> DataFrame:
    low = F.coalesce(F.col("price") < minimum, F.lit(True))
    sums = df.agg(F.count_if(F.coalesce(F.col(flag), F.lit(False)) & low).alias("n"))
    return _row(sums, "minimum_price", F.col("n") == 0, "error", {"violations": F.col("n"), "min_price": F.lit(minimum)})


def check_count_jumps(df: DataFrame, flag: str, fraction: float = S.COUNT_JUMP_FRACTION) -> DataFrame:
    changes = windows.count_jumps(df.where(F.coalesce(F.col(flag), F.lit(False))), fraction)
    sums = changes.agg(F.count_if("jump").alias("n"), F.max("change").alias("largest"))
    return _row(
        sums, "universe_count_jumps", F.col("n") == 0, "warning", {"jump_months": F.col("n"), "largest": F.col("largest")}
    )


def check_market_cap(
    df: DataFrame, flag: str, column: str = "lag_mktcap", group_rows: int | None = None
) -> DataFrame:
    rows = df.where(F.coalesce(F.col(flag), F.lit(False)))
    bad = rows.agg(F.count_if(_invalid(column)).alias("n"))
    points = ranks.quantiles(
        rows.where(X.is_finite(F.col(column))), [], column, {"p01": 0.01, "median": 0.5, "p99": 0.99}, group_rows
    ).join(F.broadcast(bad))
    return _row(
        points, "market_cap_distribution", F.col("n") == 0, "warning",
        {"invalid_rows": F.col("n"), "p01": F.col("p01"), "median": F.col("median"), "p99": F.col("p99")},
    )


def check_periods(periods: DataFrame) -> DataFrame:
    hits = joins.overlapping_periods(periods).agg(F.count(F.lit(1)).alias("n"))
    return _row(hits, "sample_periods_disjoint", F.col("n") == 0, "error", {"overlapping": F.col("n")})


def check_lookahead(
    df: DataFrame, ret: str = "ret_1m", label: str = "ret_exc_lead1m", margin: float = S.LOOKAHEAD_MARGIN,
    minimum: int = S.LOOKAHEAD_ROWS,
) -> DataFrame:
    """The label must follow next month's return more closely than this month's."""
    rows = windows.row_lead(df.select("entity", "eom", ret, label), ret, "__next")
    complete = F.col(ret).isNotNull() & F.col(label).isNotNull() & F.col("__next").isNotNull()
    sums = rows.agg(
        F.count_if(complete).alias("n"),
        signals.correlation(label, ret).alias("same"),
        signals.correlation(label, "__next").alias("next"),
    )
    enough = F.col("n") >= minimum
    ok = F.coalesce(~(enough & (F.col("same") > F.col("next") + margin)), F.lit(True))
    return _row(
        sums, "lookahead", ok, "warning",
        {"observations": F.col("n"), "same_month": F.when(enough, F.col("same")), "next_month": F.when(enough, F.col("next"))},
    )


def check_risk_tables(tables: Mapping[str, DataFrame | None], required: Mapping[str, Sequence[str]]) -> DataFrame:
    """Tables and columns that are missing, one verdict per table."""
    known = [df for df in tables.values() if df is not None]
    rows = []
    for name, columns in required.items():
        df = tables.get(name)
        gone = len(columns) if df is None else len(set(columns) - set(df.columns))
        rows.append(_schema_row(df if df is not None else known[0], f"risk_{name}", gone, "warning"))
    return report(*rows)


def unit_audit(
    df: DataFrame, factor_returns: DataFrame, k: float = S.LAMBDA_MULTIPLIER, group_rows: int | None = None
) -> DataFrame:
    """Median and tails of returns, volatility, volume and factor returns, with their unit gates."""
    def spread(column: str) -> DataFrame:
        rows = df.withColumn("__v", X.finite(F.col(column)))
        return ranks.quantiles(rows, [], "__v", {"p01": 0.01, "median": 0.5, "p99": 0.99}, group_rows)

    size = ranks.quantiles(
        df.withColumn("__v", F.abs(X.finite(F.col("ret_1m")))), [], "__v", {"p99": 0.99}, group_rows
    )
    error = df.where(F.col("adv_6m") > 0).agg(
        F.max(F.abs(F.col("lambda_adv") / (F.lit(k) / F.col("adv_6m")) - 1)).alias("e")
    )
    tail = ranks.quantiles(
        factor_returns.withColumn("__v", F.abs(X.finite(F.col("factor_return")))), [], "__v", {"p999": 0.999}, group_rows
    )
    points = {"p01": F.col("p01"), "median": F.col("median"), "p99": F.col("p99")}
    return report(
        _row(spread("ret_1m").join(F.broadcast(size.withColumnRenamed("p99", "abs99"))), "unit_returns", F.col("abs99") < 1.0, "review", points),
        _row(spread("ret_exc_lead1m"), "unit_forward_returns", F.lit(True), "review", points),
        _row(spread("vol_12m"), "unit_volatility", F.lit(True), "review", points),
        _row(spread("adv_6m"), "unit_volume", F.lit(True), "review", points),
        _row(error, "unit_lambda", F.col("e") < 1e-10, "error", {"max_relative_error": F.col("e")}),
        _row(tail, "unit_factor_returns", F.col("p999") <= 0.25, "review", {"abs_p999": F.col("p999")}),
    )


def check_overlap_equal(
    a: DataFrame, b: DataFrame, keys: Sequence[str], columns: Sequence[str], tolerance: float = 1e-12
) -> DataFrame:
    """Two panels must agree on the keys of the second."""
    right = b.select(*keys, *[F.col(c).alias(f"__b_{c}") for c in columns])
    rows = a.select(*keys, *columns).join(right, list(keys))
    sums = rows.agg(
        F.count(F.lit(1)).alias("n"), *[F.max(X.difference(F.col(c), F.col(f"__b_{c}"))).alias(c) for c in columns]
    )
    passed = reduce(lambda p, q: p & q, [F.col(c) <= tolerance for c in columns])
    return _row(sums, "overlap_equal", passed, "error", {"rows": F.col("n"), **{c: F.col(c) for c in columns}})


def feature_preflight(
    df: DataFrame, features: Sequence[str], group_rows: int | None = None, max_missing: float = 0.20,
    max_jump: float = 0.15, max_corr: float = 0.90, flat: float = 0.01,
) -> DataFrame:
    """Coverage, fill, spread, redundancy and a verdict per feature."""
    long = performance.unpivot_features(df, features, ["eom"]).withColumn("year", F.year("eom"))
    yearly = performance.feature_coverage(long, ["feature", "year"])
    spread = long.groupBy("feature", "year", "eom").agg(F.stddev_samp("rank_value").alias("sd")).groupBy(
        "feature", "year"
    ).agg(F.avg("sd").alias("mean_sd"))
    years = yearly.join(spread, ["feature", "year"])
    jump = performance.yearly_jump(years, ["feature"], "missing_rate")
    bad_rank = long.groupBy("feature").agg(
        F.count_if(~F.coalesce(F.col("rank_value").between(0.0, 1.0), F.lit(False))).alias("bad_ranks"),
        F.avg(F.col("raw_value").isNull().cast("double")).alias("missing_rate"),
    )
    columns = [f"rank_{f}" for f in features]
    related = signals.correlation_summary(signals.monthly_correlations(df, columns, columns)).withColumn(
        "feature", F.regexp_replace("feature", "^rank_", "")
    )
    summary = years.groupBy("feature").agg(
        F.max("missing_rate").alias("worst_year_missing"),
        F.min("mean_sd").alias("min_year_spread"),
        F.count_if(F.col("mean_sd") < flat).alias("flat_years"),
        F.min("fill_correct_fraction").alias("min_fill_correct"),
    )
    table = reduce(lambda p, q: p.join(F.broadcast(q), "feature"), [summary, jump, bad_rank, related])
    passed = (
        (F.col("missing_rate") <= max_missing)
        & (F.coalesce(F.col("max_jump"), F.lit(0.0)) <= max_jump)
        & (F.col("min_fill_correct") == 1.0)
        & (F.col("flat_years") == 0)
        & (F.col("bad_ranks") == 0)
        & (F.col("max_abs") <= max_corr)
        & (F.col("worst_year_missing") < 1.0)
    )
    return table.withColumn("passed", F.coalesce(passed, F.lit(False)))


def check_panel_shape(df: DataFrame, rows: int, months: int, first: str, last: str) -> DataFrame:
    """Row and month counts and the date ends of a locked panel."""
    monthly = df.groupBy("eom").agg(F.count(F.lit(1)).alias("n"))
    sums = monthly.agg(
        F.sum("n").alias("rows"), F.count(F.lit(1)).alias("months"), F.min("n").alias("lo"), F.max("n").alias("hi"),
        F.min("eom").alias("first"), F.max("eom").alias("last"),
    )
    passed = (
        (F.col("rows") == rows) & (F.col("months") == months)
        & (F.col("first") == F.lit(first).cast("date")) & (F.col("last") == F.lit(last).cast("date"))
    )
    return _row(
        sums, "panel_shape", passed, "error",
        {"rows": F.col("rows"), "months": F.col("months"), "min_names": F.col("lo"), "max_names": F.col("hi")},
    )


def safety_counts(returns: DataFrame, selection: DataFrame) -> DataFrame:
    """Counters that must be zero before results are used."""
    a = returns.agg(
        F.count_if((F.col("risk_model_used") != "factor") | F.col("risk_fallback_reason").isNotNull()).alias("fallbacks"),
        F.sum("covariance_repair_count").alias("repairs"),
        F.count_if(F.col("net_return").isNull()).alias("missing_returns"),
    )
    b = selection.agg(
        F.count_if("future_information_used").alias("future"),
        F.count_if(F.col("latest_validation_year") >= F.col("test_year")).alias("cutoff"),
    )
    names = ("fallbacks", "repairs", "missing_returns", "future", "cutoff")
    total = reduce(lambda p, q: p + q, [F.col(n) for n in names])
    return _row(a.join(F.broadcast(b)), "safety_counters", total == 0, "error", {n: F.col(n) for n in names})


def check_result_columns(returns: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Result columns that exist and hold values."""
    have = [c for c in columns if c in returns.columns]
    sums = returns.agg(*[F.count(c).alias(c) for c in have]) if have else returns.agg(F.count(F.lit(1)).alias("__n"))
    items = F.array(
        *[
            F.struct(
                F.lit(c).alias("column_name"), F.lit(c in have).alias("present"),
                (F.col(c) if c in have else F.lit(0).cast("bigint")).alias("values"),
            )
            for c in columns
        ]
    )
    return sums.select(F.inline(items)).withColumn("usable", F.col("present") & (F.col("values") > 0))


def check_same_statistic(
    a: DataFrame, b: DataFrame, keys: Sequence[str], columns: Sequence[str], tolerance: float = 1e-10
) -> DataFrame:
    """The same statistic from two tables must agree."""
    gaps = performance.reconcile(a, b, keys, columns, tolerance)
    sums = gaps.agg(F.max("max_difference").alias("gap"), F.min(F.col("passed").cast("int")).alias("ok"))
    return _row(sums, "same_statistic", F.col("ok") == 1, "error", {"max_difference": F.col("gap")})
