"""Walk-forward selection, scenario grids, importance and result gates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from crosspanel import settings as S
from crosspanel.functions import scalars as X
from crosspanel.operators import joins, performance


def select_cumulative(
    returns: DataFrame,
    static_methods: Sequence[str],
    first_test_year: int | None = None,
    gamma: float = S.GAMMA,
    by: Sequence[str] = ("method",),
    candidate: str = "candidate",
) -> DataFrame:
    """For every test year score each candidate on all earlier years and mark the first best.

    Yearly sums per candidate, then running sums: every year's score comes from one pass.  A null
    score counts as minus infinity.  The latest validation year is that of the rows used.
    Without a first test year every year that has an earlier one is a test year.
    """
    keys = [*by, candidate]
    g, c, u = F.col("gross_return"), F.col("trading_cost"), F.col("utility_flow")
    yearly = returns.groupBy(*keys, "test_year").agg(
        F.sum(g).alias("g"), F.sum(g * g).alias("gg"), F.count(g).alias("ng"),
        F.sum(F.when(g.isNotNull(), c)).alias("c"), F.count(F.when(g.isNotNull(), c)).alias("nc"),
        F.sum(u).alias("u"), F.count(u).alias("nu"), F.count_distinct("eom").alias("months"),
    )
    past = W.partitionBy(*keys).orderBy("test_year").rowsBetween(W.unboundedPreceding, -1)
    sums = {n: F.sum(n).over(past) for n in ("g", "gg", "ng", "c", "nc", "u", "nu", "months")}
    run = yearly.select(
        *keys, "test_year", *[v.alias(n) for n, v in sums.items()], F.count(F.lit(1)).over(past).alias("years"),
        F.max("test_year").over(past).alias("latest"),
    ).where(F.col("years") > 0 if first_test_year is None else F.col("test_year") >= first_test_year)
    mean = F.col("g") / F.nullif(F.col("ng"), F.lit(0))
    variance = F.col("gg") / F.nullif(F.col("ng"), F.lit(0)) - mean * mean
    static = mean - F.col("c") / F.nullif(F.col("nc"), F.lit(0)) - F.lit(0.5 * gamma) * variance
    other = F.col("u") / F.nullif(F.col("nu"), F.lit(0))
    score = F.when(F.col("method").isin(list(static_methods)), static).otherwise(other)
    scored = run.withColumn("score", F.coalesce(score, F.lit(float("-inf"))))
    order = W.partitionBy(*by, "test_year").orderBy(F.col("score").desc(), candidate)  # one row per candidate
    return scored.select(
        *keys, "test_year", "score", F.col("months").alias("validation_months"), F.col("years").alias("validation_years"),
        F.col("latest").alias("latest_validation_year"),
        (F.row_number().over(order) == 1).alias("selected"),
        F.coalesce(F.col("latest") >= F.col("test_year"), F.lit(False)).alias("future_information_used"),
    )


def select_split(
    returns: DataFrame, splits: DataFrame, gamma: float = S.GAMMA, by: Sequence[str] = ("method",), candidate: str = "candidate"
) -> DataFrame:
    """Validation utility of each candidate on each split's window, and the first best.

    ``splits`` has test_year, start and end of the validation window.
    """
    inside = returns.drop("test_year").join(
        F.broadcast(splits), (F.col("eom") >= F.col("start")) & (F.col("eom") <= F.col("end"))
    )
    scores = performance.validation_utility(inside, [*by, candidate, "test_year"], gamma)
    order = W.partitionBy(*by, "test_year").orderBy(F.col("validation_utility").desc(), candidate)
    return scores.withColumn("selected", F.row_number().over(order) == 1)


def selection_stability(selection: DataFrame, parameters: str = "candidate") -> DataFrame:
    """How often the choice changes, and rule violations, per method."""
    chosen = selection.where("selected")
    stats = performance.mode_stats(chosen, ["method"], parameters, "test_year")
    broken = chosen.groupBy("method").agg(
        F.count_if(F.coalesce("future_information_used", F.lit(False))).alias("future_information_violations"),
        F.count_if(F.col("latest_validation_year") >= F.col("test_year")).alias("cutoff_violations"),
    )
    return stats.join(broken, "method")


def scenarios(base: DataFrame, gammas: Sequence[float] = S.GAMMA_GRID, multipliers: Sequence[float] = S.AUM_MULTIPLIERS,
              gamma: float = S.GAMMA, aum: float = S.AUM) -> DataFrame:
    """The gamma grid and the size grid around the base settings, for each row of ``base``."""
    items = [
        F.struct(F.lit("gamma").alias("axis"), F.lit(float(g)).alias("point"), F.lit(float(g)).alias("gamma"), F.lit(float(aum)).alias("aum"))
        for g in gammas
    ] + [
        F.struct(F.lit("aum").alias("axis"), F.lit(float(m)).alias("point"), F.lit(float(gamma)).alias("gamma"), F.lit(float(m * aum)).alias("aum"))
        for m in multipliers
    ]
    return base.select("*", F.inline(F.array(*items)))


def scenario_points(returns: DataFrame, keys: Sequence[str] = ("axis", "point", "method")) -> DataFrame:
    """Metrics of every scenario and, on the size axis, the loss from the costless point."""
    points = performance.performance(returns, "gamma", keys)
    free = points.where("axis = 'aum' and point = 0").select(
        "method", F.col("annualized_ex_ante_utility_flow").alias("__free")
    )
    joined = points.join(F.broadcast(free), "method", "left")
    return joined.withColumn(
        "degradation", F.when(F.col("axis") == "aum", F.col("__free") - F.col("annualized_ex_ante_utility_flow"))
    ).drop("__free")


def check_baseline(points: DataFrame, values: Sequence[str], gamma: float = S.GAMMA, tolerance: float = 1e-12) -> DataFrame:
    """The base point of both axes must agree."""
    a = points.where(f"axis = 'gamma' and point = {gamma}")
    b = points.where("axis = 'aum' and point = 1")
    return performance.reconcile(a, b, ["method"], values, tolerance)


def utility_gaps(points: DataFrame, methods: Sequence[str], value: str) -> DataFrame:
    """Method columns per scenario and their gaps to the first method."""
    wide = points.groupBy("axis", "point").pivot("method", list(methods)).agg(F.first(value))
    return wide.withColumns({f"{m}_gap": F.col(m) - F.col(methods[0]) for m in methods[1:]})


def importance(full: DataFrame, neutral: DataFrame, value: str, by: Sequence[str], tag: str = "neutralized") -> DataFrame:
    """Metric with all features minus the metric without, its share of the positive part and rank."""
    base = full.select(*by, F.col(value).alias("__full"))
    rows = neutral.join(base, list(by)).withColumn("importance", F.col("__full") - F.col(value))
    span = W.partitionBy(*by)  # one row per feature
    positive = F.greatest(F.col("importance"), F.lit(0.0))
    total = F.sum(positive).over(span)
    return rows.select(
        *by, tag, "importance",
        F.when(total > 0, positive / total).alias("share"),
        F.rank().over(span.orderBy(F.col("importance").desc())).alias("place"),
    )


def pending(expected: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    return expected.join(done.select(*keys).distinct(), list(keys), "left_anti")


def gate(returns: DataFrame, max_leverage: float, max_turnover: float, by: Sequence[str] = ("method",)) -> DataFrame:
    """Limits on a result set, one verdict per method."""
    sums = returns.groupBy(*by).agg(
        F.max("leverage").alias("max_leverage"), F.avg("turnover").alias("mean_turnover"),
        F.count_if(F.col("net_return").isNull() | F.isnan("net_return")).alias("bad_rows"),
    )
    checks = {
        "leverage_ok": F.col("max_leverage") <= max_leverage,
        "turnover_ok": F.col("mean_turnover") <= max_turnover,
        "values_ok": F.col("bad_rows") == 0,
    }
    out = sums.withColumns(checks)
    return out.withColumn("passed", F.col("leverage_ok") & F.col("turnover_ok") & F.col("values_ok"))


def consolidate(tables: Mapping[str, DataFrame], methods: Sequence[str], labels: Mapping[str, str]) -> DataFrame:
    """Result tables of several specifications under one another, in set order with display names."""
    specs = list(tables)
    rows = joins.union_frames(*[df.withColumn("specification", F.lit(name)) for name, df in tables.items()])
    place = lambda names, c: F.array_position(F.array(*[F.lit(n) for n in names]), F.col(c))
    named = X.map_labels(rows, "method", labels, "display")
    key = place(specs, "specification") * F.lit(1000) + place(methods, "method")
    return named.withColumn("place", F.row_number().over(W.orderBy(key, "method")))
