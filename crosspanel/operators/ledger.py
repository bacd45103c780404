"""Holdings ledger: grown positions, trades, quadratic costs, exits and monthly evaluation.

Positions carry from one month to the next by a join on the month number, so every month of every
policy is priced at once.  Where a policy needs last month's position to choose this month's, the
position is an affine recursion per entity (``affine_scan``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from crosspanel import settings as S
from crosspanel.operators import ranks

HOLDING = ("method",)


def valid_months(panel: DataFrame) -> DataFrame:
    """Months with any forward return, numbered 1, 2, ... in order (calendar-sized)."""
    months = panel.groupBy("eom").agg(F.count("ret_exc_lead1m").alias("labelled"))
    return months.where(F.col("labelled") > 0).select("eom", F.row_number().over(W.orderBy("eom")).alias("t"))


def month_stats(panel: DataFrame, group_rows: int | None = None) -> DataFrame:
    """Calendar table of the ledger: month number, growth, median impact, and the month that follows.

    ``growth`` carries month t's holdings into t+1: 1 + cap-weighted forward return, floored.  A month
    with no usable caps keeps the growth that was just used; the first one starts at 1.
    """
    cap, ret = F.col("lag_mktcap"), F.col("ret_exc_lead1m")
    usable = cap.isNotNull() & (cap > 0) & ret.isNotNull()
    sums = [
        F.count("ret_exc_lead1m").alias("labelled"),
        F.sum(F.when(usable, cap * ret)).alias("num"),
        F.sum(F.when(usable, cap)).alias("den"),
    ]
    if ranks.fits_one_task(group_rows):
        months = panel.groupBy("eom").agg(*sums, F.percentile("lambda_adv", F.lit(0.5)).alias("median_lambda"))
    else:
        medians = ranks.quantiles(panel, ["eom"], "lambda_adv", {"median_lambda": 0.5})
        months = panel.groupBy("eom").agg(*sums).join(medians, "eom")
    raw = F.when(
        F.col("den") > 0, F.greatest(F.lit(1.0) + F.col("num") / F.col("den"), F.lit(S.GROWTH_FLOOR))
    )
    path = W.orderBy("eom")  # one row per month
    known = path.rowsBetween(W.unboundedPreceding, 0)
    numbered = months.where(F.col("labelled") > 0).select(
        "eom",
        F.row_number().over(path).alias("t"),
        F.coalesce(F.last(raw, ignorenulls=True).over(known), F.lit(1.0)).alias("growth"),
        "median_lambda",
    )
    return numbered.select(
        "*",
        F.lag("growth", 1, 1.0).over(path).alias("wealth_growth"),
        F.lead("eom").over(path).alias("next_eom"),
        F.lead("median_lambda").over(path).alias("next_median_lambda"),
    )


def market_growth(panel: DataFrame) -> DataFrame:
    return month_stats(panel, group_rows=None).select("eom", "t", "growth")


def grow(weight, ret, growth):
    """Holdings after the month: a missing return earns nothing."""
    return weight * (F.lit(1.0) + F.coalesce(ret, F.lit(0.0))) / growth


def affine_scan(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    a: str,
    b: str,
    output: str,
    carry: Sequence[str] = (),
    lift: str | None = None,
) -> DataFrame:
    """x = a + b * (previous x, lifted) along ``order`` inside ``keys``; starts at 0 and after a gap.

    ``lift`` names a column of the previous row that its x is multiplied by on the way.  One key holds
    at most one row per month (two are an error), so the sorted array of a key is calendar-bounded.  The fold carries
    bare numbers; the other columns are put back by position.
    """
    row = F.struct(
        F.col(order).alias("o"), F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b"),
        (F.col(lift) if lift else F.lit(1.0)).alias("l"), *[F.col(c) for c in carry],
    )
    grouped = df.groupBy(*keys).agg(F.array_sort(F.collect_list(row)).alias("rows"))
    distinct = F.size(F.array_distinct(F.transform("rows", lambda r: r["o"]))) == F.size("rows")
    repeated = F.raise_error(F.lit(f"a key has two rows of one {order}"))
    grouped = grouped.withColumn("rows", F.when(distinct, F.col("rows")).otherwise(repeated))
    start = F.struct(
        F.lit(None).cast(df.schema[order].dataType).alias("o"), F.lit(0.0).alias("held"),
        F.array().cast("array<struct<x: double, prior: double>>").alias("path"),
    )

    def step(acc, item):
        prior = F.when(acc["o"] == item["o"] - 1, acc["held"]).otherwise(F.lit(0.0))
        x = item["a"] + item["b"] * prior
        point = F.struct(x.alias("x"), prior.alias("prior"))
        return F.struct(
            item["o"].alias("o"), (x * item["l"]).alias("held"), F.concat(acc["path"], F.array(point)).alias("path")
        )

    path = F.aggregate("rows", start, step, lambda acc: acc["path"])
    scanned = grouped.select(*keys, F.inline(F.zip_with("rows", path, lambda r, p: F.struct(
        r["o"].alias(order), p["x"].alias(output), p["prior"].alias(f"prior_{output}"), *[r[c].alias(c) for c in carry]
    ))))
    return scanned


def with_state(rows: DataFrame, state: DataFrame, stats: DataFrame) -> DataFrame:
    """Put carried-in holdings in front of the first month as month 0."""
    first = stats.where("t = 1").select(
        F.col("eom").alias("next_eom"), F.col("median_lambda").alias("next_median_lambda")
    )
    zero = state.select(
        *[c for c in state.columns if c != "growth"], F.lit(0).alias("t"), "growth",
        F.lit(1.0).alias("wealth_growth"),
    ).join(F.broadcast(first))
    return rows.unionByName(zero, allowMissingColumns=True)


def last_state(holdings: DataFrame, stats: DataFrame, keys: Sequence[str] = HOLDING) -> DataFrame:
    """Holdings, returns, impact and growth of the last month: what a resumed run starts from."""
    last = stats.orderBy(F.col("t").desc()).limit(1).select("eom", "growth")
    return holdings.join(F.broadcast(last), "eom").select(
        *keys, "entity", "weight", "ret_exc_lead1m", "lambda_adv", "growth"
    )


def value_weighted_state(panel: DataFrame, stats: DataFrame, keys: DataFrame) -> DataFrame:
    """Start from the first month's cap weights, with no return and no growth, for each key row."""
    from crosspanel.operators.policy import value_weight

    first = stats.where("t = 1").select("eom")
    rows = value_weight(panel.join(F.broadcast(first), "eom", "left_semi"))
    start = rows.select(
        "entity", "weight", F.lit(0.0).alias("ret_exc_lead1m"), "lambda_adv", F.lit(1.0).alias("growth")
    )
    return start.join(F.broadcast(keys))


def carry_positions(
    holdings: DataFrame,
    stats: DataFrame,
    keys: Sequence[str] = HOLDING,
    carry: Sequence[str] = (),
    state: DataFrame | None = None,
) -> DataFrame:
    """Month-t rows for every name held in t or in t-1.

    ``holdings`` has keys, eom, entity, weight, ret_exc_lead1m, lambda_adv and the ``carry`` columns.
    A name that is not held in the next month emits one more row there, marked ``dropped``, with a null
    weight.  The window is one entity's months, so no join of the holdings with themselves is needed.
    """
    rows = ranks.attach(holdings, stats, ["eom"], "inner")
    if state is not None:
        rows = with_state(rows, state, stats)
    rows = rows.withColumn("grown", grow(F.col("weight"), F.col("ret_exc_lead1m"), F.col("growth")))
    path = W.partitionBy(*keys, "entity").orderBy("t")
    follows = F.lag("t").over(path) == F.col("t") - 1
    stays = F.coalesce(F.lead("t").over(path) == F.col("t") + 1, F.lit(False))
    rows = rows.withColumns(
        {
            "inherited": F.coalesce(F.when(follows, F.lag("grown").over(path)), F.lit(0.0)),
            "leaves": ~stays & F.col("next_eom").isNotNull(),
        }
    )
    null = F.lit(None).cast("double")
    now = F.struct(
        F.col("eom"), F.col("t"), F.col("weight"), F.col("ret_exc_lead1m"), F.col("lambda_adv"),
        F.col("inherited"), null.alias("exit_lambda"), F.col("wealth_growth"),
        F.lit(False).alias("dropped"), *[F.col(c) for c in carry],
    )
    gone = F.struct(
        F.col("next_eom").alias("eom"), (F.col("t") + 1).alias("t"), null.alias("weight"),
        null.alias("ret_exc_lead1m"), null.alias("lambda_adv"), F.col("grown").alias("inherited"),
        F.coalesce("lambda_adv", "next_median_lambda").alias("exit_lambda"),
        F.col("growth").alias("wealth_growth"), F.lit(True).alias("dropped"),
        *[F.lit(None).cast(holdings.schema[c].dataType).alias(c) for c in carry],
    )
    both = F.when(F.col("leaves"), F.array(now, gone)).otherwise(F.array(now))
    out = rows.select(*keys, "entity", F.inline(both)).withColumn(
        "trade", F.col("weight") - F.col("inherited")
    )
    return out.where("t > 0") if state is not None else out


def dropped(carried: DataFrame) -> DataFrame:
    """Names held last month and not in this one."""
    return carried.where("dropped")


def evaluate(
    carried: DataFrame,
    keys: Sequence[str] = HOLDING,
    aum: float | str = S.AUM,
    gamma: float | str = S.GAMMA,
    charge_exit: bool = True,
    variance: DataFrame | None = None,
) -> DataFrame:
    """One row per month and policy: returns, costs, turnover, leverage, utility flow.

    ``aum`` and ``gamma`` are numbers or key columns of a scenario.  Risk is either an entity column
    ``variance`` (diagonal) or a table of portfolio variances by month and policy.
    """
    size = F.col(aum) if isinstance(aum, str) else F.lit(float(aum))
    aversion = F.col(gamma) if isinstance(gamma, str) else F.lit(float(gamma))
    w, lam = F.col("weight"), F.col("lambda_adv")
    exit_term = F.col("exit_lambda") * F.col("inherited") ** 2 if charge_exit else F.lit(0.0)
    measures = [
        F.sum(w * F.coalesce("ret_exc_lead1m", F.lit(0.0))).alias("gross_return"),
        F.sum(lam * F.col("trade") ** 2).alias("__trade_sq"),
        F.coalesce(F.sum(exit_term), F.lit(0.0)).alias("__exit_sq"),
        F.sum(F.abs(F.when(F.col("dropped"), F.col("inherited")).otherwise(F.col("trade")))).alias("turnover"),
        F.sum(F.abs(w)).alias("leverage"),
        F.sum(F.when(w > 0, w).otherwise(w * 0.0)).alias("long_exposure"),
        F.sum(F.when(w < 0, -w).otherwise(w * 0.0)).alias("short_exposure"),
        F.count_if(w != 0).alias("n_names"),
        F.count_if("dropped").alias("dropped_names"),
        F.sum(F.abs(w) * lam).alias("__weighted_lambda"),
        F.max("lambda_adv").alias("max_lambda_adv"),
        F.max("wealth_growth").alias("wealth_growth"),
        F.max(F.abs(w)).alias("max_abs_weight"),
    ]
    if variance is None and "variance" in carried.columns:
        measures.append(F.sum(w * w * F.col("variance")).alias("ex_ante_monthly_variance"))
    sums = carried.groupBy("eom", "t", *keys).agg(*measures).where(F.col("leverage").isNotNull())
    if variance is not None:
        sums = sums.join(variance, ["eom", *keys], "left")
    elif "variance" not in carried.columns:
        sums = sums.withColumn("ex_ante_monthly_variance", F.lit(0.0))
    return (
        sums.withColumn("exit_cost", size / 2 * F.col("__exit_sq"))
        .withColumn("trading_cost", size / 2 * F.col("__trade_sq") + F.col("exit_cost"))
        .withColumn("net_return", F.col("gross_return") - F.col("trading_cost"))
        .withColumn(
            "weighted_lambda_exposure",
            F.when(F.col("leverage") > 0, F.col("__weighted_lambda") / F.col("leverage")).otherwise(0.0),
        )
        .withColumn(
            "utility_flow",
            F.col("net_return") - F.lit(0.5) * aversion * F.col("ex_ante_monthly_variance"),
        )
        .withColumn("test_year", F.year("eom"))
        .drop("__trade_sq", "__exit_sq", "__weighted_lambda")
    )


def ledger(
    holdings: DataFrame,
    stats: DataFrame,
    keys: Sequence[str] = HOLDING,
    aum: float | str = S.AUM,
    gamma: float | str = S.GAMMA,
    variance: DataFrame | None = None,
    state: DataFrame | None = None,
) -> DataFrame:
    """Price any table of monthly weights into monthly returns."""
    carry = [c for c in ("variance",) if c in holdings.columns and variance is None]
    carried = carry_positions(holdings, stats, keys, carry, state)
    return evaluate(carried, keys, aum, gamma, variance=variance)


def inherited_weights(
    terms: DataFrame, stats: DataFrame, keys: Sequence[str] = HOLDING, state: DataFrame | None = None
) -> DataFrame:
    """Holdings of policies w = a + b * inherited, for every key, candidate and month at once.

    ``terms`` has keys, eom, entity, a, b, ret_exc_lead1m, lambda_adv and more columns to keep.  The
    position is scanned per (keys, entity): b is multiplied by the growth of last month's position.
    """
    rows = ranks.attach(terms, stats.select("eom", "t", "growth"), ["eom"], "inner")
    if state is not None:
        start = state.select(
            *keys, "entity", F.col("weight").alias("a"), F.lit(0.0).alias("b"), "ret_exc_lead1m",
            "lambda_adv", F.lit(0).alias("t"), "growth",
        )
        rows = rows.unionByName(start, allowMissingColumns=True)
    rows = rows.withColumn("__lift", grow(F.lit(1.0), F.col("ret_exc_lead1m"), F.col("growth")))
    keep = [c for c in terms.columns if c not in (*keys, "entity", "a", "b", "t")]
    out = affine_scan(rows, [*keys, "entity"], "t", "a", "b", "weight", carry=keep, lift="__lift")
    return out.where("t > 0") if state is not None else out


def grid_ledger(
    terms: DataFrame,
    stats: DataFrame,
    keys: Sequence[str],
    aum: float | str = S.AUM,
    gamma: float | str = S.GAMMA,
    state: DataFrame | None = None,
) -> DataFrame:
    """Positions and pricing of inherited-weight policies over a grid of scenarios and candidates."""
    held = inherited_weights(terms, stats, keys, state).drop("t")
    return ledger(held, stats, keys, aum, gamma, state=state)


def reconcile_ledger(carried: DataFrame, returns: DataFrame, keys: Sequence[str], aum: float) -> DataFrame:
    """Rebuild costs from the stock rows and compare with the monthly table."""
    rebuilt = carried.groupBy("eom", *keys).agg(
        F.sum(F.lit(aum / 2.0) * F.col("lambda_adv") * F.col("trade") ** 2).alias("__cost"),
        F.max(F.abs(F.col("trade") - (F.col("weight") - F.col("inherited")))).alias("__identity"),
    )
    gap = F.abs(F.col("__cost") - (F.col("trading_cost") - F.col("exit_cost")))
    utility = F.abs(
        F.col("utility_flow") - (F.col("net_return") - F.lit(0.5 * S.GAMMA) * F.col("ex_ante_monthly_variance"))
    )
    return returns.join(rebuilt, ["eom", *keys]).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("months"),
        F.max(gap).alias("max_cost_gap"),
        F.max("__identity").alias("max_trade_gap"),
        F.max(utility).alias("max_utility_gap"),
    ).withColumn(
        "passed",
        (F.col("max_cost_gap") <= 1e-12) & (F.col("max_trade_gap") <= 1e-12) & (F.col("max_utility_gap") <= 1e-12),
    )


def ledger_warnings(returns: DataFrame, max_weight: float = 5.0, max_leverage: float = 20.0) -> DataFrame:
    """One row per warning: a large single weight or a large leverage."""
    notes = F.array(
        F.when(F.col("max_abs_weight") > max_weight, F.lit("max abs weight")),
        F.when(F.col("leverage") > max_leverage, F.lit("leverage")),
    )
    rows = returns.select("eom", "method", F.explode(F.array_compact(notes)).alias("kind"))
    return rows.withColumn(
        "warning", F.concat_ws(" ", F.concat(F.col("eom").cast("string"), F.lit(":")), "method", "kind")
    )


def mechanisms(
    carried: DataFrame, deciles: DataFrame, aum: float, group_rows: int | None = None, by=("eom", "method")
) -> DataFrame:
    """Stock-level trading mechanism per month and policy.

    ``carried`` needs weight, inherited, trade, lambda_adv, adv_6m and aim_weight (null where a policy has none).
    """
    rows = carried.where("not dropped").join(deciles.select("eom", "entity", "decile"), ["eom", "entity"])
    rows = rows.withColumns(
        {
            "abs_weight": F.abs("weight"),
            "abs_trade": F.abs("trade"),
            "stock_cost": F.lit(0.5 * aum) * F.col("lambda_adv") * F.col("trade") ** 2,
            "aim_delta": F.col("aim_weight") - F.col("inherited"),
        }
    )
    rows = ranks.ordinal_rank(rows, by, [-F.col("stock_cost"), F.col("entity")], "__by_cost", group_rows, count="__names")
    rows = ranks.ordinal_rank(rows, by, [-F.col("abs_trade"), F.col("entity")], "__by_trade", group_rows)
    top = F.greatest(F.lit(1).cast("bigint"), F.ceil(F.lit(0.1) * F.col("__names")))
    cost, w, lam = F.col("stock_cost"), F.col("abs_weight"), F.col("lambda_adv")
    total, gross = F.sum(cost), F.sum(w)
    out = rows.groupBy(*by).agg(
        total.alias("within_cost"),
        gross.alias("gross_weight"),
        F.when(gross > 0, F.sum(F.col("adv_6m") * w) / gross).alias("weighted_adv"),
        F.when(gross > 0, F.sum(lam * w) / gross).alias("weighted_lambda"),
        F.when(gross > 0, F.sum(F.when(F.col("decile") == 1, w).otherwise(0.0)) / gross).alias("low_adv_share"),
        F.when(gross > 0, F.sum(F.when(F.col("decile") == 10, w).otherwise(0.0)) / gross).alias("high_adv_share"),
        F.when(total > 0, F.sum(F.when(F.col("__by_cost") <= top, cost)) / total).alias("top_names_cost_share"),
        F.when(total > 0, F.sum(F.when(F.col("__by_trade") <= top, cost)) / total).alias("top_trades_cost_share"),
        F.sum("abs_trade").alias("trade_l1"),
        F.sqrt(F.sum(F.col("trade") ** 2)).alias("trade_l2"),
        F.sqrt(F.sum(lam * F.col("trade") ** 2)).alias("trade_lambda"),
        F.sum(F.abs("aim_delta")).alias("aim_l1"),
        F.sqrt(F.sum(lam * F.col("aim_delta") ** 2)).alias("aim_lambda"),
        F.sum(F.lit(0.5 * aum) * lam * F.col("aim_delta") ** 2).alias("aim_cost"),
    )
    return out.withColumns(
        {
            "l1_ratio": F.when(F.col("aim_l1") > 0, F.col("trade_l1") / F.col("aim_l1")),
            "lambda_ratio": F.when(F.col("aim_lambda") > 0, F.col("trade_lambda") / F.col("aim_lambda")),
        }
    )


def mechanism_scopes(monthly: DataFrame, paths: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Monthly mechanism rows with paths and cost ratios, and their yearly means, as one table."""
    cost, gross = F.col("trading_cost"), F.abs("gross_return")
    month = monthly.join(paths, ["eom", "method"]).withColumns(
        {
            "exit_share": F.when(cost > 0, F.col("exit_cost") / cost),
            "coverage": F.when(cost > 0, F.col("within_cost") / cost),
            "near_zero_gross": gross < 1e-4,
            "cost_to_gross": cost / F.greatest(gross, F.lit(1e-4)),
            "year": F.year("eom"),
        }
    )
    year = month.groupBy("method", "year").agg(
        *[F.avg(c).alias(c) for c in [*columns, "exit_share"]],
        (F.lit(12.0) * F.avg("gross_return")).alias("gross_return"),
        (F.lit(12.0) * F.avg("trading_cost")).alias("trading_cost"),
    ).withColumns(
        {
            "near_zero_gross": F.abs("gross_return") < 0.005,
            "cost_to_gross": F.col("trading_cost") / F.greatest(F.abs("gross_return"), F.lit(0.005)),
        }
    )
    return month.withColumn("scope", F.lit("month")).unionByName(
        year.withColumn("scope", F.lit("year")), allowMissingColumns=True
    )
