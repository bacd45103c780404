"""Net-utility portfolio policy: design, loading recursion, sufficient statistics, coefficients, aims.

Under diagonal risk each name's loadings follow their own recursion, so they are one fold over a
name's months.  The utility statistics are sums of outer products by month; running sums give every
expanding training window and one batch of small solves gives every penalty.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from crosspanel import settings as S
from crosspanel.operators import ledger, policy, ranks, regress, scaling


def design(
    df: DataFrame, x: Sequence[str], volatility: str, constant: bool = True, floor: float = S.VOLATILITY_FLOOR,
    group_rows: int | None = None, by: Sequence[str] = ("eom",),
) -> DataFrame:
    """Neutral fill, unit norm inside the month, constant column, volatility scaling: one array."""
    filled = df.withColumns({c: F.coalesce(F.col(c), F.lit(S.NEUTRAL_RANK)) for c in x})
    normed = scaling.unit_norm(filled, x, prefix="__z_", constant="__z_const" if constant else None, by=by)
    vol = scaling.clean_volatility(normed, volatility, "__vol", floor, group_rows, by)
    names = (["__z_const"] if constant else []) + [f"__z_{c}" for c in x]
    return vol.withColumn("design", F.array(*[F.col(n) / F.col("__vol") for n in names])).drop(*names, "__vol")


def loadings(df: DataFrame, stats: DataFrame, speed: str = "speed") -> DataFrame:
    """B_t = m * grown B_{t-1} + (1 - m) * design along a name's months, from zero after a gap.

    Adds ``b`` and ``inherited_b`` arrays; a name that leaves emits one ``dropped`` row in the month
    after, with its grown loadings.
    """
    rows = ranks.attach(df, stats, ["eom"], "inner")
    item = F.struct(
        "t", "eom", "next_eom", F.col(speed).alias("m"), "design",
        ledger.grow(F.lit(1.0), F.col("ret_exc_lead1m"), F.col("growth")).alias("lift"),
        "ret_exc_lead1m", "lambda_adv", "variance", "next_median_lambda",
    )
    months = rows.groupBy("entity").agg(F.array_sort(F.collect_list(item)).alias("rows"))
    day = df.schema["eom"].dataType.simpleString()
    out_type = (
        f"array<struct<t: int, eom: {day}, next_eom: {day}, lift: double, ret_exc_lead1m: double, lambda_adv: double,"
        " variance: double, next_median_lambda: double, b: array<double>, inherited_b: array<double>>>"
    )

    def step(acc, r):
        last = F.element_at(acc, -1)
        follows = (F.size(acc) > 0) & (last["t"] == r["t"] - 1)
        inherited = F.when(follows, F.transform(last["b"], lambda v: v * last["lift"])).otherwise(
            F.transform(r["design"], lambda v: v * 0.0)
        )
        b = F.zip_with(inherited, r["design"], lambda p, d: r["m"] * p + (F.lit(1.0) - r["m"]) * d)
        nxt = F.struct(
            r["t"].cast("int").alias("t"), r["eom"].alias("eom"), r["next_eom"].alias("next_eom"), r["lift"].alias("lift"),
            r["ret_exc_lead1m"].alias("ret_exc_lead1m"), r["lambda_adv"].alias("lambda_adv"),
            r["variance"].alias("variance"), r["next_median_lambda"].alias("next_median_lambda"),
            b.alias("b"), inherited.alias("inherited_b"),
        )
        return F.concat(acc, F.array(nxt))

    scanned = months.select("entity", F.inline(F.aggregate("rows", F.array().cast(out_type), step)))
    path = W.partitionBy("entity").orderBy("t")
    stays = F.coalesce(F.lead("t").over(path) == F.col("t") + 1, F.lit(False))
    marked = scanned.withColumn("leaves", ~stays & F.col("next_eom").isNotNull())
    null = F.lit(None)
    now = F.struct(
        "eom", "b", "inherited_b", "ret_exc_lead1m", "lambda_adv", "variance", F.lit(False).alias("dropped")
    )
    gone = F.struct(
        F.col("next_eom").alias("eom"), null.cast("array<double>").alias("b"),
        F.transform("b", lambda v: v * F.col("lift")).alias("inherited_b"), null.cast("double").alias("ret_exc_lead1m"),
        F.coalesce("lambda_adv", "next_median_lambda").alias("lambda_adv"), null.cast("double").alias("variance"),
        F.lit(True).alias("dropped"),
    )
    both = F.when(F.col("leaves"), F.array(now, gone)).otherwise(F.array(now))
    return marked.select("entity", F.inline(both))


def outer_sums(df: DataFrame, vector: str, width: int, by: Sequence[str]) -> DataFrame:
    """Sum of x x' over the rows of a group, packed as the upper triangle in row order.

    Narrow vectors are summed as expressions; wide ones as one partial product per task and group.
    """
    if width <= regress.EXPRESSION_WIDTH:
        x = [F.element_at(vector, i + 1) for i in range(width)]
        cells = [F.sum(x[i] * x[j]) for i, j in regress.pairs(x)]
        return df.groupBy(*by).agg(F.array(*cells).alias("xx"))
    index = np.triu_indices(width)

    def partial(part: pd.DataFrame) -> np.ndarray:
        x = np.array(part[vector].tolist(), dtype=float)
        return (x.T @ x)[index]

    return regress.sum_positions(df, by, [vector], partial).withColumnRenamed("all", "xx")


def utility_statistics(
    scanned: DataFrame, width: int, gamma: float = S.GAMMA, aum: float = S.AUM
) -> DataFrame:
    """Month sums of B'r and gamma B'SB + A dB'LdB plus the exit term, under diagonal risk.

    Each term is an outer product of a scaled vector, so a row contributes two vectors (one when it
    has left) and the month needs a single sum of outer products.  A month with no label is left out.
    """
    scale = lambda array, size: F.transform(array, lambda v: v * size)
    risk = scale(F.col("b"), F.sqrt(F.lit(gamma) * F.col("variance")))
    cost = F.sqrt(F.lit(aum) * F.col("lambda_adv"))
    change = F.zip_with("b", "inherited_b", lambda p, q: (p - q) * cost)
    exit_ = scale(F.col("inherited_b"), cost)
    vectors = F.when(F.col("dropped"), F.array(exit_)).otherwise(F.array(risk, change))
    outer = outer_sums(scanned.select("eom", F.explode(vectors).alias("x")), "x", width, ["eom"])
    reward = [F.sum(F.element_at("b", i + 1) * F.col("ret_exc_lead1m")) for i in range(width)]
    rewards = scanned.groupBy("eom").agg(
        F.array(*[F.coalesce(r, F.lit(0.0)) for r in reward]).alias("xy"), F.count("ret_exc_lead1m").alias("labelled")
    )
    return outer.join(rewards, "eom").where("labelled > 0").select(
        "eom", "xx", "xy", F.lit(0.0).alias("yy"), F.lit(1).cast("bigint").alias("n")
    )


def solve_beta(moments: DataFrame, penalty: str = "penalty", floor: float = S.COEFFICIENT_RIDGE_FLOOR) -> DataFrame:
    """beta = (mean denominator + max(penalty, floor) I)^-1 mean numerator, with its diagnostics.

    Adds beta, objective, gradient_norm and condition; ``n`` is the number of months in the sums.
    """
    schema = "beta array<double>, objective double, gradient_norm double, condition double, beta_norm double"

    @F.pandas_udf(schema)
    def solve(xx: pd.Series, xy: pd.Series, n: pd.Series, lam: pd.Series) -> pd.DataFrame:
        r = np.array(xy.tolist(), dtype=float).reshape(len(xy), -1) / n.to_numpy(float)[:, None]
        k = r.shape[1]
        h = regress._full(np.array(xx.tolist(), dtype=float).reshape(len(xx), -1), k) / n.to_numpy(float)[:, None, None]
        h = h + np.maximum(lam.to_numpy(float), floor)[:, None, None] * np.eye(k)
        beta = np.linalg.solve(h, r[:, :, None])[:, :, 0]
        hb = np.einsum("nij,nj->ni", h, beta)
        return pd.DataFrame(
            {
                "beta": list(beta),
                "objective": np.einsum("ni,ni->n", r, beta) - 0.5 * np.einsum("ni,ni->n", beta, hb),
                "gradient_norm": np.linalg.norm(r - hb, axis=1),
                "condition": np.linalg.cond(h),
                "beta_norm": np.linalg.norm(beta, axis=1),
            }
        )

    return moments.withColumn("__s", solve("xx", "xy", F.col("n").cast("double"), F.col(penalty).cast("double"))).select(
        "*", "__s.*"
    ).drop("__s")


def aim_weights(designed: DataFrame, beta: DataFrame, on: Sequence[str]) -> DataFrame:
    """Design times coefficients; the coefficient table has one row per year and candidate."""
    from crosspanel.operators.risk import dot

    joined = designed.join(F.broadcast(beta.select(*on, *[c for c in ("penalty",) if c in beta.columns], "beta")), list(on))
    return joined.withColumn("aim_weight", dot(F.col("design"), F.col("beta"))).drop("beta")


def partial_adjustment(df: DataFrame, speed: str = "speed") -> DataFrame:
    """Trade towards the aim as terms of the position scan: a = (1 - m) aim, b = m."""
    return df.withColumns({"a": (F.lit(1.0) - F.col(speed)) * F.col("aim_weight"), "b": F.col(speed)})


def neutralize(df: DataFrame, sets: dict[str, Sequence[str]], x: Sequence[str]) -> DataFrame:
    """The panel once per named set, with that set's features at the neutral rank.

    The set table is a literal of the feature list, so this is a fixed factor of rows and no join.
    """
    items = F.array(
        *[
            F.struct(F.lit(name).alias("neutralized"), F.array(*[F.lit(c) for c in gone]).cast("array<string>").alias("__gone"))
            for name, gone in sets.items()
        ]
    )
    rows = df.select("*", F.inline(items))
    return rows.withColumns(
        {c: F.when(F.array_contains("__gone", c), F.lit(S.NEUTRAL_RANK)).otherwise(F.col(c)) for c in x}
    ).drop("__gone")
