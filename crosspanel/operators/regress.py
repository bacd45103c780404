"""Regression from distributed sufficient statistics.

Moments are summed once per month; a running sum over months then gives every expanding training
window, and each small normal equation is solved on its own row, for all penalties at once.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from functools import reduce
from itertools import combinations_with_replacement
from operator import and_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from crosspanel import settings as S
from crosspanel.operators import ranks

EXPRESSION_WIDTH = 24  # widest design whose Gram is summed as column expressions


def pairs(names: Sequence[str]) -> list[tuple[int, int]]:
    return list(combinations_with_replacement(range(len(names)), 2))


def gram(df: DataFrame, x: Sequence[str], y: str, by: Sequence[str]) -> DataFrame:
    """Upper triangle of X'X with intercept, X'y, y'y and n as sums per group; null targets dropped.

    Column order of the packed arrays: intercept first, then ``x``; ``xx`` row by row.
    Rows are combined on the map side: what is shuffled is one array per task and group.
    """
    rows = df.where(F.col(y).isNotNull())
    if len(x) > EXPRESSION_WIDTH:
        return _gram_wide(rows, x, y, by)
    z = [F.lit(1.0), *[F.col(c) for c in x]]
    sums = [F.sum(z[i] * z[j]) for i, j in pairs(z)]
    return rows.groupBy(*by).agg(
        F.array(*sums).alias("xx"),
        F.array(*[F.sum(c * F.col(y)) for c in z]).alias("xy"),
        F.sum(F.col(y) * F.col(y)).alias("yy"),
        F.count(F.lit(1)).alias("n"),
    )


def sum_positions(
    rows: DataFrame, by: Sequence[str], columns: Sequence[str], partial: Callable[[pd.DataFrame], np.ndarray]
) -> DataFrame:
    """Sum a long vector per group: ``partial`` gives the vector of a slice of one group's rows.

    A task adds its slices up over all of its Arrow batches and emits each group once, so what is
    shuffled is one vector per task and group; positions are then summed with a map-side combine.
    """
    by = list(by)
    schema = T.StructType(
        [rows.schema[c] for c in by]
        + [T.StructField("position", T.IntegerType()), T.StructField("v", T.DoubleType())]
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals: dict[tuple, np.ndarray] = {}
        for batch in batches:
            for key, part in batch.groupby(by, sort=False, dropna=False):
                key = key if isinstance(key, tuple) else (key,)
                v = partial(part)
                totals[key] = totals[key] + v if key in totals else v
        for key, v in totals.items():
            out = pd.DataFrame({"position": np.arange(len(v), dtype="int32"), "v": v})
            for name, value in zip(by, key):
                out[name] = value
            yield out[[*by, "position", "v"]]

    summed = rows.select(*by, *columns).mapInPandas(run, schema).groupBy(*by, "position").agg(F.sum("v").alias("v"))
    return summed.groupBy(*by).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("position", "v"))), lambda p: p["v"]).alias("all")
    )


def _gram_wide(rows: DataFrame, x: Sequence[str], y: str, by: Sequence[str]) -> DataFrame:
    """Designs too wide for column expressions."""
    x = list(x)
    index = np.triu_indices(len(x) + 1)

    def partial(part: pd.DataFrame) -> np.ndarray:
        z = np.column_stack([np.ones(len(part)), part[x].to_numpy(float)])
        t = part[y].to_numpy(float)
        return np.concatenate([(z.T @ z)[index], z.T @ t, [t @ t, len(part)]])

    packed = sum_positions(rows, by, [*x, y], partial)
    m, k = len(index[0]), len(x) + 1
    return packed.select(
        *by,
        F.slice("all", 1, m).alias("xx"),
        F.slice("all", m + 1, k).alias("xy"),
        F.element_at("all", m + k + 1).alias("yy"),
        F.element_at("all", m + k + 2).cast("bigint").alias("n"),
    )


def running_gram(monthly: DataFrame, order: str, by: Sequence[str] = ()) -> DataFrame:
    """Expanding sums of month moments, unpacked to positions so that windows do the sums."""
    packed = F.concat("xx", "xy", F.array(F.col("yy"), F.col("n").cast("double")))
    long = monthly.select(
        *by, order, F.size("xx").alias("mx"), F.size("xy").alias("mk"), F.posexplode(packed).alias("position", "v")
    )
    path = W.partitionBy(*by, "position").orderBy(order)  # one row per month
    summed = long.withColumn("v", F.sum("v").over(path.rowsBetween(W.unboundedPreceding, 0)))
    out = summed.groupBy(*by, order, "mx", "mk").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("position", "v"))), lambda p: p["v"]).alias("all")
    )
    return out.select(
        *by, order,
        F.slice("all", F.lit(1), F.col("mx")).alias("xx"),
        F.slice("all", F.col("mx") + 1, F.col("mk")).alias("xy"),
        F.element_at("all", F.col("mx") + F.col("mk") + 1).alias("yy"),
        F.element_at("all", F.col("mx") + F.col("mk") + 2).cast("bigint").alias("n"),
    )


def _full(packed: np.ndarray, k: int) -> np.ndarray:
    """Packed upper triangles (rows, k(k+1)/2) to symmetric matrices (rows, k, k)."""
    upper = np.zeros((len(packed), k, k))
    i, j = np.triu_indices(k)
    upper[:, i, j] = packed
    upper[:, j, i] = packed
    return upper


def ridge_fit(moments: DataFrame, penalty: str, standardise: bool = True) -> DataFrame:
    """Add ``coef`` (intercept first) on the original scale of the features for each moment row.

    The intercept is not penalised.  ``standardise`` scales features by their population deviation
    (a flat feature by 1), so the penalty acts on standardised coefficients.  Rows are independent and
    small; a batch of them is solved together.
    """

    @F.pandas_udf("array<double>")
    def solve(xx: pd.Series, xy: pd.Series, n: pd.Series, lam: pd.Series) -> pd.Series:
        if not len(xx):
            return pd.Series([], dtype=object)
        b = np.array(xy.tolist(), dtype=float)
        k = b.shape[1]
        count = n.to_numpy(float)
        g = _full(np.array(xx.tolist(), dtype=float), k) / count[:, None, None]
        r = b / count[:, None]
        mean = g[:, 0, 1:]
        if standardise:
            square = np.einsum("nii->ni", g[:, 1:, 1:])
            variance = square - mean**2
            scale = np.sqrt(np.maximum(variance, 0.0))
            # A flat feature leaves only rounding noise after the mean is taken out of its moment.
            scale[(scale < S.SCALE_FLOOR) | (variance <= 1e-13 * square)] = 1.0
            centred = g[:, 1:, 1:] - mean[:, :, None] * mean[:, None, :]
            lhs = centred / scale[:, :, None] / scale[:, None, :]
            rhs = (r[:, 1:] - mean * r[:, :1]) / scale
        else:
            # Eliminating the free intercept leaves the same centred system.
            scale = np.ones_like(mean)
            lhs = g[:, 1:, 1:] - mean[:, :, None] * mean[:, None, :]
            rhs = r[:, 1:] - mean * r[:, :1]
        lhs = lhs + lam.to_numpy(float)[:, None, None] * np.eye(k - 1)
        slope = np.linalg.pinv(lhs, hermitian=True) @ rhs[:, :, None]
        slope = slope[:, :, 0] / scale
        intercept = r[:, 0] - np.einsum("ni,ni->n", mean, slope)
        return pd.Series(list(np.column_stack([intercept, slope])))

    return moments.withColumn("coef", solve("xx", "xy", "n", F.col(penalty).cast("double")))


def least_squares(moments: DataFrame) -> DataFrame:
    """Ordinary least squares with intercept: the ridge fit with no penalty."""
    return ridge_fit(moments.withColumn("__zero", F.lit(0.0)), "__zero", standardise=False).drop("__zero")


def contributions(df: DataFrame, coef: DataFrame, x: Sequence[str], on: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Mean absolute and signed part of each feature in the fitted value, and its share."""
    joined = df.join(F.broadcast(coef.select(*on, "coef")), list(on))
    items = F.array(
        *[
            F.struct(F.lit(c).alias("feature"), (F.element_at("coef", i + 2) * F.col(c)).alias("part"))
            for i, c in enumerate(x)
        ]
    )
    sums = joined.select(*by, F.inline(items)).groupBy(*by, "feature").agg(
        F.avg(F.abs("part")).alias("mean_abs"), F.avg("part").alias("mean_signed")
    )
    total = F.sum("mean_abs").over(W.partitionBy(*by))  # one row per feature
    return sums.withColumn("share", F.when(total > 0, F.col("mean_abs") / total))


def design_health(monthly: DataFrame, width: int) -> DataFrame:
    """Norms, means, near-zero and duplicate columns, rank and condition of each month's design.

    Everything is read off the packed month moments (intercept in first place).  Squared moments hold
    singular values down to about 1e-7 of the largest, so the rank is counted there.
    """
    schema = (
        "min_norm double, median_norm double, max_norm double, max_abs_mean double, near_zero int,"
        " duplicates int, effective_rank int, condition double"
    )

    @F.pandas_udf(schema)
    def health(xx: pd.Series, n: pd.Series) -> pd.DataFrame:
        k = width + 1
        g = _full(np.array(xx.tolist(), dtype=float).reshape(len(xx), -1), k)
        x = g[:, 1:, 1:]
        norms = np.sqrt(np.maximum(np.einsum("nii->ni", x), 0.0))
        means = g[:, 0, 1:] / n.to_numpy(float)[:, None]
        safe = np.maximum(norms, 1e-16)
        unit = np.abs(x / safe[:, :, None] / safe[:, None, :])
        i, j = np.triu_indices(width, 1)
        values = np.sqrt(np.clip(np.linalg.eigvalsh(x), 0.0, None))
        top = values.max(axis=1)
        return pd.DataFrame(
            {
                "min_norm": norms.min(axis=1),
                "median_norm": np.median(norms, axis=1),
                "max_norm": norms.max(axis=1),
                "max_abs_mean": np.abs(means).max(axis=1),
                "near_zero": (norms < 1e-10).sum(axis=1).astype("int32"),
                "duplicates": (unit[:, i, j] > 1.0 - 1e-12).sum(axis=1).astype("int32"),
                "effective_rank": (values > np.maximum(top * 1e-7, 1e-12)[:, None]).sum(axis=1).astype("int32"),
                "condition": top / np.maximum(values.min(axis=1), 1e-16),
            }
        )

    return monthly.withColumn("h", health("xx", F.col("n").cast("double"))).select("eom", "n", "h.*")


def predict(df: DataFrame, coef: DataFrame, x: Sequence[str], on: Sequence[str], output: str = "mu_hat") -> DataFrame:
    """Linear prediction; the coefficient table has one row per fit (years x penalties) and is broadcast."""
    joined = df.join(F.broadcast(coef.select(*on, "coef")), list(on))
    value = F.element_at("coef", 1)
    for i, c in enumerate(x):
        value = value + F.element_at("coef", i + 2) * F.col(c)
    return joined.withColumn(output, value).drop("coef")


def mean_squared_error(coef: Column, xx: Column, xy: Column, yy: Column, n: Column, width: int) -> Column:
    """Mean squared error of a coefficient row on the rows behind the moments: (b'Gb - 2b'r + y'y)/n."""
    order = pairs(range(width))
    total = yy
    for i in range(width):
        total = total - F.lit(2.0) * F.element_at(coef, i + 1) * F.element_at(xy, i + 1)
    for position, (i, j) in enumerate(order):
        factor = 1.0 if i == j else 2.0
        total = total + F.lit(factor) * F.element_at(coef, i + 1) * F.element_at(coef, j + 1) * F.element_at(
            xx, position + 1
        )
    return total / n


def daily_fits(daily: DataFrame, exposures: Sequence[str], ret: str, penalty: float, day: str = "date") -> DataFrame:
    """One ridge per day; a row with a null return or exposure takes no part in it."""
    whole = daily.where(reduce(and_, [F.col(c).isNotNull() for c in (ret, *exposures)]))
    return ridge_fit(
        gram(whole, exposures, ret, [day]).withColumn("__pen", F.lit(float(penalty))), "__pen", standardise=False
    )


def factor_returns(
    daily: DataFrame, exposures: Sequence[str], ret: str, penalty: float, day: str = "date"
) -> DataFrame:
    """Daily cross-sectional ridge of returns on exposures: one factor return per day and exposure."""
    fits = daily_fits(daily, exposures, ret, penalty, day)
    items = F.array(
        F.struct(F.lit("intercept").alias("factor"), F.element_at("coef", 1).alias("factor_return")),
        *[
            F.struct(F.lit(c).alias("factor"), F.element_at("coef", i + 2).alias("factor_return"))
            for i, c in enumerate(exposures)
        ],
    )
    return fits.select(day, "n", F.inline(items))


def factor_residuals(
    daily: DataFrame, exposures: Sequence[str], ret: str, penalty: float, day: str = "date"
) -> DataFrame:
    """``daily`` with ``fitted`` and ``residual`` of the day's ridge; both null where the return or an exposure is.

    The fits are calendar-sized and broadcast, so the rows are shuffled for the day's sums only.
    """
    rows = ranks.attach(daily, daily_fits(daily, exposures, ret, penalty, day).select(day, "coef"), [day])
    fitted = F.element_at("coef", 1)
    for i, c in enumerate(exposures):
        fitted = fitted + F.element_at("coef", i + 2) * F.col(c)
    rows = rows.withColumn("fitted", F.when(F.col(ret).isNotNull(), fitted))
    return rows.withColumn("residual", F.col(ret) - F.col("fitted")).drop("coef")


def winsorise(
    df: DataFrame, columns: Sequence[str], low: float, high: float, by: Sequence[str], group_rows: int | None = None
) -> DataFrame:
    """Clip each column at its two quantiles of the day."""
    out = df
    for c in columns:
        cuts = ranks.quantiles(df, by, c, {"__lo": low, "__hi": high}, group_rows)
        out = ranks.attach(out, cuts, by).withColumn(
            c, F.when(F.col(c).isNotNull(), F.greatest(F.least(F.col(c), "__hi"), "__lo"))
        ).drop("__lo", "__hi")
    return out


def ewma_moments(
    df: DataFrame, pair: Sequence[str], day: str, x: str, y: str, span: int, at: str | None = None
) -> DataFrame:
    """Exponentially weighted covariance of two daily series after each day, weights (1-a)^age.

    A day's age is counted in rows of its pair or, with ``at`` (a whole number that rises with the day), in steps
    of that column, so that days a pair has no row for age the others, too.  A row without both values only ages
    the others; before the first row with both the covariance is zero.  Keys aren't null, a pair has one row a day.

    Decayed sums are taken in blocks of days short enough that the growth of a weight inside a block stays under
    1e8.  Each block adds to the sums of those before it, decayed to its start, so neither the length of a series nor the
    span can overflow, and one shuffle by pair serves all windows.
    """
    decay = 1.0 - 2.0 / (span + 1.0)
    length = max(1, int(math.log(1e8) / -math.log(decay))) if decay > 0 else 1
    key = list(pair)
    series = W.partitionBy(*key).orderBy(day)
    power = lambda age: F.pow(F.lit(decay), age.cast("double"))
    both = F.col(x).isNotNull() & F.col(y).isNotNull() & ~F.isnan(x) & ~F.isnan(y)
    rows = df.withColumn("__at", (F.col(at) if at else F.row_number().over(series)).cast("long"))
    # A covariance doesn't hang on a shift: measured from the first values its sums don't cancel.
    whole = series.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    dx, dy = (F.col(c) - F.first(F.when(both, F.col(c)), ignorenulls=True).over(whole) for c in (x, y))
    rows = rows.withColumns({"__dx": F.when(both, dx), "__dy": F.when(both, dy)})
    rows = rows.withColumns({"__block": F.floor(F.col("__at") / length), "__step": F.pmod(F.col("__at"), F.lit(length))})
    values = {
        "__sw": both.cast("double"), "__sx": F.col("__dx"), "__sy": F.col("__dy"), "__sxy": F.col("__dx") * F.col("__dy"),
    }
    running = W.partitionBy(*key, "__block").orderBy(day).rowsBetween(W.unboundedPreceding, W.currentRow)
    step = F.col("__step")
    rows = rows.withColumns(
        {n: F.coalesce(F.sum(v * power(-step)).over(running), F.lit(0.0)) * power(step) for n, v in values.items()}
    )
    ends = rows.groupBy(*key, "__block").agg(
        *[F.max_by(F.col(n) * power(length - 1 - step), "__at").alias(n) for n in values]
    )
    before = W.partitionBy(*key).orderBy("__block").rowsBetween(W.unboundedPreceding, -1)
    ends = ends.withColumn("__before", F.collect_list(F.struct("__block", *values)).over(before))

    def carried(name: str) -> Column:
        gap = lambda e: length * (F.col("__block") - 1 - e["__block"])
        return F.aggregate("__before", F.lit(0.0), lambda total, e: total + e[name] * power(gap(e)))

    ends = ends.select(*key, "__block", *[carried(n).alias(f"{n}0") for n in values])
    rows = rows.join(ends, [*key, "__block"], "left")
    w, mx, my, mxy = (F.col(n) + F.col(f"{n}0") * power(step + 1) for n in values)
    covariance = F.when(w > 0, mxy / w - mx / w * (my / w)).otherwise(0.0)
    return rows.select(*df.columns, covariance.alias("covariance"))


def idiosyncratic_variance(
    residuals: DataFrame, entity: str, day: str, span: int, least: int, residual: str = "residual"
) -> DataFrame:
    """(entity, eom, days, observations, idio_var): decayed variance of an entity's daily residuals at month ends.

    Days count on the calendar of all residuals, so days that an entity misses age what it has.  A month
    without a residual of the entity has no row.  With under ``least`` observations so far the variance is null.
    """
    rows = residuals.where(F.col(residual).isNotNull()).select(entity, day, residual)
    calendar = rows.select(day).distinct().withColumn("__day", F.row_number().over(W.orderBy(day)))
    rows = ewma_moments(ranks.attach(rows, calendar, [day]), [entity], day, residual, residual, span, "__day")
    so_far = F.count(F.lit(1)).over(W.partitionBy(entity).orderBy(day))
    months = rows.withColumn("__n", so_far).groupBy(entity, F.last_day(day).alias("eom")).agg(
        F.count(F.lit(1)).alias("days"), F.max("__n").alias("observations"), F.max_by("covariance", day).alias("idio_var")
    )
    return months.withColumn("idio_var", F.when(F.col("observations") >= least, F.greatest("idio_var", F.lit(0.0))))


def random_weights(inputs: int, features: int, scale: float, seed: int, bank: int | None = None) -> np.ndarray:
    """Fixed draw of the frequency matrix; a bank of ``bank`` features nests every smaller map."""
    rng = np.random.default_rng(seed)
    full = rng.normal(loc=0.0, scale=scale, size=(inputs, (bank or features) // 2))
    return full[:, : features // 2]


def random_features(df: DataFrame, x: Sequence[str], weights: np.ndarray, prefix: str = "f") -> DataFrame:
    """cos and sin of x'W over sqrt(features), as column expressions with literal weights."""
    half = weights.shape[1]
    scale = float(np.sqrt(2 * half))
    columns: dict[str, Column] = {}
    for k in range(half):
        angle = F.lit(0.0)
        for i, c in enumerate(x):
            angle = angle + F.coalesce(F.col(c), F.lit(S.NEUTRAL_RANK)) * F.lit(float(weights[i, k]))
        columns[f"{prefix}{k}"] = F.cos(angle) / scale
        columns[f"{prefix}{half + k}"] = F.sin(angle) / scale
    ordered = {f"{prefix}{k}": columns[f"{prefix}{k}"] for k in range(2 * half)}
    return df.withColumns(ordered)


def grid(spark_df: DataFrame, **lists: Sequence) -> DataFrame:
    """Every combination of value lists for each row of a small table, by exploding literals."""
    out = spark_df
    for name, values in lists.items():
        out = out.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return out


def training_moments(monthly: DataFrame, months_per_year: DataFrame) -> DataFrame:
    """The expanding moments known before each test year (label of November is the last one in)."""
    running = running_gram(monthly, "eom")
    cut = F.make_date(F.col("test_year") - 1, F.lit(11), F.lit(30))
    dated = running.join(F.broadcast(months_per_year.withColumn("__cut", cut)), F.col("eom") <= F.col("__cut"))
    best = F.max_by(F.struct("xx", "xy", "yy", "n"), "eom")
    return dated.groupBy("test_year").agg(F.max("eom").alias("trained_to"), best.alias("m")).select(
        "test_year", "trained_to", "m.*"
    )


def return_model_by_year(
    df: DataFrame, x: Sequence[str], label: str, penalties: Sequence[float], validation_months: int
) -> DataFrame:
    """Per test year: fit each penalty before the validation window, score it there, refit the best.

    Returns one row per (test_year, penalty) with validation error, the chosen flag and the
    coefficients refitted on all history.  All of it comes from one pass of month moments.
    """
    monthly = gram(df, x, label, ["eom"])
    years = monthly.select(F.year("eom").alias("test_year")).distinct()
    cut = F.make_date(F.col("test_year") - 1, F.lit(11), F.lit(30))
    history = monthly.join(F.broadcast(years.withColumn("__cut", cut)), F.col("eom") <= F.col("__cut"))
    back = F.row_number().over(W.partitionBy("test_year").orderBy(F.col("eom").desc()))
    history = history.withColumn("part", F.when(back <= validation_months, "validation").otherwise("train"))
    packed = F.concat("xx", "xy", F.array(F.col("yy"), F.col("n").cast("double")))
    long = history.select("test_year", "part", F.posexplode(packed).alias("position", "v"))
    both = long.withColumn("part", F.explode(F.array(F.col("part"), F.lit("all"))))
    sums = both.groupBy("test_year", "part", "position").agg(F.sum("v").alias("v"))
    arrays = sums.groupBy("test_year", "part").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("position", "v"))), lambda p: p["v"]).alias("all")
    )
    k = len(x) + 1
    m = k * (k + 1) // 2
    moments = arrays.select(
        "test_year", "part",
        F.slice("all", 1, m).alias("xx"), F.slice("all", m + 1, k).alias("xy"),
        F.element_at("all", m + k + 1).alias("yy"), F.element_at("all", m + k + 2).alias("n"),
    )
    fits = ridge_fit(
        grid(moments.where("part <> 'validation'"), penalty=[float(p) for p in penalties]), "penalty"
    )
    trained = fits.where("part = 'train'").select("test_year", "penalty", "coef")
    held = moments.where("part = 'validation'").drop("part")
    scored = trained.join(held, "test_year").select(
        "test_year", "penalty",
        mean_squared_error(F.col("coef"), F.col("xx"), F.col("xy"), F.col("yy"), F.col("n"), k).alias("validation_mse"),
    )
    first = F.row_number().over(W.partitionBy("test_year").orderBy("validation_mse", "penalty"))
    final = fits.where("part = 'all'").select("test_year", "penalty", F.col("coef"))
    return scored.withColumn("selected", first == 1).join(final, ["test_year", "penalty"])
