"""Information coefficients, persistence, horizon paths and feature scoring."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from crosspanel import settings as S
from crosspanel.operators import inference, joins, performance, ranks


def correlation(a: str | Column, b: str | Column) -> Column:
    """Pearson correlation over the pairs with both sides; null where one side has no spread."""
    spread = F.regr_sxx(a, b) * F.regr_syy(a, b)
    return F.when(spread > 0, F.regr_sxy(a, b) / F.sqrt(spread))


def line(y: str, x: str) -> tuple[Column, Column]:
    """Intercept and slope of y on x over the pairs with both sides; null where x has no spread."""
    sxx = F.regr_sxx(y, x)
    slope = F.when(sxx > 0, F.regr_sxy(y, x) / sxx)
    return F.regr_avgy(y, x) - slope * F.regr_avgx(y, x), slope


def monthly_ic(
    long: DataFrame,
    by: Sequence[str],
    x: str,
    y: str,
    minimum: int = S.MIN_CROSS_SECTION,
    group_rows: int | None = None,
) -> DataFrame:
    """Rank and Pearson correlation of x and y inside each group, with the cross-sectional line.

    A group with fewer than ``minimum`` valid rows gets nulls.  ``by`` usually is (feature, month).
    """
    valid = long.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*by, x, y)
    ranked = ranks.average_ranks(valid, by, {x: "__rx", y: "__ry"}, group_rows)
    return _ic_statistics(ranked, by, x, y, minimum)


def _ic_statistics(ranked: DataFrame, by: Sequence[str], x: str, y: str, minimum: int) -> DataFrame:
    n = F.count(F.lit(1))
    enough = n >= minimum
    intercept, slope = line(y, x)
    return ranked.groupBy(*by).agg(
        n.alias("n_valid"),
        F.when(enough, correlation(x, y)).alias("pearson_ic"),
        F.when(enough, correlation("__rx", "__ry")).alias("rank_ic"),
        F.when(enough, intercept).alias("fmb_intercept"),
        F.when(enough, slope).alias("fmb_slope"),
    )


def feature_ic(
    wide: DataFrame,
    features: Mapping[str, str],
    y: str,
    by: Sequence[str] = ("eom",),
    minimum: int = S.MIN_CROSS_SECTION,
    group_rows: int | None = None,
    rows: int | None = None,
) -> DataFrame:
    """``monthly_ic`` of many features with one label, from wide rows: {feature name: column}.

    The features must hold no nulls (filled ranks do not), so every feature has the same valid rows:
    the label is ranked once for all of them and rows are unpivoted only after the ordering.  ``rows`` is the
    measured size of ``wide`` (by month): its months are then dealt out evenly and nothing is unpivoted.
    """
    by = list(by)
    valid = wide.where(F.col(y).isNotNull()).select(*by, y, *features.values())
    if rows is not None and by == ["eom"] and ranks.fits_one_task(group_rows):
        return _month_statistics(valid, features, [y], minimum, rows).drop("horizon")
    ranked = ranks.average_ranks(
        valid, by, {y: "__ry", **{c: f"__r_{c}" for c in features.values()}}, group_rows
    )
    items = F.array(
        *[
            F.struct(F.lit(name).alias("feature"), F.col(c).alias("__x"), F.col(f"__r_{c}").alias("__rx"))
            for name, c in features.items()
        ]
    )
    long = ranked.select(*by, y, "__ry", F.inline(items))
    return _ic_statistics(long, ["feature", *by], "__x", y, minimum)


def horizon_ic(
    df: DataFrame,
    features: Mapping[str, str],
    y: str,
    horizons: int = S.HORIZONS,
    minimum: int = S.MIN_CROSS_SECTION,
    group_rows: int | None = None,
    rows: int | None = None,
) -> DataFrame:
    """``feature_ic`` by horizon and month: features at month t with the label at t+h-1, for h = 1..horizons.

    Where the largest month fits a task a row carries its labels of all horizons, so it is shuffled by entity and by
    month once each, and a feature is ordered once for all horizons.  Larger months are matched and ranked in buckets.
    """
    if rows is None or not ranks.fits_one_task(group_rows):
        matched = joins.horizon_join(df, df.select("entity", "eom", "month_index", *features.values()), horizons, y)
        return feature_ic(matched, features, y, ["horizon", "eom"], minimum, group_rows)
    months = W.partitionBy("entity").orderBy("month_index")  # one row per month
    labels = {f"__y{h}": F.max(y).over(months.rangeBetween(h - 1, h - 1)) for h in range(1, horizons + 1)}
    wide = df.select("entity", "eom", "month_index", y, *features.values()).withColumns(labels)
    return _month_statistics(wide.select("eom", *labels, *features.values()), features, list(labels), minimum, rows)


def _month_statistics(
    wide: DataFrame, features: Mapping[str, str], labels: Sequence[str], minimum: int, rows: int
) -> DataFrame:
    """The statistics of every feature with the label of each horizon; a horizon's rows are those with its label."""
    schema = (
        f"feature string, horizon int, eom {wide.schema['eom'].dataType.simpleString()}, n_valid bigint,"
        " pearson_ic double, rank_ic double, fmb_intercept double, fmb_slope double"
    )

    def run(month: pa.Table) -> pa.Table:
        return _one_month(month, features, labels, minimum)

    dealt, keys = ranks.deal(wide, ["eom"], rows, ranks.month_number("eom"))
    return dealt.groupBy(*keys).applyInArrow(run, schema)


def _centred(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Differences from the mean, exactly zero where all are equal; and the mean."""
    away = v - v[0]
    mean = away.mean(axis=0)
    return away - mean, v[0] + mean


def _one_month(month: pa.Table, features: Mapping[str, str], labels: Sequence[str], minimum: int) -> pa.Table:
    x = np.column_stack([month[c].to_numpy() for c in features.values()])
    orders = [_runs(x[:, k]) for k in range(x.shape[1])]
    out = []
    for horizon, label in enumerate(labels, 1):
        known = month[label].is_valid().to_numpy()
        n = int(known.sum())
        if n == 0:
            continue
        if n < minimum:
            out += [(name, horizon, n, None, None, None, None) for name in features]
            continue
        y = month[label].to_numpy()
        yc, y_mean = _centred(y[known])
        xc, x_mean = _centred(x[known])
        sxx, sxy, syy = (xc * xc).sum(axis=0), yc @ xc, float(yc @ yc)
        # Average ranks around their mean; rows without the label count nothing.
        ry = np.zeros(len(y))
        order, starts = _runs(y[known])
        ends = np.append(starts[1:], n)
        place = np.empty(n)
        place[order] = np.repeat((starts + ends - n) / 2.0, ends - starts)
        ry[known] = place
        spread = float(place @ place)
        for k, (name, (order, starts)) in enumerate(zip(features, orders)):
            held = np.add.reduceat(known[order], starts, dtype=np.int64)
            upto = np.cumsum(held)
            rx = (2 * upto - held - n) / 2.0
            cross, own = float(rx @ np.add.reduceat(ry[order], starts)), float((rx * rx) @ held)
            slope = sxy[k] / sxx[k] if sxx[k] > 0 else None
            out.append((
                name, horizon, n,
                sxy[k] / np.sqrt(sxx[k] * syy) if sxx[k] * syy > 0 else None,
                cross / np.sqrt(own * spread) if own * spread > 0 else None,
                None if slope is None else y_mean - slope * x_mean[k], slope,
            ))
    kinds = [pa.string(), pa.int32(), pa.int64(), *[pa.float64()] * 4]
    columns = [pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds)]
    day = pa.array([month["eom"][0].as_py()] * len(out), month["eom"].type)
    names = ["feature", "horizon", "eom", "n_valid", "pearson_ic", "rank_ic", "fmb_intercept", "fmb_slope"]
    return pa.Table.from_arrays([*columns[:2], day, *columns[2:]], names)


def _runs(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ascending order of the values and where each run of equal ones begins in it; NaN are last and equal."""
    order = np.argsort(v, kind="stable")
    ordered = v[order]
    new = (ordered[1:] != ordered[:-1]) & ~(np.isnan(ordered[1:]) & np.isnan(ordered[:-1]))
    return order, np.flatnonzero(np.concatenate([[True], new]))


def ic_summary(monthly: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Mean, median, deviation, months and monthly information ratio of a monthly statistic."""
    sd = F.stddev_samp(value)
    return monthly.groupBy(*by).agg(
        F.avg(value).alias("mean"),
        F.percentile(value, F.lit(0.5)).alias("median"),
        sd.alias("std"),
        F.count(value).alias("valid_months"),
        F.when(sd > 0, F.avg(value) / sd).alias("information_ratio"),
        F.avg("n_valid").alias("mean_n"),
    )


def fmb_summary(monthly: DataFrame, by: Sequence[str], lags: int = S.HAC_LAGS, value: str = "fmb_slope") -> DataFrame:
    """Mean slope with the plain and the Newey-West t statistic."""
    plain = monthly.groupBy(*by).agg(
        F.percentile(value, F.lit(0.5)).alias("median"), F.stddev_samp(value).alias("std")
    )
    robust = inference.newey_west(monthly, value, lags, by, "eom")
    se = F.col("std") / F.sqrt(F.col("n").cast("double"))
    return robust.join(plain, list(by)).select(
        *by, F.col("n").alias("valid_months"), "mean", "median", "std", se.alias("plain_se"),
        F.when(se > 0, F.col("mean") / se).alias("plain_t"), "nw_se", "nw_t",
    )


def pooled_ar1(pairs: DataFrame, by: Sequence[str], x: str, y: str) -> DataFrame:
    """Slope, intercept, standard error, t and R2 of y on x over all pairs of a group."""
    n = F.count(F.lit(1))
    sxx, syy = F.regr_sxx(y, x), F.regr_syy(y, x)
    intercept, slope = line(y, x)
    valid = pairs.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    sums = valid.groupBy(*by).agg(
        n.alias("ar1_pairs"), slope.alias("ar1_rho"), intercept.alias("ar1_intercept"),
        sxx.alias("__sxx"), syy.alias("__syy"),
    )
    sse = F.col("__syy") - F.col("ar1_rho") ** 2 * F.col("__sxx")
    se = F.sqrt(F.greatest(sse, F.lit(0.0)) / (F.col("ar1_pairs") - 2) / F.col("__sxx"))
    return (
        sums.withColumn("ar1_se", se)
        .withColumn("ar1_t", F.when(F.col("ar1_se") > 0, F.col("ar1_rho") / F.col("ar1_se")))
        .withColumn("ar1_r2", F.when(F.col("__syy") > 0, F.lit(1.0) - sse / F.col("__syy")))
        .drop("__sxx", "__syy")
    )


def half_life(rho: Column) -> Column:
    """Months until half is left, for 0 < rho < 1."""
    return F.when((rho > 0) & (rho < 1), F.log(F.lit(0.5)) / F.log(rho))


def persistence_flag(
    metrics: Sequence[Column], fill_rate: Column, ties: Column, overlap: Column, gap: float = S.PERSISTENCE_GAP
) -> dict[str, Column]:
    """Do three persistence measures agree, and if not, why."""
    spread = F.greatest(*metrics) - F.least(*metrics)
    signs = [F.when(F.abs(m) > S.PERSISTENCE_SIGN, F.signum(m)) for m in metrics]
    has_pos = F.coalesce(F.greatest(*signs), F.lit(0.0)) > 0
    has_neg = F.coalesce(F.least(*signs), F.lit(0.0)) < 0
    disagree = (spread > gap) | (has_pos & has_neg)
    detail = F.concat_ws(
        "; ",
        F.when(fill_rate > S.PERSISTENCE_FILLS, S.CAUSE_FILLS),
        F.when(ties > S.PERSISTENCE_TIES, S.CAUSE_TIES),
        F.when(overlap < S.PERSISTENCE_OVERLAP, S.CAUSE_OVERLAP),
    )
    cause = F.when(detail == "", S.CAUSE_OTHER).otherwise(detail)
    note = F.when(
        ~disagree, "AR(1), monthly Pearson and monthly Spearman persistence are aligned"
    ).otherwise(F.concat(F.lit("maximum metric gap "), F.format_string("%.3f", spread), F.lit("; "), cause))
    return {
        "max_gap": spread,
        "sign_disagreement": has_pos & has_neg,
        "flag": F.when(disagree, "review").otherwise("aligned"),
        "note": note,
    }


def rank_autocorrelation(lagged: DataFrame, by: Sequence[str], value: str, previous: str) -> DataFrame:
    """Monthly lag-1 correlation and mean absolute change of ranks."""
    return lagged.groupBy(*by, "eom").agg(
        correlation(value, previous).alias("autocorrelation"),
        F.avg(F.abs(F.col(value) - F.col(previous))).alias("mean_abs_change"),
    )


def monthly_correlations(df: DataFrame, left: Sequence[str], right: Sequence[str], by: Sequence[str] = ("eom",)) -> DataFrame:
    """Correlation of every left with every right column inside each month, in one pass."""
    pairs = [(a, b) for a in left for b in right if a != b]
    sums = df.groupBy(*by).agg(*[correlation(a, b).alias(f"__{i}") for i, (a, b) in enumerate(pairs)])
    items = F.array(
        *[
            F.struct(F.lit(a).alias("feature"), F.lit(b).alias("other"), F.col(f"__{i}").alias("correlation"))
            for i, (a, b) in enumerate(pairs)
        ]
    )
    return sums.select(*by, F.inline(items))


def correlation_summary(monthly: DataFrame) -> DataFrame:
    """Average and largest absolute mean correlation of each feature and the feature it is with."""
    pair = monthly.groupBy("feature", "other").agg(F.avg("correlation").alias("c"))
    size = F.abs("c")
    return pair.groupBy("feature").agg(
        F.avg(size).alias("average_abs"),
        F.max(size).alias("max_abs"),
        F.min_by("other", F.struct(-size, F.col("other"))).alias("most_correlated"),
    )


def ic_stability(monthly: DataFrame, by: Sequence[str], value: str = "rank_ic") -> DataFrame:
    """Share of years with a positive mean, with the overall sign, and the weight of the top three."""
    overall = monthly.groupBy(*by).agg(F.avg(value).alias("mean_ic"))
    annual = monthly.groupBy(*by, F.year("eom").alias("year")).agg(F.avg(value).alias("__a")).where("__a is not null")
    rn = F.row_number().over(W.partitionBy(*by).orderBy(F.abs("__a").desc()))  # one row per year
    rows = annual.join(overall, list(by)).withColumn("__rn", rn)
    sign = F.when(F.col("mean_ic") >= 0, 1.0).otherwise(-1.0)
    size = F.abs("__a")
    return rows.groupBy(*by).agg(
        F.max("mean_ic").alias("mean_ic"),
        F.avg((F.col("__a") > 0).cast("double")).alias("positive_year_share"),
        F.avg((sign * F.col("__a") > 0).cast("double")).alias("same_sign_year_share"),
        (F.sum(F.when(F.col("__rn") <= 3, size)) / F.greatest(F.sum(size), F.lit(1e-16))).alias("top3_year_share"),
    )


def prediction_diagnostics(
    df: DataFrame, prediction: str, key: str, label: str, group_rows: int | None = None
) -> DataFrame:
    """Year averages of the monthly spread and rank correlation of a prediction, and its error."""
    ranked = ranks.average_rank(df, ["eom"], key, "__rx", group_rows)
    ranked = ranks.average_rank(ranked, ["eom"], label, "__ry", group_rows)
    monthly = ranked.groupBy("test_year", "eom").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(prediction).alias("s"),
        F.stddev_samp(prediction).alias("sd"),
        correlation("__rx", "__ry").alias("ic"),
        F.sum((F.col(prediction) - F.col(label)) ** 2).alias("sq"),
        F.count(label).alias("labelled"),
    )
    return monthly.groupBy("test_year").agg(
        (F.sum("s") / F.sum("n")).alias("prediction_mean"),
        F.avg("sd").alias("mean_prediction_std"),
        F.avg("ic").alias("mean_rank_ic"),
        (F.sum("sq") / F.sum("labelled")).alias("test_mse"),
    )


def path_metrics(table: DataFrame, by: Sequence[str], value: str, horizons: int = S.HORIZONS) -> DataFrame:
    """Shape of a horizon path, read off an ordered array of one value per horizon."""
    arrays = table.groupBy(*by).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("horizon", value))), lambda p: p[value]).alias("path")
    )
    h1 = F.element_at("path", 1)
    near = F.abs(h1) <= S.NEAR_ZERO
    sign = F.signum(h1)
    adjusted = F.transform("path", lambda v: v * sign)
    later = F.slice(adjusted, 2, horizons - 1)
    positive = F.transform(later, lambda v: F.greatest(v, F.lit(0.0)))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda acc, v: acc + v)
    threshold = F.lit(0.5) * F.abs(h1)
    places = F.sequence(F.lit(2), F.lit(horizons))
    decay = F.array_min(F.filter(places, lambda h: F.element_at(adjusted, h) < threshold))
    reversal = F.array_min(F.filter(places, lambda h: F.element_at(adjusted, h) < 0))
    recovery = F.exists(places, lambda h: (h > decay) & (F.element_at(adjusted, h) >= threshold))
    same = total(F.transform(later, lambda v: (v > 0).cast("double"))) / float(horizons - 1)
    out = {
        "h1": h1,
        "near_zero": near,
        "direction": F.when(near, 0).otherwise(sign.cast("int")),
        "sdm": F.when(~near, total(positive)),
        "sfm": F.when(~near, total(later)),
        "ssh": F.when(~near, same),
        "first_decay": F.when(~near, F.coalesce(decay, F.lit(horizons + 1))),
        "recovers": F.when(near, False).otherwise(F.coalesce(recovery, F.lit(False))),
        "first_reversal": F.when(~near, F.coalesce(reversal, F.lit(horizons + 1))),
    }
    for h in (3, 6, 12):
        out[f"apr_{h}"] = F.when(~near, total(F.slice(positive, 1, h - 1)) / (F.lit(float(h - 1)) * F.abs(h1)))
    return arrays.select(*by, *[c.alias(n) for n, c in out.items()])


def path_pivot(table: DataFrame, by: Sequence[str], value: str, horizons: int = S.HORIZONS) -> DataFrame:
    """One column per horizon, raw and signed by the first."""
    wide = table.groupBy(*by).pivot("horizon", list(range(1, horizons + 1))).agg(F.first(value))
    sign = F.when(F.abs("1") > S.NEAR_ZERO, F.signum("1"))
    raw = [F.col(str(h)).alias(f"h{h:02d}") for h in range(1, horizons + 1)]
    signed = [(F.col(str(h)) * sign).alias(f"adjusted_h{h:02d}") for h in range(1, horizons + 1)]
    return wide.select(*by, *raw, *signed)


def rank_correlation(df: DataFrame, by: Sequence[str], x: str, y: str, group_rows: int | None = None) -> DataFrame:
    """Pearson and Spearman correlation across the rows of small feature-level groups."""
    for c, out in ((x, "__rx"), (y, "__ry")):
        df = ranks.average_rank(df, by, c, out, group_rows)
    measures = [
        F.count(F.lit(1)).alias("n"),
        correlation(x, y).alias("pearson"),
        correlation("__rx", "__ry").alias("spearman"),
    ]
    return df.groupBy(*by).agg(*measures) if by else df.agg(*measures)


def leave_one_out(df: DataFrame, key: str, x: str, y: str, group_rows: int | None = None) -> DataFrame:
    """Spearman correlation with each row of a feature-level table left out in turn."""
    omitted = df.select(F.col(key).alias("omitted"))
    rows = df.join(omitted, F.col(key) != F.col("omitted"))
    return rank_correlation(rows, ["omitted"], x, y, group_rows)


def median_split(df: DataFrame, by_value: str, values: Sequence[str]) -> DataFrame:
    """Means and medians of the rows at or above and below the median of a feature-level column."""
    cut = df.agg(F.percentile(by_value, F.lit(0.5)).alias("__cut"))
    rows = df.join(F.broadcast(cut)).withColumn(
        "side", F.when(F.col(by_value) >= F.col("__cut"), "high").otherwise("low")
    )
    exprs = [F.count(F.lit(1)).alias("n")]
    for v in values:
        exprs += [F.avg(v).alias(f"mean_{v}"), F.percentile(v, F.lit(0.5)).alias(f"median_{v}")]
    return rows.groupBy("side").agg(*exprs)


def theme_summary(df: DataFrame, theme: str, values: Sequence[str], label: str = "feature") -> DataFrame:
    exprs = [
        F.count(F.lit(1)).alias("n"),
        F.array_join(F.array_sort(F.collect_list(label)), ", ").alias("members"),
    ]
    for v in values:
        exprs += [F.avg(v).alias(f"mean_{v}"), F.percentile(v, F.lit(0.5)).alias(f"median_{v}")]
    return df.groupBy(theme).agg(*exprs)


def score_features(table: DataFrame, bonus: Mapping[str, float], sensitive: Sequence[str]) -> DataFrame:
    """Balanced and conservative scores and the hard screens of a feature table.

    Needs missing_rate, median_std, mean_ic, same_sign_year_share, top3_year_share, persistence,
    average_abs, max_abs, theme, feature.
    """
    unit = lambda c: F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))
    c, scale, screen, strict = F.col, S.SCORE_SCALES, S.SCREENS, S.CONSERVATIVE_SCREENS
    mixed = lambda parts, one, two: F.lit(parts[0]) * one + F.lit(parts[1]) * two
    bonus_map = F.create_map(*[F.lit(x) for item in bonus.items() for x in item])
    is_sensitive = c("feature").isin(list(sensitive))
    least = F.lit(scale["sensitive_persistence"])
    short = F.greatest(least - c("persistence"), F.lit(0.0)) / least
    steps = {
        "quality": mixed(
            S.QUALITY_PARTS, unit(1 - c("missing_rate") / scale["missing"]), unit(c("median_std") / scale["std"])
        ),
        "ic_score": unit(F.abs("mean_ic") / scale["ic"]),
        "stability": mixed(
            S.STABILITY_PARTS, c("same_sign_year_share"), unit(1 - c("top3_year_share") / scale["top_years"])
        ),
        "persistence_score": unit((c("persistence") - scale["persistence_from"]) / scale["persistence_over"]),
        "redundancy": mixed(S.REDUNDANCY_PARTS, c("average_abs"), c("max_abs")),
        "bonus": F.coalesce(F.try_element_at(bonus_map, c("theme")), F.lit(0.0)),
        "trading_penalty": F.when(is_sensitive, short).otherwise(0.0),
    }

    def total(weights: Mapping[str, float]) -> Column:
        parts = [F.lit(w) * (1 - c("redundancy") if n == "diversity" else c(n)) for n, w in weights.items()]
        return reduce(lambda x, y: x + y, parts)

    failed = (
        (c("missing_rate") > screen["missing"])
        | (c("median_std") < screen["std"])
        | (c("persistence") < screen["persistence"])
        | (c("max_abs") > screen["max_abs"])
        | (is_sensitive & (c("persistence") < least))
    )
    passed = (
        ~failed
        & (c("missing_rate") <= strict["missing"])
        & (c("median_std") >= strict["std"])
        & (c("persistence") >= strict["persistence"])
        & (c("max_abs") <= strict["max_abs"])
        & (c("average_abs") <= strict["average_abs"])
    )
    return table.withColumns(steps).withColumns(
        {
            "balanced_score": total(S.BALANCED_WEIGHTS), "conservative_score": total(S.CONSERVATIVE_WEIGHTS),
            "balanced_eligible": ~failed, "conservative_eligible": passed,
        }
    )


def select_diversified(
    scores: DataFrame, score: str, eligible: str, themes: Sequence[str], per_theme: int = 2, wanted: int = 10
) -> DataFrame:
    """Best feature of each theme in set order, then by score, at most two per theme."""
    best = W.partitionBy("theme").orderBy(F.col(score).desc(), "feature")  # feature-level table
    place = F.array_position(F.array(*[F.lit(t) for t in themes]), F.col("theme"))
    rows = scores.where(F.col(eligible)).withColumn("__rn", F.row_number().over(best)).where(
        F.col("__rn") <= per_theme
    )
    first = F.when((F.col("__rn") == 1) & (place > 0), place).otherwise(len(themes) + 1)
    order = W.orderBy(first, F.col(score).desc(), "feature")
    return rows.withColumn("pick", F.row_number().over(order)).where(F.col("pick") <= wanted).drop("__rn")


def evidence_gate(correlations: DataFrame, minimum: float = 0.3) -> DataFrame:
    """How many of the rank correlations of a group are positive and large, as a verdict."""
    return correlations.groupBy("outcome").agg(
        F.count(F.lit(1)).alias("tests"),
        F.count_if(F.col("spearman") > 0).alias("positive"),
        F.count_if(F.abs("spearman") >= minimum).alias("large"),
        F.when(F.count_if(F.col("spearman") >= minimum) == F.count(F.lit(1)), "supported")
        .when(F.count_if(F.col("spearman") > 0) == F.count(F.lit(1)), "weak")
        .otherwise("not_supported")
        .alias("verdict"),
    )
