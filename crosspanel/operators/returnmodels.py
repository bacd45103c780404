"""Return models of several kinds that compete on a validation window, year by year.

Month moments of every feature map are summed in one pass over the rows.  A test year's training, validation
and refit sums are differences of running sums of that calendar-sized table, so every year, kind, width and
penalty costs a small solve and no pass of its own.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from crosspanel import settings as S
from crosspanel.operators import paths
from crosspanel.operators.learned import FeatureMap, _vectors

KINDS = {"linear": "ridge", "rf": "rf_ridge"}
FITS = (
    "test_year int, candidate int, kind string, eta double, p int, penalty double, train_months int, validation_months int,"
    " validation_start date, train_rows long, validation_rows long, validation_mse double, coef array<double>"
)


def windows(months: Sequence[dt.date], year: int, wanted: int, least_train: int, least_validation: int) -> tuple[int, int]:
    """How many of the months known before the test year train, and how many after them validate.

    The last ``wanted`` months validate, or as many as leave ``least_train`` to train on; under
    ``least_validation`` there is no fit, and both are zero.
    """
    known = sum(m <= dt.date(year - 1, 11, 30) for m in months)
    validation = min(wanted, known - least_train)
    return (known - validation, validation) if validation >= least_validation else (0, 0)


def month_moments(rows: DataFrame, months: int, inputs: int, maps: Sequence[FeatureMap]) -> DataFrame:
    """(map, t, parts): upper triangle of X'X, X'y, y'y and the labelled rows of each map and month.

    ``rows`` has t (from 1), features and label.  A row with a null label or feature takes no part.
    """
    most = 1 + max(m.width(inputs) for m in maps)
    width = most * (most + 1) // 2 + most + 2

    def partial(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        total = np.zeros((len(maps) * months, width))
        for batch in batches:
            if not batch.num_rows:
                continue
            t = np.asarray(batch.column("t")) - 1
            x = np.asarray(batch.column("features").flatten()).reshape(-1, inputs)
            y = np.asarray(batch.column("label"))
            for month in np.unique(t):
                at = t == month
                for k, m in enumerate(maps):
                    full = np.concatenate([np.ones((at.sum(), 1)), m.apply(x[at])], axis=1)
                    index = np.triu_indices(full.shape[1])
                    cells, own = len(index[0]), full.shape[1]
                    cell = total[k * months + month]
                    cell[:cells] += (full.T @ full)[index]
                    cell[cells : cells + own] += full.T @ y[at]
                    cell[cells + own : cells + own + 2] += y[at] @ y[at], at.sum()
        return total

    known = rows.where(
        F.col("label").isNotNull() & ~F.isnan("label") & F.forall("features", lambda v: v.isNotNull() & ~F.isnan(v))
    ).select("t", "features", "label")
    parts = paths.summed_parts(known, partial)
    items = F.array_sort(F.collect_list(F.struct("part", "values")))
    return parts.groupBy("row").agg(items.alias("parts")).select(
        F.floor(F.col("row") / months).cast("int").alias("map"), (F.col("row") % months + 1).alias("t"), "parts"
    )


def ridge(xx: np.ndarray, xy: np.ndarray, n: float, penalty: float, standardise: bool) -> np.ndarray:
    """Coefficients, intercept first and unpenalised, on the features' own scale."""
    g, r = xx / n, xy / n
    mean = g[0, 1:]
    centred = g[1:, 1:] - np.outer(mean, mean)
    square = np.diag(g)[1:]
    variance = square - mean**2
    scale = np.sqrt(np.maximum(variance, 0.0)) if standardise else np.ones_like(mean)
    if standardise:
        # A flat feature leaves only rounding noise after the mean is taken out of its moment.
        scale[(scale < S.SCALE_FLOOR) | (variance <= 1e-13 * square)] = 1.0
    lhs = centred / np.outer(scale, scale) + penalty * np.eye(len(mean))
    slope = np.linalg.pinv(lhs, hermitian=True) @ ((r[1:] - mean * r[0]) / scale) / scale
    return np.concatenate([[r[0] - mean @ slope], slope])


def compete(
    moments: DataFrame, months: Sequence[dt.date], years: Sequence[int], inputs: int, maps: Sequence[FeatureMap],
    penalties: Sequence[float], wanted: int = S.RETURN_VALIDATION_MONTHS, least_train: int = S.RETURN_MIN_TRAIN,
    least_validation: int = S.RETURN_MIN_VALIDATION,
) -> DataFrame:
    """One row per test year and candidate: error on the validation months, and the refit on all history.

    The smallest error of a year is ``selected``, on ties the first candidate: linear ones, then by width and
    scale, penalties in their order.  A year whose history is too short keeps its rows, with a null fit.
    One task solves one map, whose table has one row per month.
    """
    order = {}
    for m in sorted(maps, key=lambda m: m.kind != "linear"):
        for p in m.sizes():
            order[m.kind, p, m.eta] = 0
    ranked = sorted(order, key=lambda k: (k[0] != "linear", k[1] or 0, list(order).index(k)))

    def run(part: pd.DataFrame) -> pd.DataFrame:
        m = maps[int(part["map"].iloc[0])]
        width = 1 + m.width(inputs)
        index = np.triu_indices(width)
        cells = len(index[0])
        table = np.zeros((len(months), cells + width + 2))
        table[part["t"].to_numpy() - 1] = _vectors(part, table.shape[1])
        running = np.concatenate([np.zeros((1, table.shape[1])), np.cumsum(table, axis=0)])

        def sums(first: int, last: int, at: np.ndarray, scale: float):
            v = running[last] - running[first]
            full = np.zeros((width, width))
            full[index] = v[:cells]
            full = full + np.triu(full, 1).T
            by = np.where(at == 0, 1.0, scale)
            return full[np.ix_(at, at)] * np.outer(by, by), v[cells : cells + width][at] * by, v[cells + width], v[cells + width + 1]

        out = []
        for year in years:
            train, validation = windows(months, year, wanted, least_train, least_validation)
            for p in m.sizes():
                at = m.columns(p, inputs)
                # Features are over the root of their number.
                scale = 1.0 if p is None else float(np.sqrt(m.width(inputs) / p))
                first = ranked.index((m.kind, p, m.eta)) * len(penalties)
                trained, held, whole = [sums(*w, at, scale) for w in ((0, train), (train, train + validation), (0, train + validation))]
                for i, penalty in enumerate(penalties):
                    key = [int(year), first + i, KINDS[m.kind], m.eta, p, float(penalty), train, validation]
                    if not trained[3] or not held[3]:
                        out.append([*key, None, 0, 0, None, None])
                        continue
                    b = ridge(trained[0], trained[1], trained[3], penalty, m.kind == "linear")
                    error = (b @ held[0] @ b - 2 * b @ held[1] + held[2]) / held[3]
                    final = ridge(whole[0], whole[1], whole[3], penalty, m.kind == "linear")
                    out.append([*key, months[train], int(trained[3]), int(held[3]), float(error), final.tolist()])
        return pd.DataFrame(out, columns=[c.split()[0] for c in FITS.split(", ")], dtype=object)

    fits = moments.groupBy("map").applyInPandas(run, FITS)
    best = F.row_number().over(W.partitionBy("test_year").orderBy(F.col("validation_mse").asc_nulls_last(), "candidate"))
    return fits.withColumn("selected", (best == 1) & F.col("validation_mse").isNotNull())


def predict(rows: DataFrame, chosen: Sequence, inputs: int, maps: Sequence[FeatureMap]) -> DataFrame:
    """(eom, entity, test_year, mu_hat) by the selected model of the row's year; years without one have no rows.

    ``chosen`` holds one row of ``compete`` per test year.
    """
    models = {}
    for r in chosen:
        m = next(m for m in maps if KINDS[m.kind] == r.kind and m.eta == r.eta)
        scale = 1.0 if r.p is None else float(np.sqrt(m.width(inputs) / r.p))
        models[r.test_year] = (m, m.columns(r.p, inputs)[1:] - 1, np.array(r.coef) * np.array([1.0] + [scale] * (len(r.coef) - 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            year = np.asarray(batch.column("test_year"))
            x = np.asarray(batch.column("features").flatten()).reshape(-1, inputs)
            mu = np.zeros(len(year))
            for y in np.unique(year):
                m, columns, coef = models[int(y)]
                at = year == y
                mu[at] = coef[0] + m.apply(x[at])[:, columns] @ coef[1:]
            yield pa.RecordBatch.from_arrays(
                [batch.column("eom"), batch.column("entity"), batch.column("test_year"), pa.array(mu)],
                ["eom", "entity", "test_year", "mu_hat"],
            )

    schema = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in ("eom", "entity", "test_year"))
    kept = rows.where(F.col("test_year").isin([int(y) for y in models])).select("eom", "entity", "test_year", "features")
    return kept.mapInArrow(run, f"{schema}, mu_hat double")
