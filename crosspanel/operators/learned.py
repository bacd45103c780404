"""Net-utility policies on feature maps, end to end: linear ranks and random features side by side.

Random features of a scale come from one bank of frequencies, so a map of p features is part of every
larger one: the month sums of the widest map serve all of them.  Month means and lengths of the features,
then the utility statistics, are each one pass over the names; expanding sums of the calendar-sized
statistics give every test year, width and penalty; a last pass prices all candidates' aims.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from crosspanel import settings as S
from crosspanel.operators import paths, regress

#: What a path needs beside its features.  ``label`` is the forward return, which may be missing.
NUMBERS, OPTIONAL = ("lambda_adv", "variance", "volatility", "speed"), ("label",)
CANDIDATE = "kind string, eta double, p int, penalty double"
FITS = (
    f"{CANDIDATE}, test_year int, trained_to date, n long, beta array<double>, objective double, gradient_norm double,"
    " condition double, beta_norm double"
)


@dataclass(frozen=True)
class FeatureMap:
    """One map of the features: their ranks (no frequencies), or cosines and sines of a bank of frequencies."""

    kind: str
    eta: float | None = None
    counts: tuple[int, ...] = ()
    weights: np.ndarray | None = None

    def width(self, inputs: int) -> int:
        return inputs if self.weights is None else 2 * self.weights.shape[1]

    def apply(self, x: np.ndarray) -> np.ndarray:
        """Features of the rows: bank order is all cosines, then all sines."""
        if self.weights is None:
            return x
        angle = x @ self.weights
        return np.concatenate([np.cos(angle), np.sin(angle)], axis=1) / np.sqrt(self.width(0))

    def columns(self, p: int | None, inputs: int) -> np.ndarray:
        """Places of the map of ``p`` features in the design, whose place 0 is the constant."""
        if p is None:
            return np.arange(inputs + 1)
        half = self.width(inputs) // 2
        return np.concatenate([[0], 1 + np.arange(p // 2), 1 + half + np.arange(p // 2)])

    def sizes(self) -> list[int | None]:
        return list(self.counts) or [None]


def feature_maps(inputs: int, counts: Sequence[int], scales: Sequence[float], seed: int) -> list[FeatureMap]:
    """The linear map, and one bank for each scale."""
    banks = [FeatureMap("rf", e, tuple(counts), regress.random_weights(inputs, max(counts), e, seed)) for e in scales]
    return [FeatureMap("linear"), *banks]


def moments(names: DataFrame, months: int, inputs: int, maps: Sequence[FeatureMap]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per map: month counts, feature means and lengths around them (month, feature), in two passes."""
    widths = [m.width(inputs) for m in maps]

    def sums(of):
        def partial(batches):
            total = np.zeros((months, 1 + sum(widths)))
            for block in paths.blocks(batches, months, inputs):
                for t in range(months):
                    here = block.held[:, t]
                    total[t, 0] += here.sum()
                    at = 1
                    for k, m in enumerate(maps):
                        total[t, at : at + widths[k]] += of(m.apply(block.vector[here, t]), k, t).sum(axis=0)
                        at += widths[k]
            return total

        found = paths.summed(names, partial, (months, 1 + sum(widths)))
        return found[:, 0], np.split(found[:, 1:], np.cumsum(widths)[:-1], axis=1)

    counts, totals = sums(lambda x, k, t: x)
    with np.errstate(invalid="ignore"):
        means = [np.nan_to_num(v / counts[:, None]) for v in totals]
    _, squares = sums(lambda x, k, t: (x - means[k][t]) ** 2)
    return [(counts, mean, np.sqrt(v)) for mean, v in zip(means, squares)]


def design(x: np.ndarray, volatility: np.ndarray, m: FeatureMap, count: float, mean: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Constant and unit-length features of a month's rows, over volatility; a flat feature is zero."""
    flat = length <= S.NORM_FLOOR
    unit = (m.apply(x) - mean) / np.where(flat, 1.0, length) * ~flat
    constant = np.full((len(x), 1), 1.0 / np.sqrt(max(count, 1.0)))
    return np.concatenate([constant, unit], axis=1) / volatility[:, None]


def _designs(block: paths.Block, m: FeatureMap, moment, months: int):
    counts, means, lengths = moment
    for t in range(months):
        here = block.held[:, t]
        full = np.zeros((len(here), 1 + means.shape[1]))
        full[here] = design(block.vector[here, t], block["volatility"][here, t], m, counts[t], means[t], lengths[t])
        yield t, here, full


def statistics(
    names: DataFrame, stats: DataFrame, months: int, inputs: int, maps: Sequence[FeatureMap], moment: list,
    gamma: float = S.GAMMA, aum: float = S.AUM,
) -> DataFrame:
    """(map, eom, values): month sums of gamma B'SB + A dB'LdB with exits (upper triangle), B'r, and labelled rows.

    B_t = m grown B_{t-1} + (1 - m) design follows each name from zero after a gap.  A name that leaves pays
    for its grown B in the month after.  A month without any label is left out.
    """
    most = 1 + max(m.width(inputs) for m in maps)
    total_width = most * (most + 1) // 2 + most + 1

    def partial(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        total = np.zeros((len(maps) * months, total_width))
        for block in paths.blocks(batches, months, inputs):
            leaves = [block.held[:, t] & ~(block.held[:, t + 1] if t + 1 < months else True) for t in range(months)]
            for k, m in enumerate(maps):
                width = 1 + m.width(inputs)
                index = np.triu_indices(width)
                cells = len(index[0])
                inherited = np.zeros((len(block.held), width))
                gone = np.zeros((0, width))
                for t, here, x in _designs(block, m, moment[k], months):
                    speed = block["speed"][:, t, None]
                    b = np.where(here[:, None], speed * inherited + (1.0 - speed) * x, 0.0)
                    impact = np.sqrt(aum * block["lambda_adv"][:, t, None])
                    rows = np.concatenate([
                        (b * np.sqrt(gamma * block["variance"][:, t, None]))[here], ((b - inherited) * impact)[here], gone
                    ])
                    cell = total[k * months + t]
                    cell[:cells] += (rows.T @ rows)[index]
                    label = block["label"][:, t]
                    known = here & ~np.isnan(label)
                    cell[cells : cells + width] += b[known].T @ label[known]
                    cell[cells + width] += known.sum()
                    gone = (b * block["lift"][:, t, None] * impact)[leaves[t]]
                    inherited = b * block.kept(t)[:, None]
        return total

    # Calendar x maps rows: put together again.
    parts = paths.summed_parts(names, partial)
    items = F.array_sort(F.collect_list(F.struct("part", "values")))
    row = parts.groupBy("row").agg(items.alias("parts"))
    numbered = row.select(
        F.floor(F.col("row") / months).cast("int").alias("map"), (F.col("row") % months + 1).alias("t"), "parts"
    )
    return numbered.join(F.broadcast(stats.select("t", "eom")), "t").select("map", "eom", "t", "parts")


def _vectors(part: pd.DataFrame, width: int) -> np.ndarray:
    out = np.zeros((len(part), -(-width // paths.PART) * paths.PART))
    for i, cells in enumerate(part["parts"]):
        for c in cells:
            at = c["part"] * paths.PART
            if at < out.shape[1]:
                out[i, at : at + paths.PART] = c["values"]
    return out[:, :width]


def fits(
    statistic: DataFrame, years: Sequence[int], inputs: int, maps: Sequence[FeatureMap], penalties: Sequence[float],
    floor: float = S.COEFFICIENT_RIDGE_FLOOR,
) -> DataFrame:
    """Coefficients of every map, width, penalty and test year from the months up to November before it.

    A year without a labelled month before it has a row with n = 0 and a null fit.  One task solves one map:
    its table has one row per month.
    """

    def run(part: pd.DataFrame) -> pd.DataFrame:
        m = maps[int(part["map"].iloc[0])]
        width = 1 + m.width(inputs)
        index = np.triu_indices(width)
        cells = len(index[0])
        part = part.sort_values("t")
        values = _vectors(part, cells + width + 1)
        labelled = values[:, cells + width] > 0
        values, dates = values[labelled], pd.to_datetime(part["eom"])[labelled]
        running = np.cumsum(values, axis=0)
        out = []
        for year in years:
            n = int((dates <= pd.Timestamp(year - 1, 11, 30)).sum())
            for p in m.sizes():
                at = m.columns(p, inputs)
                for penalty in penalties:
                    key = [m.kind, m.eta, p, float(penalty), int(year)]
                    if not n:
                        out.append([*key, None, 0, *[None] * 5])
                        continue
                    full = np.zeros((width, width))
                    full[index] = running[n - 1, :cells]
                    full = full + np.triu(full, 1).T
                    h = full[np.ix_(at, at)] / n + max(penalty, floor) * np.eye(len(at))
                    r = running[n - 1, cells : cells + width][at] / n
                    beta = np.linalg.solve(h, r)
                    gradient = r - h @ beta
                    out.append([
                        *key, dates.iloc[n - 1].date(), n, beta.tolist(), float(r @ beta - 0.5 * beta @ h @ beta),
                        float(np.linalg.norm(gradient)), float(np.linalg.cond(h)), float(np.linalg.norm(beta)),
                    ])
        frame = pd.DataFrame(out, columns=[c.split()[0] for c in FITS.split(", ")], dtype=object)
        return frame

    return statistic.groupBy("map").applyInPandas(run, FITS)


def candidate_name(kind: str, eta: float | None, p: int | None, penalty: float) -> str:
    return f"{kind} lambda={penalty:g}" if p is None else f"{kind} p={p} eta={eta:g} lambda={penalty:g}"


def positions(
    names: DataFrame, months: int, years: dict[int, int], inputs: int, maps: Sequence[FeatureMap], moment: list, fitted: Sequence,
) -> DataFrame:
    """(method, candidate, entity, t, aim_weight, weight, inherited): each candidate trades towards its aim.

    ``years`` maps month numbers to test years; ``fitted`` holds the rows of ``fits`` (grid x years).  In a year
    without a fit a candidate holds nothing, and the next one starts from zero.
    """
    rows = priced_positions(names, months, years, inputs, maps, moment, fitted).where("not dropped")
    return rows.select("method", "candidate", "entity", "t", "aim_weight", "weight", "inherited")


def priced_positions(
    names: DataFrame, months: int, years: dict[int, int], inputs: int, maps: Sequence[FeatureMap], moment: list, fitted: Sequence,
) -> DataFrame:
    """``positions`` with what prices them (label, lambda_adv, variance), as the path of a name holds that.

    A name that is not held in the next month has a ``dropped`` row there, with a null weight and the impact it is
    left at.  So a ledger is a month sum: rows are neither joined nor shuffled by name once they are multiplied by the
    candidates.
    """
    plans: list[list[tuple[str, str, np.ndarray, dict[int, np.ndarray]]]] = []
    for m in maps:
        own = []
        for p in m.sizes():
            mine = [r for r in fitted if (r.kind, r.eta, r.p) == (m.kind, m.eta, p)]
            for penalty in sorted({r.penalty for r in mine}):
                beta = {r.test_year: np.array(r.beta) for r in mine if r.penalty == penalty and r.beta is not None}
                own.append((f"portfolio_ml_{m.kind}", candidate_name(m.kind, m.eta, p, penalty), m.columns(p, inputs), beta))
        plans.append(own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in paths.blocks(batches, months, inputs):
            row, at = np.nonzero(block.held)
            for m, own, found in zip(maps, plans, moment):
                shape = (len(own), *block.held.shape)
                aims, weights, priors = np.full(shape, np.nan), np.zeros(shape), np.zeros(shape)
                before = np.zeros((len(own), len(block.held)))
                for t, here, x in _designs(block, m, found, months):
                    speed, keep = block["speed"][:, t], block.kept(t)
                    for c, (_, _, columns, betas) in enumerate(own):
                        beta = betas.get(years.get(t + 1))
                        if beta is None:
                            before[c] = 0.0
                            continue
                        aims[c, :, t] = x[:, columns] @ beta
                        priors[c, :, t] = before[c]
                        weights[c, :, t] = np.where(here, speed * before[c] + (1.0 - speed) * aims[c, :, t], 0.0)
                        before[c] = weights[c, :, t] * keep
                for c, (method, name, *_) in enumerate(own):
                    used = ~np.isnan(aims[c, row, at])
                    r, t = row[used], at[used]
                    here = np.zeros(block.held.shape, bool)
                    here[r, t] = True
                    gone, last = np.nonzero(here[:, :-1] & ~here[:, 1:])
                    no = np.full(len(gone), np.nan)
                    out = (
                        np.append(aims[c, r, t], no), np.append(weights[c, r, t], no),
                        np.append(priors[c, r, t], weights[c, gone, last] * block["lift"][gone, last]),
                        np.append(block["label"][r, t], no),
                        np.append(block["lambda_adv"][r, t], block["lambda_adv"][gone, last]),
                        np.append(block["variance"][r, t], no),
                    )
                    many = len(r) + len(gone)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([method] * many), pa.array([name] * many),
                            block.entity.take(pa.array(np.append(r, gone))), pa.array(np.append(t + 1, last + 2), pa.int32()),
                            *[pa.array(v, from_pandas=True) for v in out], pa.array(np.arange(many) >= len(r)),
                        ],
                        ["method", "candidate", "entity", "t", *values, "dropped"],
                    )

    values = ("aim_weight", "weight", "inherited", "label", "lambda_adv", "variance")
    kind = names.schema["entity"].dataType.simpleString()
    numbers = ", ".join(f"{v} double" for v in values)
    return names.mapInArrow(run, f"method string, candidate string, entity {kind}, t int, {numbers}, dropped boolean")


def carried(positions: DataFrame, stats: DataFrame) -> DataFrame:
    """Positions with the columns that ``ledger.evaluate`` reads."""
    timed = positions.join(F.broadcast(stats.select("eom", "t", "wealth_growth")), "t")
    return timed.withColumns({
        "ret_exc_lead1m": F.col("label"), "trade": F.col("weight") - F.col("inherited"),
        "exit_lambda": F.when(F.col("dropped"), F.col("lambda_adv")),
        "lambda_adv": F.when(~F.col("dropped"), F.col("lambda_adv")),
    })
