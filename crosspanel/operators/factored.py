"""Policies with carried positions under factored risk, for a whole grid of candidates and all months.

A month's weights are (rhs - B s) / d: rhs pulls towards the position carried in, and the factor vector s of
the month comes from sums over all names.  Months therefore hang together through the K-vectors s alone.
Given their path every name is an affine scan of its own, and one pass over the names gives every month's
sums.  How a month's sums answer to the vectors of the last ``lags`` months is summed once; with that the
path is corrected forward in time, so each round settles ``lags`` more months for good, and the rest to the
power of what a position keeps over so many months.  No entity-by-entity matrix and no loop over jobs per
month: rounds are counted and stay far under months / lags.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from crosspanel import settings as S
from crosspanel.operators import paths

NUMBERS = ("mu", "lambda_adv", "idio_variance", "factor_total_variance")


@dataclass(frozen=True)
class Candidate:
    """(gamma (S + shrinkage diag(S) + ridge I) + aum cost L) w = scale mu + aum cost L inherited."""

    method: str
    name: str
    scale: float
    cost: float
    shrinkage: float = 0.0


@dataclass
class FactorPath:
    """The factor vectors s by candidate and month number, and how they were found."""

    values: np.ndarray
    rounds: int
    change: float
    history: list[float] = field(default_factory=list)


def entity_paths(rows: DataFrame, stats: DataFrame) -> DataFrame:
    """One row per name with its months in order.

    ``rows`` has eom, entity, mu, lambda_adv, loadings, idio_variance, factor_total_variance and
    ret_exc_lead1m.  A row without a number in one of them, or without a positive impact, holds no position.
    """
    return paths.entity_paths(rows, stats, NUMBERS, "loadings")


def scan(block: paths.Block, candidate: Candidate, path: np.ndarray | None, gamma: float, aum: float, ridge: float, lags: int = 0):
    """Per month: weight, inherited, B/d (names, factors), rhs sums, and sensitivities to earlier vectors."""
    pull = aum * candidate.cost * block["lambda_adv"]
    own = block["idio_variance"] + candidate.shrinkage * block["factor_total_variance"] + ridge
    d = np.where(block.held, gamma * own + pull, 1.0)
    inherited = np.zeros(len(block.held))
    behind: list[np.ndarray] = []
    for t in range(block.held.shape[1]):
        here = block.held[:, t]
        tilt = block.vector[:, t] / d[:, t, None]
        rhs = np.where(here, candidate.scale * block["mu"][:, t] + pull[:, t] * inherited, 0.0)
        weight = rhs / d[:, t]
        if path is not None:
            weight = weight - tilt @ path[t]
        yield t, here, weight, inherited, tilt, rhs, pull[:, t], behind
        keep = block.kept(t)
        share = np.where(here, pull[:, t] / d[:, t], 0.0) * keep
        behind = [-tilt * keep[:, None], *[share[:, None] * b for b in behind]][:lags]
        inherited = weight * keep


def solve_path(
    names: DataFrame, covariances: dict[int, np.ndarray], months: int, candidates: Sequence[Candidate],
    gamma: float = S.GAMMA, aum: float = S.AUM, ridge: float = S.COVARIANCE_RIDGE, lags: int = 6, tolerance: float = 1e-12,
) -> FactorPath:
    """The factor vectors of every candidate and month.

    ``covariances`` maps the month number to its K x K factor covariance; a month without one has no factor
    part.  The change of a round is relative to the largest vector; rounds end once it is at most
    ``tolerance``, and at (months / lags) + 2 at the latest, when the path is exact whatever the data.
    """
    k = len(next(iter(covariances.values()))) if covariances else 0
    many, lags = len(candidates), max(1, min(lags, months))
    path = np.zeros((many, months, k))
    if not k or not months:
        return FactorPath(path, 0, 0.0)
    width = k * k + k + lags * k * k

    def first(batches):
        total = np.zeros((many, months, width))
        for block in paths.blocks(batches, months, k):
            for c, candidate in enumerate(candidates):
                for t, here, _, _, tilt, rhs, pull, behind in scan(block, candidate, None, gamma, aum, ridge, lags):
                    cell = total[c, t]
                    cell[: k * k] += (tilt[here].T @ block.vector[here, t]).ravel()
                    cell[k * k : k * k + k] += tilt[here].T @ rhs[here]
                    for lag, b in enumerate(behind):
                        at = k * k + k + lag * k * k
                        cell[at : at + k * k] += ((tilt * pull[:, None])[here].T @ b[here]).ravel()
        return total

    sums = paths.summed(names, first, (many, months, width))
    inner = sums[..., : k * k].reshape(many, months, k, k)
    pulled = sums[..., k * k : k * k + k]
    answer = sums[..., k * k + k :].reshape(many, months, lags, k, k)
    f = np.stack([gamma * covariances.get(t + 1, np.zeros((k, k))) for t in range(months)])
    systems = np.eye(k) + f[None] @ inner

    def corrected(old: np.ndarray, at_old: np.ndarray) -> np.ndarray:
        new = np.zeros_like(old)
        for t in range(months):
            r = at_old[:, t].copy()
            for lag in range(1, min(lags, t) + 1):
                r += np.einsum("cij,cj->ci", answer[:, t, lag - 1], new[:, t - lag] - old[:, t - lag])
            new[:, t] = np.linalg.solve(systems[:, t], (f[t] @ r[..., None]))[..., 0]
        return new

    def pulls(now: np.ndarray) -> np.ndarray:
        def partial(batches):
            total = np.zeros((many, months, k))
            for block in paths.blocks(batches, months, k):
                for c, candidate in enumerate(candidates):
                    for t, here, _, _, tilt, rhs, _, _ in scan(block, candidate, now[c], gamma, aum, ridge):
                        total[c, t] += tilt[here].T @ rhs[here]
            return total

        return paths.summed(names, partial, (many, months, k))

    found, change, history = corrected(path, pulled), np.inf, []
    for count in range(1, -(-months // lags) + 3):
        new = corrected(found, pulls(found))
        change = float(np.abs(new - found).max() / max(np.abs(new).max(), 1e-300))
        found = new
        history.append(change)
        if change <= tolerance:
            break
    return FactorPath(found, count, change, history)


def positions(
    names: DataFrame, path: FactorPath, candidates: Sequence[Candidate], gamma: float = S.GAMMA, aum: float = S.AUM,
    ridge: float = S.COVARIANCE_RIDGE,
) -> DataFrame:
    """(method, candidate, entity, t, weight, inherited) of every candidate, name and month, in one pass."""
    values = path.values
    months, k = values.shape[1:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in paths.blocks(batches, months, k):
            for c, candidate in enumerate(candidates):
                weight, inherited = np.zeros(block.held.shape), np.zeros(block.held.shape)
                for t, _, w, prior, *_ in scan(block, candidate, values[c], gamma, aum, ridge):
                    weight[:, t], inherited[:, t] = w, prior
                row, t = np.nonzero(block.held)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([candidate.method] * len(row)), pa.array([candidate.name] * len(row)),
                        block.entity.take(pa.array(row)), pa.array(t + 1, pa.int32()),
                        pa.array(weight[row, t]), pa.array(inherited[row, t]),
                    ],
                    ["method", "candidate", "entity", "t", "weight", "inherited"],
                )

    kind = names.schema["entity"].dataType.simpleString()
    return names.mapInArrow(run, f"method string, candidate string, entity {kind}, t int, weight double, inherited double")


def month_covariances(matrices: DataFrame, stats: DataFrame) -> dict[int, np.ndarray]:
    """Factor covariances by month number: calendar x K x K numbers."""
    rows = stats.join(F.broadcast(matrices), "eom").select("t", "factor_cov").collect()
    return {r.t: np.array([list(x) for x in r.factor_cov], float) for r in rows}
