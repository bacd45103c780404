"""Exact Lloyd clustering with Ptolemaic pivot bounds.

A few vectors are fixed as pivots, and every vector keeps its distances to them.  Ptolemy's inequality bounds
the distance of vector x and centroid c from below by |xp cq - xq cp| / pq for any pivots p and q, so a round
needs whole vectors only for the centroids whose bound doesn't exceed the distance to the likeliest one.
Bounds are rounded down; whoever is left is compared by whole-number squared distance.

A round is one pass over the written vectors: partial sums by centroid go to the driver added up, at most one
row per centroid and entry.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from crosspanel.llm import exact
from crosspanel.llm.base import written

SCALE = 1024
PIVOTS = 4
#: Relative error that the bounds leave for rounding.
ROUNDING = 1e-12
#: Entries up to this size have squared distances that fit a long at 64 entries.
PEAK = 2.0**27
#: Components of this size or more have no place: their summed squares would not fit the limbs of a sum.
LARGEST = 2.0**90
SLICE = 4096


def whole_numbers(flat: np.ndarray, dims: int) -> np.ndarray:
    """Rows of whole numbers: int64 where every squared distance fits, else Python numbers."""
    rows = flat.reshape(-1, dims)
    if dims * (2.0 * np.abs(rows).max(initial=0.0)) ** 2 < 2.0**62:
        return rows.astype(np.int64)
    return np.array([[int(v) for v in r] for r in rows], object).reshape(rows.shape)


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows; Python numbers where an int64 might not do."""
    if x.dtype == object or c.dtype == object or max(np.abs(x).max(initial=0), np.abs(c).max(initial=0)) >= PEAK:
        x, c = x.astype(object), c.astype(object)
    d = x - c
    return (d * d).sum(axis=-1)


def distances(x: np.ndarray, pivots: list[list[int]]) -> np.ndarray:
    """Distances to the pivots, each rounded once from an exact square."""
    columns = [np.sqrt(squared(x, _row(p, x)).astype(float)) for p in pivots]
    return np.stack(columns, axis=1) if columns else np.zeros((len(x), 0))


def _row(values: list[int], like: np.ndarray) -> np.ndarray:
    big = like.dtype == object or max(map(abs, values), default=0) >= PEAK
    return np.array([values], object if big else np.int64)


def lower_bounds(xp: np.ndarray, cp: np.ndarray, pp: np.ndarray) -> np.ndarray:
    """Ptolemaic bounds from below on the distance of each vector (rows) to each centroid (columns), rounded down.

    ``xp`` and ``cp`` hold distances to the pivots, ``pp`` those among pivots.  A bound that is not a number
    counts as zero.
    """
    out = np.zeros((len(xp), len(cp)))
    with np.errstate(all="ignore"):
        for p, q in combinations(range(len(pp)), 2):
            if pp[p, q] > 0:
                a, b = np.outer(xp[:, p], cp[:, q]), np.outer(xp[:, q], cp[:, p])
                bound = (np.abs(a - b) - ROUNDING * (a + b)) / (pp[p, q] * (1 + ROUNDING))
                np.fmax(out, bound, out=out)
    return out


class Pruner:
    """Nearest centroids of batches of vectors, for one set of centroids."""

    def __init__(self, centroids: list[list[int]], pivots: list[list[int]]):
        self.centroids = centroids
        flat = np.array(pivots, object).reshape(len(pivots), -1)
        rows = np.array(centroids, object).reshape(len(centroids), -1)
        self.pp, self.cp = distances(flat, pivots), distances(rows, pivots)

    def nearest(self, x: np.ndarray, xp: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Cluster and exact squared distance of each row, and how many exact distances were computed.

        The centroid of the smallest bound comes first; then each, by number, whose bound isn't above the
        best so far.  Ties go to the smaller number.
        """
        bounds = lower_bounds(xp, self.cp, self.pp)
        first = bounds.argmin(axis=1)
        cluster = np.full(len(x), -1)
        best = np.zeros(len(x), x.dtype)
        checked = 0
        for c in range(len(self.centroids)):
            at = np.flatnonzero(first == c)
            if len(at):
                found = squared(x[at], _row(self.centroids[c], x))
                best = best.astype(object) if found.dtype == object and best.dtype != object else best
                best[at], cluster[at] = found, c
                checked += len(at)
        for c in range(len(self.centroids)):
            with np.errstate(over="ignore"):
                reach = np.sqrt(best.astype(float)) * (1 + ROUNDING)
            at = np.flatnonzero((first != c) & ~(bounds[:, c] > reach))
            if len(at):
                found = squared(x[at], _row(self.centroids[c], x))
                checked += len(at)
                nearer = (found < best[at]) | ((found == best[at]) & (c < cluster[at]))
                best = best.astype(object) if found.dtype == object and best.dtype != object else best
                best[at[nearer]], cluster[at[nearer]] = found[nearer], c
        return cluster, best, checked


def usable(vectors: DataFrame, dims: int) -> DataFrame:
    """(vec_id, vector) with whole numbers as doubles, which hold them exactly."""
    x = F.transform(F.col("embedding").cast("array<double>"), lambda c: c * float(SCALE))
    fits = F.forall("vector", lambda c: F.abs(c) < SCALE * LARGEST)
    rows = vectors.select("vec_id", x.alias("vector")).where(
        exact.finite(F.col("vector")) & (F.size("vector") == dims) & fits
    )
    # Not F.floor: its result is a long, which not every double fits.
    return rows.mapInArrow(_floored, rows.schema)


def _floored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        column = batch.column("vector")
        values = pa.array(np.floor(np.asarray(column.flatten())))
        # Offsets of a sliced array don't begin at zero.
        offsets = pa.array(np.asarray(column.offsets) - (column.offsets[0].as_py() if len(column.offsets) else 0), pa.int32())
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.ListArray.from_arrays(offsets, values)], ["vec_id", "vector"])


def starts(rows: DataFrame, clusters: int, seed: str = "3:") -> list[list[int]]:
    """The vectors with the smallest sha256 of seed and id, in that order; ties by vector, null ids last."""
    key = F.sha2(F.concat(F.lit(seed), F.col("vec_id").cast("string")), 256)
    first = rows.select(key.alias("key"), "vector").orderBy(F.asc_nulls_last("key"), "vector").limit(clusters)
    return [[int(v) for v in r.vector] for r in first.collect()]


def fixed_pivots(centroids: list[list[int]]) -> list[list[int]]:
    """Up to PIVOTS different start vectors, each the farthest from those before."""
    out = centroids[:1]
    while len(out) < PIVOTS:
        gaps = [min(sum((a - b) ** 2 for a, b in zip(c, p)) for p in out) for c in centroids] if out else []
        if not gaps or max(gaps) == 0:
            break
        out = [*out, centroids[gaps.index(max(gaps))]]
    return out


def _batches(batches: Iterator[pa.RecordBatch], dims: int):
    for whole in batches:
        for start in range(0, whole.num_rows, SLICE):
            batch = whole.slice(start, SLICE)
            yield batch, whole_numbers(np.asarray(batch.column("vector").flatten()), dims)


def totals(cached: DataFrame, pruner: Pruner, dims: int) -> tuple[dict[int, int], dict[tuple[int, int], int]]:
    """By cluster: count; by (cluster, entry): sum, and at entry ``dims`` the summed squared distances.  Exact."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], int] = {}
        counts: dict[int, int] = {}
        for batch, x in _batches(batches, dims):
            xp = np.asarray(batch.column("near").flatten()).reshape(len(x), -1)
            cluster, found, _ = pruner.nearest(x, xp)
            for c in np.unique(cluster).tolist():
                at = cluster == c
                counts[c] = counts.get(c, 0) + int(at.sum())
                part = np.append(x[at].astype(object).sum(axis=0) if x.dtype == object else x[at].sum(axis=0).astype(object),
                                 sum(map(int, found[at].tolist())))
                for i, v in enumerate(part.tolist()):
                    sums[c, i] = sums.get((c, i), 0) + int(v)
        cells = [(c, -1, n) for c, n in counts.items()] + [(c, i, v) for (c, i), v in sums.items()]
        if cells:
            limbs = list(zip(*[exact.split(v) for _, _, v in cells]))
            columns = [pa.array([c[k] for c in cells], pa.int32()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*columns, *[pa.array(v, pa.int64()) for v in limbs]], ["c", "i", *exact.NAMES])

    rows = cached.select("vector", "near").mapInArrow(partial, f"c int, i int, {exact.SCHEMA}")
    # At most clusters * (dims + 2) rows.
    found = {(r.c, r.i): exact.join(r[2:]) for r in exact.summed(rows, "c", "i").collect()}
    return {c: v for (c, i), v in found.items() if i < 0}, {k: v for k, v in found.items() if k[1] >= 0}


def cluster(vectors: DataFrame, clusters: int = 8, rounds: int = 10, dims: int = 64) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256), one row per usable vector.

    ``vectors`` has vec_id and embedding; more columns are ignored.  Vectors that are null, of another length,
    or hold a null or non-finite component or one of 2^90 or more, take no part.  Null ids and repeated rows
    stay, a row each; a null id starts a centroid only where other ids are too few.  Fewer vectors than
    ``clusters`` give as many centroids.  A distance or inertia that doesn't fit a long is null; it still
    counts in full.  An empty table gives no rows.
    """
    schema = (
        "vec_id {}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    ).format(vectors.schema["vec_id"].dataType.simpleString())
    rows = usable(vectors, dims)
    centroids = starts(rows, clusters)
    if not centroids:
        return vectors.sparkSession.createDataFrame([], schema)
    pivots = fixed_pivots(centroids)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, x in _batches(batches, dims):
            values = pa.array(distances(x, pivots).tolist(), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns, values], [*batch.schema.names, "near"])

    fields = f"vec_id {vectors.schema['vec_id'].dataType.simpleString()}, vector array<double>, near array<double>"
    cached = written(rows.mapInArrow(near, fields), "vectors")
    for _ in range(rounds):
        counts, sums = totals(cached, Pruner(centroids, pivots), dims)
        moved = [
            [sums[c, i] // counts[c] for i in range(dims)] if c in counts else old for c, old in enumerate(centroids)
        ]
        if moved == centroids:
            # Every further round would repeat this one.
            break
        centroids = moved
    pruner = Pruner(centroids, pivots)
    _, sums = totals(cached, pruner, dims)
    inertia = [sums.get((c, dims), 0) for c in range(len(centroids))]
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]

    def fit(value: int) -> int | None:
        return value if value < 1 << 63 else None

    own, whole = pa.array(list(map(fit, inertia)), pa.int64()), fit(sum(inertia))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, x in _batches(batches, dims):
            xp = np.asarray(batch.column("near").flatten()).reshape(len(x), -1)
            found, squares, _ = pruner.nearest(x, xp)
            at = pa.array(found, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("vec_id"), at, pa.array([fit(int(v)) for v in squares.tolist()], pa.int64()), own.take(at),
                    pa.array([whole] * len(x), pa.int64()), pa.array(digests).take(at),
                ],
                [f.split()[0] for f in schema.split(", ")],
            )

    return cached.mapInArrow(assign, schema)
