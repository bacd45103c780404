"""Whitening of embeddings by the exact characteristic polynomial of their integer scatter.

One pass over the vectors adds up whole-number moments.  The scatter matrix they give is reduced to
Hessenberg form modulo many primes, spread over tasks; the residues of its characteristic polynomial join by
Chinese remaindering.  All its roots are real, so the sign changes of the polynomial shifted to a point count
the roots above that point exactly, which isolates them; they are then narrowed to RELATIVE bits.  A root's
component comes from the null space of scatter minus root, by elimination with a wide mantissa and inverse
iteration, and a second pass projects every vector on the components.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession, functions as F

from crosspanel.llm import exact

#: Entries become floor(SCALE * c) + OFFSET.
SCALE, OFFSET = 64, 1_000_000
#: Bits to which roots are narrowed, beyond the leading one of the largest; of the elimination's mantissa; of primes.
RELATIVE, MANTISSA, PRIME_BITS = 160, 320, 31
#: Most entries of a vector: the polynomial and its roots are found on the driver.
MOST_DIMENSIONS = 256


def entries(batch: pa.RecordBatch, column: str, dims: int) -> np.ndarray:
    """The rows' whole numbers without the offset, as float64, which holds each of them exactly."""
    flat = np.asarray(batch.column(column).flatten().cast(pa.float64()))
    return np.floor(SCALE * flat).reshape(-1, dims)


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, vector) of the rows that take part."""
    x = F.col("embedding").cast("array<double>")
    fits = F.forall("vector", lambda c: F.abs(c) < 2.0**56)
    return vectors.select("vec_id", x.alias("vector")).where(exact.finite(F.col("vector")) & fits)


def product(a: np.ndarray) -> list[list[int]]:
    """a' a in whole numbers: by float sums where they fit 53 bits, which are exact, else number by number."""
    peak = float(np.abs(a).max(initial=0.0))
    if peak <= 2.0**24:
        dims = a.shape[1]
        total = np.zeros((dims, dims), np.int64).astype(object)
        rows = max(1, int(2.0**53 / max(peak, 1.0) ** 2))
        for at in range(0, len(a), rows):
            part = a[at : at + rows]
            total = total + (part.T @ part).astype(np.int64).astype(object)
        return total.tolist()
    whole = np.array([[int(v) for v in r] for r in a], object)
    return whole.T.dot(whole).tolist()


def moments(vectors: DataFrame) -> tuple[int, list[int], list[list[int]]]:
    """Count, sums and sums of products of the vectors' whole numbers (without the offset), all exact."""
    found = vectors.agg(F.min(F.size("vector")).alias("low"), F.max(F.size("vector")).alias("high")).first()
    dims = found.high or 0
    if found.low != found.high:
        raise ValueError(f"vectors of {found.low} to {found.high} entries")
    if dims > MOST_DIMENSIONS:
        raise ValueError(f"vectors of more than {MOST_DIMENSIONS} entries")
    if not dims:
        return 0, [], []

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, sums, products = 0, [0] * dims, [[0] * dims for _ in range(dims)]
        for batch in batches:
            if batch.num_rows:
                a = entries(batch, "vector", dims)
                count += len(a)
                peak = float(np.abs(a).max())
                column = a.sum(axis=0) if peak * len(a) < 2.0**53 else [sum(map(int, c)) for c in a.T]
                sums = [s + int(v) for s, v in zip(sums, column)]
                products = [[p + int(v) for p, v in zip(r, q)] for r, q in zip(products, product(a))]
        if count:
            cells = [(-1, -1, count), *[(-1, i, s) for i, s in enumerate(sums)]]
            cells += [(i, j, products[i][j]) for i in range(dims) for j in range(i + 1)]
            limbs = list(zip(*[exact.split(v) for _, _, v in cells]))
            columns = [pa.array([c[0] for c in cells], pa.int32()), pa.array([c[1] for c in cells], pa.int32())]
            yield pa.RecordBatch.from_arrays(
                columns + [pa.array(v, pa.int64()) for v in limbs], ["i", "j", *exact.NAMES]
            )

    rows = vectors.select("vector").mapInArrow(partial, f"i int, j int, {exact.SCHEMA}")
    # At most dims * (dims + 3) / 2 + 1 rows.
    values = {(r.i, r.j): exact.join(r[2:]) for r in exact.summed(rows, "i", "j").collect()}
    square = [[values[max(i, j), min(i, j)] for j in range(dims)] for i in range(dims)]
    return values[-1, -1], [values[-1, i] for i in range(dims)], square


def is_prime(n: int) -> bool:
    """Exact for n under 3.2e9: strong probable prime to the bases 2, 3, 5 and 7."""
    if n < 11 or n % 2 == 0:
        return n in (2, 3, 5, 7)
    odd, twos = n - 1, 0
    while odd % 2 == 0:
        odd, twos = odd // 2, twos + 1
    for base in (2, 3, 5, 7):
        x = pow(base, odd, n)
        if x not in (1, n - 1) and all((x := x * x % n) != n - 1 for _ in range(twos - 1)):
            return False
    return True


def primes_for(bits: int) -> list[int]:
    """The largest primes under 2^PRIME_BITS whose product has more than ``bits`` bits."""
    out, total, at = [], 0.0, (1 << PRIME_BITS) - 1
    while total <= bits + 1:
        if is_prime(at):
            out.append(at)
            total += math.log2(at)
        at -= 2
    return out


def residues(matrix: list[list[int]], primes: list[int]) -> np.ndarray:
    """Coefficients of det(xI - matrix), lowest first, modulo each prime: one row per prime.

    All primes are worked on at once.  A Gauss similarity clears a column under its subdiagonal; the
    polynomial of a Hessenberg matrix then follows from those of its leading blocks.
    """
    n, many = len(matrix), len(primes)
    p = np.array(primes, np.int64)
    h = np.array([[[v % q for v in row] for row in matrix] for q in primes], np.int64).reshape(many, n, n)
    each = np.arange(many)
    for c in range(n - 2):
        below = h[:, c + 1 :, c] != 0
        pivot = c + 1 + below.argmax(axis=1)
        top, chosen = h[:, c + 1].copy(), h[each, pivot].copy()
        h[each, pivot], h[:, c + 1] = top, chosen
        left, right = h[:, :, c + 1].copy(), h[each, :, pivot].copy()
        h[each, :, pivot], h[:, :, c + 1] = left, right
        lead = [pow(int(v), -1, int(q)) if v else 0 for v, q in zip(h[:, c + 1, c], p)]
        factor = h[:, c + 2 :, c] * np.array(lead, np.int64)[:, None] % p[:, None]
        for i in range(c + 2, n):
            m = factor[:, i - c - 2, None]
            h[:, i] = (h[:, i] - m * h[:, c + 1] % p[:, None]) % p[:, None]
        for i in range(c + 2, n):
            m = factor[:, i - c - 2, None]
            h[:, :, c + 1] = (h[:, :, c + 1] + m * h[:, :, i] % p[:, None]) % p[:, None]
    polys = [np.zeros((many, n + 1), np.int64)]
    polys[0][:, 0] = 1
    for k in range(n):
        q = np.zeros((many, n + 1), np.int64)
        q[:, 1:] = polys[k][:, :-1]
        q = (q - h[:, k, k, None] * polys[k] % p[:, None]) % p[:, None]
        run = np.ones(many, np.int64)
        for i in range(k - 1, -1, -1):
            run = run * h[:, i + 1, i] % p
            term = run * h[:, i, k] % p
            q = (q - term[:, None] * polys[i] % p[:, None]) % p[:, None]
        polys.append(q)
    return polys[n]


def coefficients(values: np.ndarray, primes: list[int]) -> list[int]:
    """The whole-number polynomial whose residues are the rows of ``values`` (Chinese remaindering)."""
    whole = math.prod(primes)
    weights = [whole // p * pow(whole // p % p, -1, p) for p in primes]
    out = []
    for k in range(values.shape[1]):
        c = sum(int(v) * w for v, w in zip(values[:, k], weights)) % whole
        out.append(c - whole if 2 * c > whole else c)
    return out


def characteristic(spark: SparkSession, matrix: list[list[int]]) -> list[int]:
    """det(xI - matrix) of a positive semidefinite whole-number matrix; primes are dealt over tasks.

    Its k-th coefficient is a sum of products of k roots, at most binomial(n, k) (trace / n)^k.
    """
    n, trace = len(matrix), sum(matrix[i][i] for i in range(len(matrix)))
    bits = max((math.comb(n, k) * (trace // n + 1) ** k).bit_length() for k in range(n + 1)) + 1
    primes = primes_for(bits)
    rows = [Row(at=i, prime=p) for i, p in enumerate(primes)]
    tasks = max(1, len(primes) // 16)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = residues(matrix, batch.column("prime").to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("at"), pa.array(found.tolist(), pa.list_(pa.int64()))], ["at", "values"]
                )

    table = spark.createDataFrame(rows, "at int, prime long").repartition(tasks, "at")
    found = {r.at: r["values"] for r in table.mapInArrow(run, "at int, values array<bigint>").collect()}
    return coefficients(np.array([found[i] for i in range(len(primes))], np.int64).reshape(len(primes), n + 1), primes)


def roots_above(poly: list[int], at: int) -> int:
    """How many roots, all of them real, are greater than ``at``: sign changes of the polynomial in x + at."""
    c = list(poly)
    for i in range(len(c) - 1):
        for k in range(len(c) - 2, i - 1, -1):
            c[k] += at * c[k + 1]
    signs = [v > 0 for v in c if v]
    return sum(a != b for a, b in zip(signs, signs[1:]))


def value_sign(poly: list[int], at: int) -> int:
    total = 0
    for c in reversed(poly):
        total = total * at + c
    return (total > 0) - (total < 0)


def roots(poly: list[int], most: int, shift: int) -> list[int]:
    """The ``most`` largest roots, each as the least whole number not under root * 2^shift, falling; all are real.

    Intervals (low, high] are halved, and counts of roots above a point tell the halves apart.  Once a root is
    alone and simple, the sign of the polynomial is enough.
    """
    degree = len(poly) - 1
    scaled = [c << (shift * (degree - k)) for k, c in enumerate(poly)]
    top = 1 << ((max(abs(c) for c in poly).bit_length() + shift) + 1)
    # Roots are at most the trace.
    top = min(top, ((-poly[-2] if degree else 0) << shift) + 1)
    found: list[int] = []

    def search(low: int, above_low: int, high: int, above_high: int) -> None:
        if above_low == above_high or len(found) >= most:
            return
        if above_low - above_high == 1:
            side = value_sign(scaled, high)
            if side == 0:
                found.append(high)
                return
            while high - low > 1:
                middle = (low + high) // 2
                sign = value_sign(scaled, middle)
                low, high = (low, middle) if sign in (0, side) else (middle, high)
            found.append(high)
            return
        if high - low == 1:
            found.extend([high] * (above_low - above_high))
            return
        middle = (low + high) // 2
        above = roots_above(scaled, middle)
        search(middle, above, high, above_high)
        search(low, above_low, middle, above)

    search(-1, degree, top, 0)
    return found[:most]


def null_vectors(matrix: list[list[int]], root: int, shift: int, many: int) -> list[list[int]]:
    """``many`` orthonormal vectors (times 2^MANTISSA) of the null space of matrix - root / 2^shift.

    Elimination with complete pivoting leaves the pivots that vanish for the end; each of those ``many``
    places gives a start vector, two steps of inverse iteration follow.
    """
    n, one = len(matrix), 1 << MANTISSA
    extra = MANTISSA - shift
    a = [[(v << MANTISSA) - ((root << extra) if i == j else 0) for j, v in enumerate(r)] for i, r in enumerate(matrix)]
    rows, columns = list(range(n)), list(range(n))
    for k in range(n):
        i, j = max(((i, j) for i in range(k, n) for j in range(k, n)), key=lambda c: abs(a[c[0]][c[1]]))
        a[k], a[i] = a[i], a[k]
        rows[k], rows[i] = rows[i], rows[k]
        if j != k:
            for r in a:
                r[k], r[j] = r[j], r[k]
            columns[k], columns[j] = columns[j], columns[k]
        if not a[k][k]:
            a[k][k] = 1
        pivot, lead = a[k][k], a[k]
        for r in a[k + 1 :]:
            if r[k]:
                factor = (r[k] << MANTISSA) // pivot
                r[k] = factor
                for c in range(k + 1, n):
                    r[c] -= factor * lead[c] >> MANTISSA
            else:
                r[k] = 0

    def solve(b: list[int], begun: bool) -> list[int]:
        """x of (matrix - root) x = b, or of the upper triangle alone when ``begun``."""
        y = b if begun else [b[r] for r in rows]
        if not begun:
            for i in range(n):
                y[i] -= sum(a[i][c] * y[c] for c in range(i)) >> MANTISSA
        x = [0] * n
        for i in range(n - 1, -1, -1):
            x[i] = ((y[i] << MANTISSA) - sum(a[i][c] * x[c] for c in range(i + 1, n))) // a[i][i]
        return [x[columns.index(i)] for i in range(n)]

    def unit(v: list[int], others: list[list[int]]) -> list[int]:
        for _ in range(2):
            size = max(map(abs, v)).bit_length()
            v = [x << MANTISSA - size if size < MANTISSA else x >> size - MANTISSA for x in v]
            for o in others:
                along = sum(x * y for x, y in zip(v, o)) >> MANTISSA
                v = [x - (along * y >> MANTISSA) for x, y in zip(v, o)]
        length = math.isqrt(sum(x * x for x in v))
        return [(x << MANTISSA) // length for x in v]

    out: list[list[int]] = []
    for place in range(n - many, n):
        v = unit(solve([one if i == place else 0 for i in range(n)], True), out)
        for _ in range(2):
            v = unit(solve(v, False), out)
        most = max(range(n), key=lambda i: abs(v[i]))
        out.append([-x for x in v] if v[most] < 0 else v)
    return out


class Whitener:
    """Components, their whitening weights (one column each) and shares of the trace."""

    def __init__(self, spark: SparkSession, count: int, sums: list[int], products: list[list[int]], most: int):
        dims = self.dims = len(sums)
        self.count, self.sums = count, sums
        # n^2 times the covariance.  The offset cancels.
        scatter = [[count * products[i][j] - sums[i] * sums[j] for j in range(dims)] for i in range(dims)]
        trace = sum(scatter[i][i] for i in range(dims))
        self.polynomial = characteristic(spark, scatter) if trace else []
        bits = max(trace.bit_length(), 1)
        shift = self.shift = max(8, RELATIVE - bits + 64)
        found = roots(self.polynomial, most, shift) if trace else []
        # A root under 2^-100 of the trace is zero: a whole-number polynomial has no such root otherwise.
        found = [r for r in found if r > 1 and (r << 100) > trace << shift]
        self.roots, vectors = found, []
        for r in sorted(set(found), reverse=True):
            vectors += null_vectors(scatter, r, shift, found.count(r))
        # d = n x - S has the covariance n^2 V, so dividing by the root's square root whitens d.
        lengths = [math.isqrt(r << (2 * MANTISSA - shift)) for r in found]
        self.weights = np.array(
            [[x / s for x in v] for v, s in zip(vectors, lengths)], float
        ).reshape(len(found), dims).T
        self.components = np.array([[x / 2.0**MANTISSA for x in v] for v in vectors], float).reshape(len(found), dims)
        self.explained = [r / (trace << shift) for r in found]


def _deviations(a: np.ndarray, count: int, sums: list[int]) -> tuple[np.ndarray, list[int | None]]:
    """n x - S as doubles, and its squared lengths, exact (None beyond a long)."""
    peak = count * float(np.abs(a).max(initial=0.0)) + max(map(abs, sums))
    if peak * peak * a.shape[1] < 2.0**62:
        d = count * a.astype(np.int64) - np.array(sums, np.int64)
        return d.astype(float), (d * d).sum(axis=1).tolist()
    whole = [[count * int(v) - s for v, s in zip(r, sums)] for r in a]
    squares = [sum(v * v for v in r) for r in whole]
    return np.array([[float(v) for v in r] for r in whole]), [s if s < 1 << 63 else None for s in squares]


def fit(vectors: DataFrame, most: int = 32) -> Whitener | None:
    """The whitener of all usable vectors; None if there are none."""
    count, sums, products = moments(usable(vectors))
    return Whitener(vectors.sparkSession, count, sums, products, most) if count else None


def identity_error(vectors: DataFrame, model: Whitener) -> float:
    """Largest entry of the whitened vectors' covariance minus the identity, measured on all of them."""
    m, dims, count, sums, weights = len(model.roots), model.dims, model.count, model.sums, model.weights

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((m + 1, m))
        for batch in batches:
            if batch.num_rows:
                w = _deviations(entries(batch, "vector", dims), count, sums)[0] @ weights
                total[:m] += w.T @ w
                total[m] += w.sum(axis=0)
        i, j = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays(
            [pa.array(i.ravel(), pa.int32()), pa.array(j.ravel(), pa.int32()), pa.array(total.ravel())], ["i", "j", "v"]
        )

    rows = usable(vectors).select("vector").mapInArrow(partial, "i int, j int, v double")
    total = np.zeros((m + 1, m))
    for r in rows.groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        total[r.i, r.j] = r.v
    mean = total[m] / count
    return float(np.abs(total[:m] / count - np.outer(mean, mean) - np.eye(m)).max(initial=0.0))


def whiten(vectors: DataFrame, most: int = 32) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error), one row per vector and component.

    ``vectors`` has vec_id and embedding; more columns are ignored.  Vectors that are null or empty, or hold a
    null or non-finite entry or one of 2^56 or more (which has no place in a long), take no part.  A null or
    repeated id stays, a row each.  Vectors must have one length, 256 at most; others raise.  Components with
    a root of zero (constant or dependent entries) can't be whitened and are left out, so equal vectors, a
    single one or none give no rows.  Roots that are equal share a space; any orthonormal basis of it is
    taken.  A deviation beyond a long is null.
    """
    schema = (
        "vec_id {}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    ).format(vectors.schema["vec_id"].dataType.simpleString())
    model = fit(vectors, most)
    if model is None or not model.roots:
        return vectors.sparkSession.createDataFrame([], schema)
    m, dims, count, sums = len(model.roots), model.dims, model.count, model.sums
    weights, explained, error = model.weights, np.array(model.explained), identity_error(vectors, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 2048):
                batch = whole.slice(start, 2048)
                d, squares = _deviations(entries(batch, "vector", dims), count, sums)
                rows = np.repeat(np.arange(len(d)), m)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("vec_id").take(pa.array(rows)),
                        pa.array(np.tile(np.arange(1, m + 1), len(d)), pa.int32()),
                        pa.array(np.full(len(rows), count), pa.int64()),
                        pa.array(squares, pa.int64()).take(pa.array(rows)),
                        pa.array((d @ weights).ravel()),
                        pa.array(np.tile(explained, len(d))),
                        pa.array(np.full(len(rows), error)),
                    ],
                    [f.split()[0] for f in schema.split(", ")],
                )

    return usable(vectors).mapInArrow(run, schema)
