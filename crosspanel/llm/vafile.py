"""Exact top-k by inner product with vector-approximation files.

Queries and candidates meet block by block: each block of queries is sent to each block of candidates
under an equal key, so no side is broadcast and no group is larger than two blocks.  Inside a block the
candidates' components are quantised to one byte; the cells give an upper and a lower bound for every
inner product.  Exact vectors are read in order of falling upper bound until the k-th best exact score
is at least the next bound.  The blocks' winners are then merged.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

RESULT = "query_id long, vec_id long, score long"
CELLS = 256


def quantise(exact: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cells (uint8), the first cell's lower edge and the cell width, by component."""
    low, high = exact.min(axis=0).astype(float), exact.max(axis=0).astype(float)
    width = np.maximum((high - low) / CELLS, 1e-9)
    return np.minimum((exact - low) / width, CELLS - 1).astype(np.uint8), low, width


def search_block(qid: np.ndarray, q: np.ndarray, vid: np.ndarray, v: np.ndarray, k: int):
    """(query position, candidate position, score) of each query's k best candidates with another id."""
    cells, low, width = quantise(v)
    centres = low + (cells + 0.5) * width
    peak = float(np.abs(q).max(initial=0)) * float(np.abs(v).max(initial=0)) * max(1, v.shape[1])
    wide = peak >= 2.0**62
    exact_q, exact_v = (q.astype(object), v.astype(object)) if wide else (q, v)
    middle = q.astype(float) @ centres.T
    # Half a cell by component, and room for the rounding of the floating sums.
    slack = 0.5 * np.abs(q).astype(float) @ width + 1e-9 * peak + 1.0
    for i in range(len(qid)):
        upper = middle[i] + slack[i]
        upper[vid == qid[i]] = -np.inf
        left = np.flatnonzero(upper > -np.inf)
        if len(left) > k:
            # No candidate under the k-th best lower bound can be among the first k.
            kth = np.partition(upper[left], len(left) - k)[len(left) - k] - 2 * slack[i]
            left = left[upper[left] >= kth]
        left = left[np.argsort(-upper[left], kind="stable")]
        found_at, found = np.empty(0, int), exact_q[:0, 0]
        for start in range(0, len(left), 64):
            at = left[start : start + 64]
            if len(found) >= k and np.sort(found)[-k] > upper[at[0]]:
                break
            found_at = np.concatenate([found_at, at])
            found = np.concatenate([found, exact_v[at] @ exact_q[i]])
        best = sorted(range(len(found_at)), key=lambda j: (-int(found[j]), int(vid[found_at[j]])))[:k]
        for j in best:
            yield i, found_at[j], int(found[j])


def _matrix(table: pa.Table, dims: int) -> tuple[np.ndarray, np.ndarray]:
    flat = np.concatenate([
        np.asarray(c.flatten().cast(pa.float64())) for c in table.column("vector").chunks
    ] or [np.empty(0)])
    scaled = np.floor(1024.0 * flat)
    if len(scaled) and np.abs(scaled).max() >= 2.0**62:
        raise OverflowError("a component times 1024 does not fit a long")
    return np.asarray(table.column("vec_id")), scaled.astype(np.int64).reshape(-1, dims)


def top_k(
    queries: DataFrame, candidates: DataFrame, k: int = 10, block: int = 8192
) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``k`` highest integer inner products.

    Both inputs have vec_id and embedding; more columns are ignored.  A component counts as
    ``floor(1024 * x)``.  Vectors that are null or empty, or hold a null or non-finite component, and rows
    without an id, take no part; a query meets only candidates of its own dimension, and none with its own
    id.  A query id given more than once is one query (the smallest vector).  A repeated candidate row is a
    candidate each time.  Ties go to the smaller id.  Empty tables give no rows.
    """
    def usable(df: DataFrame) -> DataFrame:
        x = F.col("embedding")
        good = F.forall(x, lambda c: c.isNotNull() & (F.abs(c.cast("double")) < float("inf")) & ~F.isnan(c.cast("double")))
        return df.where(F.col("vec_id").isNotNull() & x.isNotNull() & (F.size(x) > 0) & good).select(
            F.col("vec_id").cast("long"), x.cast("array<double>").alias("vector"), F.size(x).alias("dims")
        )

    asked = usable(queries).groupBy("vec_id").agg(F.min("vector").alias("vector")).withColumn("dims", F.size("vector"))
    rows = usable(candidates)
    chunks = max(1, math.ceil(queries.count() / block))
    buckets = max(1, math.ceil(candidates.count() / block))
    # Each pair of a query block and a candidate block is one group.
    left = asked.withColumn("chunk", F.pmod(F.xxhash64("vec_id"), F.lit(chunks)).cast("int")).withColumn(
        "bucket", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1)))
    )
    right = rows.withColumn(
        "bucket", F.pmod(F.monotonically_increasing_id(), F.lit(buckets)).cast("int")
    ).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    keys = ["chunk", "bucket", "dims"]

    def search(key, asked: pa.Table, rows: pa.Table) -> pa.Table:
        out: tuple[list, list, list] = ([], [], [])
        if asked.num_rows and rows.num_rows:
            dims = key[2].as_py()
            qid, q = _matrix(asked, dims)
            vid, v = _matrix(rows, dims)
            for at in range(0, len(qid), 256):
                for i, j, score in search_block(qid[at : at + 256], q[at : at + 256], vid, v, k):
                    for column, value in zip(out, (qid[at + i], vid[j], score)):
                        column.append(value)
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("query_id", "vec_id", "score"), out)})

    best = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(search, RESULT)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
