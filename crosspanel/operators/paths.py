"""One row per name with its months in order: recursions along time, vectorised over names and candidates.

A grid of candidates is an axis of arrays inside a task, so the inputs are shuffled once, before anything is
multiplied by the grid.  A path is calendar-bounded, since a name has one row per month at most.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from crosspanel.operators import ranks
from crosspanel.operators.ledger import grow

#: Names that are worked on at a time inside a task.
NAMES = 256
#: Entries of a long vector that one row carries between tasks.
PART = 64


def entity_paths(rows: DataFrame, stats: DataFrame, numbers: Sequence[str], vector: str, optional: Sequence[str] = ()) -> DataFrame:
    """(entity, path): an item has t, ``lift`` (growth of a holding over the month), the numbers and the vector.

    ``rows`` has eom, entity, ret_exc_lead1m and those columns.  A row with a null or NaN in a number or the
    vector, or without a positive lambda_adv, is left out; ``optional`` numbers may be null.
    """
    timed = ranks.attach(rows, stats.select("eom", "t", "growth"), ["eom"], "inner")
    timed = timed.withColumn("lift", grow(F.lit(1.0), F.col("ret_exc_lead1m"), F.col("growth")))
    known = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v)) & (F.col("lambda_adv") > 0)
    for n in (*numbers, "lift"):
        known = known & F.col(n).isNotNull() & ~F.isnan(n)
    item = F.struct(
        F.col("t").cast("int").alias("t"), "lift", *numbers,
        *[F.coalesce(o, F.lit(float("nan"))).alias(o) for o in optional], F.col(vector).alias("vector"),
    )
    return timed.where(known).groupBy("entity").agg(F.array_sort(F.collect_list(item)).alias("path"))


class Block:
    """Dense arrays (name, month) of some names: ``held``, a number by its name, and ``vector``."""

    def __init__(self, batch: pa.RecordBatch, months: int, width: int):
        column = batch.column("path")
        counts = np.diff(np.asarray(column.offsets))
        items = column.flatten()
        at = (np.repeat(np.arange(len(counts)), counts), np.asarray(items.field("t")) - 1)
        shape = (len(counts), months)
        if len(np.unique(at[0] * months + at[1])) < len(at[0]):
            raise ValueError("a name has two rows of one month")
        self.entity = batch.column("entity")
        self.held = np.zeros(shape, bool)
        self.held[at] = True
        self.numbers = {}
        for name in (f.name for f in items.type if f.name not in ("t", "vector")):
            self.numbers[name] = np.zeros(shape)
            self.numbers[name][at] = np.asarray(items.field(name))
        self.vector = np.zeros((*shape, width))
        if width:
            self.vector[at] = np.asarray(items.field("vector").flatten()).reshape(-1, width)

    def __getitem__(self, name: str) -> np.ndarray:
        return self.numbers[name]

    def kept(self, t: int) -> np.ndarray:
        """What a unit held in month t is worth in the next one; zero for a name that isn't there any more."""
        if t + 1 >= self.held.shape[1]:
            return np.zeros(len(self.held))
        return np.where(self.held[:, t] & self.held[:, t + 1], self["lift"][:, t], 0.0)


def blocks(batches: Iterator[pa.RecordBatch], months: int, width: int) -> Iterator[Block]:
    for whole in batches:
        for start in range(0, whole.num_rows, NAMES):
            yield Block(whole.slice(start, NAMES), months, width)


def summed(paths: DataFrame, partial: Callable, shape: tuple[int, ...]) -> np.ndarray:
    """The sum over all tasks of ``partial(batches)``, an array of calendar x grid numbers, on the driver."""
    width = int(np.prod(shape[1:]))
    out = np.zeros((shape[0], width))
    for r in summed_parts(paths, lambda b: partial(b).reshape(shape[0], width)).toLocalIterator():
        out[r.row, r.part * PART : r.part * PART + PART] = r["values"][: width - r.part * PART]
    return out.reshape(shape)


def summed_parts(paths: DataFrame, partial: Callable) -> DataFrame:
    """(row, part, values): sums over all tasks of a matrix, PART entries of a row each; all-zero parts are left out.

    A task sends each part once, and parts are added up with a map-side combine, so what is shuffled grows with
    tasks x matrix and not with the names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = partial(batches)
        if total is None or not total.size:
            return
        height, width = total.shape
        parts = -(-width // PART)
        padded = np.zeros((height, parts * PART))
        padded[:, :width] = total
        padded = padded.reshape(height * parts, PART)
        used = np.flatnonzero(padded.any(axis=1))
        for start in range(0, len(used), 4096):
            at = used[start : start + 4096]
            values = pa.ListArray.from_arrays(pa.array(np.arange(0, len(at) * PART + 1, PART), pa.int32()), pa.array(padded[at].ravel()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(at // parts, pa.int32()), pa.array(at % parts, pa.int32()), values], ["row", "part", "values"]
            )

    rows = paths.mapInArrow(run, "row int, part int, values array<double>")
    entries = F.array(*[F.sum(F.element_at("values", i + 1)) for i in range(PART)])
    return rows.groupBy("row", "part").agg(entries.alias("values"))
