"""Exact integer sums over a table: whole numbers of any size as limbs that Spark adds up."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F

BITS = 30
#: Limbs of a number: it may have 30 * (LIMBS - 1) + 31 bits beside its sign in every partial sum.
LIMBS = 8
NAMES = [f"limb{k}" for k in range(LIMBS)]
SCHEMA = ", ".join(f"{n} long" for n in NAMES)


def split(value: int) -> list[int]:
    """Limbs of a whole number, lowest first; all but the last are in [0, 2^30)."""
    out = []
    for _ in range(LIMBS - 1):
        out.append(value & ((1 << BITS) - 1))
        value >>= BITS
    if abs(value) >= 1 << 31:
        raise OverflowError("a partial sum is too large for its limbs")
    return [*out, value]


def join(limbs: Iterable[int]) -> int:
    return sum(int(v) << (BITS * k) for k, v in enumerate(limbs))


def summed(rows: DataFrame, *keys: str) -> DataFrame:
    """The limbs of the sums by key.  2^32 partial sums fit a long."""
    return rows.groupBy(*keys).agg(*[F.sum(n).alias(n) for n in NAMES])


def finite(x: Column) -> Column:
    """Whether an array has entries and all are finite numbers."""
    good = F.forall(x, lambda c: c.isNotNull() & (F.abs(c.cast("double")) < float("inf")) & ~F.isnan(c.cast("double")))
    return x.isNotNull() & (F.size(x) > 0) & good
