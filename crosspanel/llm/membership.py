"""A Bloom filter of ids, built on the executors and small enough to send to all tasks.

It keeps rows that a semi-join would drop out of that join's shuffle.  The filter has 16 bits for an id
up to ``MOST_BITS`` in all; past that more rows pass, and the join that follows stays exact.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from crosspanel.llm import words as W

MOST_BITS = 28
BLOCK_BITS = 15
HASHES = 3


def _places(ids: np.ndarray, bits: int) -> np.ndarray:
    mixed = [W.mix(ids.astype(np.int64).view(np.uint64) + np.uint64(0x9E37 + i)) for i in range(HASHES)]
    return np.stack([(m >> np.uint64(64 - bits)).astype(np.int64) for m in mixed])


def bloom(ids: DataFrame, column: str) -> np.ndarray:
    """The bits, packed into bytes, of the ids in ``column`` (long, not null)."""
    bits = min(MOST_BITS, max(BLOCK_BITS, math.ceil(math.log2(16 * max(1, ids.count())))))
    size = 1 << BLOCK_BITS

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: dict[int, np.ndarray] = {}
        for batch in batches:
            places = np.unique(_places(np.asarray(batch.column(0)), bits))
            for block in np.unique(places >> BLOCK_BITS):
                own = places[(places >> BLOCK_BITS) == block] & (size - 1)
                blocks.setdefault(int(block), np.zeros(size, bool))[own] = True
        yield packed(blocks)

    def packed(blocks: dict[int, np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(list(blocks), pa.int32()), pa.array([np.packbits(b).tobytes() for b in blocks.values()], pa.binary())],
            ["block", "bits"],
        )

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, found in zip(batch.column("block").to_pylist(), batch.column("bits").to_pylist()):
                own = blocks.setdefault(block, np.zeros(size, bool))
                own |= np.unpackbits(np.frombuffer(found, np.uint8)).astype(bool)
        yield packed(blocks)

    schema = "block int, bits binary"
    rows = ids.select(column).mapInArrow(marked, schema).repartition(16, "block").mapInArrow(joined, schema)
    table = np.zeros((1 << bits) // 8, np.uint8)
    for r in rows.collect():
        table[r.block * size // 8 : (r.block + 1) * size // 8] = np.frombuffer(r.bits, np.uint8)
    return table


def hits(table: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Whether each id may be in the filter."""
    places = _places(ids, int(math.log2(len(table) * 8)))
    return ((table[places >> 3] >> (7 - (places & 7)).astype(np.uint8)) & 1).all(axis=0).astype(bool)


def maybe_in(df: DataFrame, column: str, table: np.ndarray) -> DataFrame:
    """The rows of ``df`` whose ``column`` may be among the ids; nulls are not."""
    def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(column)
            hit = hits(table, np.asarray(ids.fill_null(0))) & np.asarray(ids.is_valid())
            yield batch.filter(pa.array(hit))

    return df.mapInArrow(passed, df.schema)
