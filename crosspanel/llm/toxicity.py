"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A bounded sample of labelled rows, chosen by a hash of the id, trains in one task, with a learning rate
per coordinate and L1 sparsity; the few weights that stay are sent to all tasks, which score whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from crosspanel.llm import words as W
from crosspanel.llm.base import crc_fold, released

#: Labelled rows that training reads at most, and the feature space: bounds of the training task and of the model.
SAMPLE = 16384
BITS = 20
SHAPES = ((0,), (0, 1), (0, 2))
EPOCHS, ALPHA, BETA, L1, L2 = 5, 0.5, 1.0, 12.0, 0.1
THRESHOLD = 0.3


def buckets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, row) of every word, word pair and pair with one word between."""
    hashes, row = W.words(data, offsets, W.MARKS)
    found = [W.grams(hashes, row, shape) for shape in SHAPES]
    keys = np.concatenate([k for k, _ in found]) >> np.uint64(64 - BITS)
    return keys.astype(np.int64), np.concatenate([r for _, r in found])


def feature_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, label and the row's distinct buckets as little-endian 32-bit integers."""
    for batch in batches:
        packed: list[bytes] = []
        for at, end, data, offsets in W.text_slices(batch.column("text")):
            keys, ends = W.row_sets(*buckets(data, offsets), end - at)
            keys = keys.astype("<u4")
            packed += [keys[ends[i] : ends[i + 1]].tobytes() for i in range(end - at)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("label"), pa.array(packed, pa.binary())], ["doc_id", "label", "features"]
        )


def ftrl(rows: list[tuple[int, np.ndarray]]) -> tuple[np.ndarray, float]:
    """Weights by bucket and the bias, from (label, distinct buckets) in the given order."""
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
    bias = bias_n = 0.0
    for _ in range(EPOCHS):
        for label, at in rows:
            za, na = z[at], n[at]
            root = np.sqrt(na)
            w = np.where(np.abs(za) > L1, (np.sign(za) * L1 - za) / ((BETA + root) / ALPHA + L2), 0.0)
            g = 1.0 / (1.0 + np.exp(-np.clip(w.sum() + bias, -35, 35))) - label
            z[at] = za + g - (np.sqrt(na + g * g) - root) / ALPHA * w
            n[at] = na + g * g
            bias_n += g * g
            bias -= ALPHA * g / (BETA + np.sqrt(bias_n))
    weights = np.where(np.abs(z) > L1, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2), 0.0)
    return weights, bias


def train_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = [
        (int(label), np.frombuffer(packed, "<u4"))
        for batch in released(batches)
        for label, packed in zip(batch.column("label").to_pylist(), batch.column("features").to_pylist())
    ]
    weights, bias = ftrl(rows)
    at = np.flatnonzero(weights)
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.append(at, -1), pa.int64()), pa.array(np.append(weights[at], bias))], ["bucket", "weight"]
    )


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> list[tuple[int, float]]:
    """(bucket, weight) of the weights that aren't zero; bucket -1 is the bias.

    ``docs`` has doc_id and text, ``labels`` doc_id and label (0 or 1); rows without an id or a label are left
    out, an id with several labels counts as its highest, and copies of one id train once.  Without labelled
    rows all there is is a bias of zero.
    """
    chosen = (
        labels.where(F.col("doc_id").isNotNull() & F.col("label").isNotNull())
        .groupBy("doc_id").agg(F.max("label").cast("int").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    )
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "label", "text")
    features = rows.mapInArrow(feature_batches, "doc_id long, label int, features binary")
    features = features.groupBy("doc_id", "label").agg(F.min("features").alias("features"))
    one = features.repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id")
    return [tuple(r) for r in one.mapInArrow(train_batches, "bucket long, weight double").collect()]


def score(docs: DataFrame, model: list[tuple[int, float]], output: str = "score") -> DataFrame:
    """``docs`` with ``output``: the probability of label 1 for the whole text; a null text scores as an empty one.

    ``output`` must not be a column of ``docs``; all its columns are kept as they are.
    """
    if output in docs.columns:
        raise ValueError(f"column {output} is there already")
    weights = np.zeros(1 << BITS)
    bias = 0.0
    for bucket, weight in model:
        if bucket < 0:
            bias = weight
        else:
            weights[bucket] = weight
    used = np.flatnonzero(weights)
    sparse = (used.astype(np.int32), weights[used])

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense = np.zeros(1 << BITS)
        dense[sparse[0]] = sparse[1]
        kept = dense != 0
        for batch in released(found):
            logits = np.full(batch.num_rows, bias)
            for at, end, data, offsets in W.text_slices(batch.column("text")):
                keys, row = buckets(data, offsets)
                hit = kept[keys]
                keys, ends = W.row_sets(keys[hit], row[hit], end - at)
                logits[at:end] += np.bincount(np.repeat(np.arange(end - at), np.diff(ends)), dense[keys], end - at)
            value = 1.0 / (1.0 + np.exp(-np.clip(logits, -35, 35)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(value)], [*batch.schema.names, output])

    return docs.mapInArrow(batches, T.StructType([*docs.schema.fields, T.StructField(output, T.DoubleType())]))


def learnable(labels: DataFrame, column: str, folds: int, held: int) -> DataFrame:
    """doc_id and label of the rows that aren't held out."""
    return labels.where(crc_fold(F.col("doc_id"), folds) != held).select("doc_id", F.col(column).alias("label"))
