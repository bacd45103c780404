"""Text quality by positive-unlabelled learning.

Trusted positives and unlabelled web text train a logistic model of surface features.  The class prior of
the unlabelled text is estimated from the model that tells the two samples apart, and the final model
minimises the non-negative unbiased risk.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from crosspanel.llm import words as W

#: Rows of either sample at most: the bound of the training task.
SAMPLE = 8192
THRESHOLD = 0.3
CLASSES = 8
_CLASS = np.full(256, 6)
_CLASS[128:] = 7
_CLASS[list(b".,;:?'\"()-")] = 5
_CLASS[0x0A] = 4
_CLASS[[0x20, 0x09, 0x0D]] = 3
_CLASS[48:58] = 2
_CLASS[65:91] = 1
_CLASS[97:123] = 0
WIDTH = CLASSES**3 + 8


def _repeated(keys: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """The share of each row's keys that are repeats."""
    _, ends = W.row_sets(keys, row, rows)
    count = np.bincount(row, minlength=rows)
    return 1.0 - np.diff(ends) / np.maximum(count, 1) * (count > 0) - (count == 0)


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of surface features per text: shares of character-class trigrams, repeats, word lengths."""
    rows = len(offsets) - 1
    out = np.zeros((rows, WIDTH), np.float32)
    sizes = np.diff(offsets)
    kind = _CLASS[data]
    if len(data) > 2:
        code = (kind[:-2] * CLASSES + kind[1:-1]) * CLASSES + kind[2:]
        row = np.repeat(np.arange(rows), sizes)
        inside = row[:-2] == row[2:]
        counts = np.bincount(row[:-2][inside] * CLASSES**3 + code[inside], minlength=rows * CLASSES**3)
        out[:, : CLASSES**3] = np.sqrt(counts.reshape(rows, -1) / np.maximum(sizes, 1)[:, None])
    starts, ends, row = W.spans(data, offsets, W.SPACE)
    hashes = W.span_hashes(W.byte_values(data), starts, ends)
    count = np.maximum(np.bincount(row, minlength=rows), 1)
    length = np.bincount(row, ends - starts, rows) / count
    spread = np.sqrt(np.maximum(np.bincount(row, (ends - starts.astype(float)) ** 2, rows) / count - length**2, 0))
    line_from, line_to, line_row = W.spans(data, offsets, W.LINE_END)
    lines = W.span_hashes(W.byte_values(data), line_from, line_to)
    extra = (
        _repeated(hashes, row, rows), _repeated(*W.grams(hashes, row, (0, 1, 2)), rows), _repeated(lines, line_row, rows),
        np.log1p(length), np.log1p(spread), np.log1p(np.bincount(row, minlength=rows)) / 5,
        np.log1p(np.bincount(line_row, minlength=rows)) / 5, np.ones(rows),
    )
    for i, column in enumerate(extra):
        out[:, CLASSES**3 + i] = column
    return out


def feature_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        packed: list[bytes] = []
        for _, _, data, offsets in W.text_slices(batch.column("text")):
            packed += [x.tobytes() for x in features(data, offsets)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("trusted"), pa.array(packed, pa.binary())],
            ["doc_id", "trusted", "features"],
        )


def _fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float | None, steps: int = 400) -> np.ndarray:
    """Adam on the logistic risk; without a prior, of telling the samples apart, else the non-negative one."""
    w = np.zeros(positive.shape[1])
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, steps + 1):
        sp, su = (1 / (1 + np.exp(-np.clip(x @ w, -35, 35))) for x in (positive, unlabelled))
        if prior is None:
            g = positive.T @ (sp - 1) / len(sp) + unlabelled.T @ su / len(su)
        else:
            # Of -log(1 - s): the unlabelled risk as negatives less the positives' part in it.
            negative = np.mean(-np.log1p(-np.minimum(su, 1 - 1e-12))) - prior * np.mean(
                -np.log1p(-np.minimum(sp, 1 - 1e-12))
            )
            as_negative = unlabelled.T @ su / len(su) - prior * (positive.T @ sp) / len(sp)
            g = prior * (positive.T @ (sp - 1)) / len(sp) + as_negative if negative >= 0 else -as_negative
        g = g + 1e-4 * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The share of positives in the unlabelled sample, from scores that tell the two samples apart.

    Over every top-scoring region, unlabelled mass over positive mass bounds the share from above; the
    lowest bound with an allowance for sampling is taken.
    """
    cuts = np.sort(positive)[::-1]
    share_p = np.arange(1, len(cuts) + 1) / len(cuts)
    share_u = (len(unlabelled) - np.searchsorted(np.sort(unlabelled), cuts, "left")) / len(unlabelled)
    allowance = np.sqrt(np.log(4 / 0.1) / (2 * len(cuts))) + np.sqrt(np.log(4 / 0.1) / (2 * len(unlabelled)))
    best = int(np.argmin((share_u + allowance) / share_p))
    return float(np.clip(share_u[best] / share_p[best], 0.02, 0.98))


def fit(positive: np.ndarray, unlabelled: np.ndarray) -> np.ndarray:
    """Weights over raw features; the last feature is the constant."""
    both = np.concatenate([positive, unlabelled])
    mean, sd = both.mean(axis=0), both.std(axis=0)
    used = sd > 1e-6
    mean[~used], sd[~used] = 0, 1
    used[-1] = True
    scaled = [((x - mean) / sd * used).astype(np.float64) for x in (positive, unlabelled)]
    # Half of either sample fits the model that the prior is read from, the other half gives its scores.
    half = _fit(scaled[0][::2], scaled[1][::2], None)
    prior = estimate_prior(scaled[0][1::2] @ half, scaled[1][1::2] @ half)
    w = _fit(*scaled, prior) / sd * used
    w[-1] -= w[:-1] @ mean[:-1]
    return np.append(w, prior)


def train_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    samples: dict[bool, list[np.ndarray]] = {True: [], False: []}
    for batch in batches:
        for trusted, packed in zip(batch.column("trusted").to_pylist(), batch.column("features").to_pylist()):
            samples[trusted].append(np.frombuffer(packed, np.float32))
    if len(samples[True]) > 1 and len(samples[False]) > 1:
        weights = fit(np.array(samples[True]), np.array(samples[False]))
    else:
        weights = np.zeros(WIDTH + 1)
    yield pa.RecordBatch.from_arrays([pa.array(weights)], ["weight"])


def train(docs: DataFrame, trusted: DataFrame, labelled: DataFrame, sample: int = SAMPLE) -> list[float]:
    """Weights by feature, then the estimated prior.

    ``trusted`` has the ids of positives, ``labelled`` all labelled ids: ``docs`` (doc_id, text) without a label
    are the unlabelled text.  Rows without an id train nothing.  Without one of the two samples all weights are
    zero, and every score is a half.
    """
    def chosen(ids: DataFrame, flag: bool) -> DataFrame:
        return ids.where(F.col("doc_id").isNotNull()).select("doc_id").distinct().orderBy(
            F.xxhash64("doc_id"), "doc_id"
        ).limit(sample).withColumn("trusted", F.lit(flag))

    unlabelled = docs.select("doc_id").join(labelled.select("doc_id"), "doc_id", "left_anti")
    ids = chosen(trusted.join(docs.select("doc_id"), "doc_id", "left_semi"), True).unionByName(chosen(unlabelled, False))
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("doc_id", "trusted", "text")
    packed = rows.mapInArrow(feature_batches, "doc_id long, trusted boolean, features binary")
    packed = packed.groupBy("doc_id", "trusted").agg(F.min("features").alias("features"))
    one = packed.repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id")
    return [r.weight for r in one.mapInArrow(train_batches, "weight double").collect()]


def score(docs: DataFrame, model: list[float], output: str = "score") -> DataFrame:
    """``docs`` with ``output``: the probability that the whole text is of the positive kind; null counts as empty.

    ``output`` must not be a column of ``docs``; all its columns are kept as they are.
    """
    if output in docs.columns:
        raise ValueError(f"column {output} is there already")
    weights = np.array(model[:WIDTH])

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            logits = np.zeros(batch.num_rows)
            for at, end, data, offsets in W.text_slices(batch.column("text")):
                logits[at:end] = features(data, offsets) @ weights
            value = 1.0 / (1.0 + np.exp(-np.clip(logits, -35, 35)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(value)], [*batch.schema.names, output])

    return docs.mapInArrow(batches, T.StructType([*docs.schema.fields, T.StructField(output, T.DoubleType())]))
