"""Language by rank-order profiles of character n-grams.

A profile is the ranking of a language's most frequent 1- to 3-grams of letters, counted over all texts
that may be learnt from.  A text's own ranking is compared with each profile by the out-of-place distance,
and the nearest language is taken.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from crosspanel.llm import words as W

#: Length of every profile, and the most languages a model may have; together the bound of the broadcast model.
PROFILE = 400
MOST_LANGUAGES = 2000
UNKNOWN = "und"


@cache
def _letters() -> np.ndarray:
    """For each code point its lower-case form if it is a letter or a mark of one, else 0."""
    out = np.zeros(0x110000, np.uint32)
    for code in range(0x110000):
        if 0xD800 <= code < 0xE000:
            continue
        char = chr(code)
        if char.isalpha() or unicodedata.category(char)[0] == "M":
            low = char.lower()
            out[code] = ord(low) if len(low) == 1 else code
    return out


def codes(text_bytes: np.ndarray) -> np.ndarray:
    """Lower-case letters of one text; every run of anything else is one 0, and so are both ends."""
    points = np.frombuffer(text_bytes.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    low = np.zeros(len(points) + 2, np.uint32)
    low[1:-1] = _letters()[points]
    keep = np.ones(len(low), bool)
    keep[1:] = (low[1:] != 0) | (low[:-1] != 0)
    return low[keep]


def gram_counts(low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams (three code points packed into 63 bits) and how often each occurs.

    An n-gram may begin or end with a word's edge, and holds no edge inside.
    """
    wide = low.astype(np.uint64)
    one = wide[wide != 0]
    two = (wide[:-1] << np.uint64(21) | wide[1:])[(low[:-1] != 0) | (low[1:] != 0)]
    three = (wide[:-2] << np.uint64(42) | wide[1:-1] << np.uint64(21) | wide[2:])[low[1:-1] != 0]
    grams = np.concatenate([one, two + np.uint64(1 << 63), three]) if len(low) > 2 else one
    return np.unique(grams, return_counts=True)


def top_grams(grams: np.ndarray, counts: np.ndarray, length: int) -> np.ndarray:
    """The most frequent n-grams, ties by code."""
    if len(grams) > length:
        least = np.partition(counts, len(counts) - length)[len(counts) - length]
        keep = counts >= least
        grams, counts = grams[keep], counts[keep]
    return grams[np.lexsort((grams, -counts))][:length]


def _texts(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    data, offsets = W.utf8(column)
    for i in range(len(offsets) - 1):
        yield i, codes(data[offsets[i] : offsets[i + 1]])


def count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, gram, n): a partition's counts, given out whenever they pass a million entries."""
    held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
    size = 0

    def merged(parts: list) -> tuple[np.ndarray, np.ndarray]:
        grams, at = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
        return grams, np.bincount(at, np.concatenate([c for _, c in parts])).astype(np.int64)

    def given() -> Iterator[pa.RecordBatch]:
        for lang, parts in held.items():
            grams, counts = merged(parts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(grams), pa.string()), pa.array(grams.view(np.int64)), pa.array(counts)],
                ["lang", "gram", "n"],
            )

    for batch in batches:
        langs = batch.column("lang").to_pylist()
        for i, low in _texts(batch.column("text")):
            if len(low) > 1:
                found = gram_counts(low)
                held.setdefault(langs[i], []).append(found)
                size += len(found[0])
        if size > 1_000_000:
            held = {lang: [merged(parts)] for lang, parts in held.items()}
            size = sum(len(parts[0][0]) for parts in held.values())
            if size > 1_000_000:
                yield from given()
                held, size = {}, 0
    yield from given()


def train(docs: DataFrame, length: int = PROFILE) -> dict[str, list[int]]:
    """The ranked n-grams of each language, from ``docs`` (text, lang); rows without a language teach nothing.

    Counts cover all rows.  They are summed by language and n-gram, and cut to the most frequent first
    inside salted parts of a language, then over them, so that no task gets all n-grams of one.
    """
    known = docs.where(F.col("lang").isNotNull()).select("text", "lang")
    counts = known.mapInArrow(count_batches, "lang string, gram long, n long")
    counts = counts.groupBy("lang", "gram").agg(F.sum("n").alias("n")).withColumn("salt", F.pmod(F.xxhash64("gram"), F.lit(64)))
    best = [F.desc("n"), "gram"]
    for keys in (["lang", "salt"], ["lang"]):
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*best))
        counts = counts.withColumn("rank", rank).where(F.col("rank") <= length)
    rows = counts.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("rank", "gram"))).alias("p"))
    rows = rows.limit(MOST_LANGUAGES + 1).collect()
    if len(rows) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    return {r.lang: [x.gram for x in r.p] for r in sorted(rows, key=lambda r: r.lang)}


def predict(docs: DataFrame, model: dict[str, list[int]], length: int = PROFILE) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``.

    ``lang_pred`` is the language of the nearest profile (ties by name), ``und`` where the text is null or has no
    letter, or nothing was learnt.  ``score`` is 0 for ``und``, else one minus the distance over the largest possible.
    The two must not be columns of ``docs``; all its columns are kept as they are.
    """
    if {"lang_pred", "score"} & set(docs.columns):
        raise ValueError("lang_pred or score is a column already")
    names = list(model)
    known = np.unique(np.concatenate([np.array(model[n], np.int64) for n in names] or [np.empty(0, np.int64)]).view(np.uint64))
    # ranks[g, l]: the place of n-gram g in the profile of l; what isn't there costs the full length.
    ranks = np.full((len(known) + 1, len(names)), -1, np.int32)
    for l, name in enumerate(names):
        grams = np.array(model[name], np.int64).view(np.uint64)
        ranks[np.searchsorted(known, grams), l] = np.arange(len(grams))

    def nearest(low: np.ndarray) -> tuple[str, float]:
        if not names or not low.any():
            return UNKNOWN, 0.0
        own = top_grams(*gram_counts(low), length)
        at = np.searchsorted(known, own)
        at[(at == len(known)) | (known[np.minimum(at, len(known) - 1)] != own)] = len(known)
        theirs = ranks[at]
        away = np.where(theirs < 0, length, np.abs(theirs - np.arange(len(own))[:, None])).sum(axis=0)
        best = int(np.argmin(away))
        return names[best], 1.0 - float(away[best]) / (length * len(own))

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            answers = [nearest(low) for _, low in _texts(batch.column("text"))]
            columns = [pa.array([a for a, _ in answers], pa.string()), pa.array([s for _, s in answers], pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, "lang_pred", "score"])

    extra = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    return docs.mapInArrow(batches, T.StructType([*docs.schema.fields, *extra]))
