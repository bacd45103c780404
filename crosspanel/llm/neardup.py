"""MinHash near-duplicates by a multi-index Hamming join.

Texts with the same shingle set are one class.  A class has a signature of 16-bit MinHash values, cut into
chunks.  By the pigeonhole principle two signatures that differ in at most ``2 * chunks - 1`` values have a
chunk with one error at most; every chunk is therefore indexed once for each place that the error may
have, and such a pair shares a key.  The number of chunks follows from the similarity: a pair that has just
that similarity shares no key with a chance of under 1e-6.

Classes that share a key with a smaller one meet in the cell of the smallest, in blocks of bounded size, with
their full shingle sets, and only links that keep a cell connected leave it.  No pair is written that isn't
a link.  Components come from large-star and small-star rounds over the links.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from crosspanel.llm import words as W
from crosspanel.llm.base import released, written
from crosspanel.llm.membership import bloom, maybe_in

CHUNK = 5
MISS = 1e-6
#: Shingles and classes that one block of a cell holds at most, about.
BLOCK_SHINGLES = 1_500_000
BLOCK_CLASSES = 2048
ID_BITS = 48  # of a shingle's hash that are compared
_SEEDS = np.random.default_rng(77).integers(1, 1 << 63, 1024, np.uint64)


def chunks_for(similarity: float) -> int:
    """Chunks that leave a pair of this similarity unindexed with a chance of under ``MISS``."""
    found = similarity**CHUNK + CHUNK * (1 - similarity) * similarity ** (CHUNK - 1)
    return max(1, math.ceil(math.log(MISS) / math.log(1 - found)))


def most_errors(values: int, similarity: float) -> int:
    """Signature distance that a pair of this similarity stays within, but for a chance of under ``MISS``."""
    tail, errors = 1.0, -1
    while tail >= MISS:
        errors += 1
        tail -= math.comb(values, errors) * (1 - similarity) ** errors * similarity ** (values - errors)
    return errors


def shingles(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of every run of ``width`` words; a row with fewer words has them all as one."""
    hashes, row = W.words(data, offsets)
    rows = len(offsets) - 1
    found, at = W.grams(hashes, row, tuple(range(width)))
    count = np.bincount(row, minlength=rows)
    parts, places = [found], [at]
    for size in range(1, width):
        short = np.flatnonzero(count == size)
        if len(short):
            first = np.searchsorted(row, short)
            own = np.concatenate([hashes[f : f + size] for f in first])
            parts.append(W.grams(own, np.repeat(short, size), tuple(range(size)))[0] + np.uint64(size))
            places.append(short)
    return np.concatenate(parts), np.concatenate(places)


def text_sets(column: pa.Array, width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Slice by slice, the distinct shingles of the rows and the rows' offsets into them."""
    for at, end, data, offsets in W.text_slices(column):
        yield W.row_sets(*shingles(data, offsets, width), end - at)


def signatures(keys: np.ndarray, ends: np.ndarray, values: int) -> np.ndarray:
    """16 bits of each row's minimum under ``values`` hash functions; empty rows get zeros."""
    out = np.zeros((len(ends) - 1, values), np.uint16)
    some = np.flatnonzero(np.diff(ends))
    if len(some):
        for p in range(values):
            least = np.minimum.reduceat(keys * (_SEEDS[2 * p] | np.uint64(1)) ^ _SEEDS[2 * p + 1], ends[some])
            out[some, p] = (W.mix(least) & np.uint64(0xFFFF)).astype(np.uint16)
    return out


def sketch_batches(batches: Iterator[pa.RecordBatch], width: int, values: int) -> Iterator[pa.RecordBatch]:
    for batch in released(batches):
        n, one, two, packed = [], [], [], []
        for keys, ends in text_sets(batch.column("text"), width):
            n.append(np.diff(ends))
            for digest, salt in ((one, 0xA5A5), (two, 0x5A5A5A)):
                sums = np.zeros(len(keys) + 1, np.uint64)
                np.cumsum(W.mix(keys + np.uint64(salt)), out=sums[1:])
                digest.append((sums[ends[1:]] - sums[ends[:-1]]).view(np.int64))
            packed += [x.tobytes() for x in signatures(keys, ends, values)]
        whole = [np.concatenate(x) if x else np.empty(0, np.int64) for x in (n, one, two)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *(pa.array(x) for x in whole), pa.array(packed, pa.binary())],
            ["doc_id", "n_shingles", "one", "two", "signature"],
        )


def key_batches(batches: Iterator[pa.RecordBatch], chunks: int) -> Iterator[pa.RecordBatch]:
    """(key, rep): for every chunk and every place of an error, a key of the other values."""
    for batch in released(batches):
        if not batch.num_rows:
            continue
        values = np.frombuffer(b"".join(batch.column("signature").to_pylist()), np.uint16)
        values = values.reshape(batch.num_rows, chunks * CHUNK).astype(np.uint64)
        keys = np.empty((batch.num_rows, chunks * CHUNK), np.uint64)
        for chunk in range(chunks):
            for gap in range(CHUNK):
                key = np.full(batch.num_rows, chunk * CHUNK + gap, np.uint64)
                for place in range(CHUNK):
                    if place != gap:
                        key = W.mix(key + np.uint64(0x632BE59BD9B4E019)) ^ values[:, chunk * CHUNK + place]
                keys[:, chunk * CHUNK + gap] = W.mix(key)
        ids = np.asarray(batch.column("rep"))
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys.reshape(-1).view(np.int64)), pa.array(np.repeat(ids, chunks * CHUNK))], ["key", "rep"]
        )


def set_batches(batches: Iterator[pa.RecordBatch], width: int, values: int) -> Iterator[pa.RecordBatch]:
    """rep, its signature, and its shingles as sorted integers of ``ID_BITS`` bits."""
    for batch in released(batches):
        sets, signs = [], []
        for keys, ends in text_sets(batch.column("text"), width):
            signs += [x.tobytes() for x in signatures(keys, ends, values)]
            cut = (keys >> np.uint64(64 - ID_BITS)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, : ID_BITS // 8]
            cut = np.ascontiguousarray(cut)
            sets += [cut[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:])]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(sets, pa.binary()), pa.array(signs, pa.binary())],
            ["rep", "shingles", "signature"],
        )


def _unpack(packed: bytes) -> np.ndarray:
    raw = np.frombuffer(packed, np.uint8).reshape(-1, ID_BITS // 8)
    wide = np.zeros((len(raw), 8), np.uint8)
    wide[:, : ID_BITS // 8] = raw
    return wide.view("<u8").ravel()


class Forest:
    def __init__(self, size: int) -> None:
        self.up = np.arange(size)

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return int(i)

    def roots(self) -> np.ndarray:
        while True:
            above = self.up[self.up]
            if (above == self.up).all():
                return self.up
            self.up = above


def cell_links(
    ids: np.ndarray, block: np.ndarray, sets: list[np.ndarray], signs: np.ndarray, percent: int, errors: int
) -> list[tuple[int, int]]:
    """Links (larger id, smaller id) that connect what is similar among the members.

    With more than one block only members of different blocks are compared.
    """
    size = len(ids)
    counts = np.array([len(s) for s in sets])
    tokens, at = np.unique(np.concatenate(sets), return_inverse=True)
    shared = np.bincount(at)[at] > 1
    row = np.repeat(np.arange(size), counts)[shared]
    at = at[shared]
    starts = np.searchsorted(row, np.arange(size))
    full = starts < np.searchsorted(row, np.arange(size), "right")
    forest, marked = Forest(size), np.zeros(len(tokens), bool)
    two = block.min() != block.max()
    for i in range(size - 1):
        later = np.arange(i + 1, size)
        near = (100 * np.minimum(counts[later], counts[i]) >= percent * np.maximum(counts[later], counts[i]))
        near &= (signs[later] != signs[i]).sum(axis=1) <= errors
        if two:
            near &= block[later] != block[i]
        later = later[near]
        if not len(later) or not full[i]:
            continue
        roots = forest.roots()
        later = later[(roots[later] != roots[i]) & full[later]]
        if not len(later):
            continue
        own = at[starts[i] : (starts[i + 1] if i + 1 < size else len(at))]
        marked[own] = True
        if 4 * len(later) < size:
            both = np.array([marked[at[starts[j] : (starts[j + 1] if j + 1 < size else len(at))]].sum() for j in later])
        else:
            sums = np.concatenate([[0], np.cumsum(marked[at])])
            ends = np.append(starts[1:], len(at))
            both = (sums[ends] - sums[starts])[later]
        marked[own] = False
        for j in later[100 * both >= percent * (counts[later] + counts[i] - both)]:
            a, b = forest.root(i), forest.root(int(j))
            if a != b:
                forest.up[max(a, b)] = min(a, b)
    roots = forest.roots()
    return [(int(ids[i]), int(ids[r])) for i, r in enumerate(roots) if ids[i] != ids[r]]


def components(links: DataFrame) -> DataFrame:
    """(node, component) of links (a, b): the smallest node reachable.  Nodes without a link aren't listed.

    Large-star and small-star rounds: each links the neighbours of a node to its smallest one, until every
    node is linked to its component's smallest only.  Minima are aggregated before rows are joined to them.
    """
    def star(edges: DataFrame, large: bool) -> DataFrame:
        pairs = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else (
            edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        )
        least = pairs.groupBy("a").agg(F.min("b").alias("least")).withColumn("least", F.least("a", "least"))
        joined = pairs.join(least, "a")
        if large:
            out = joined.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("least").alias("b"))
        else:
            out = joined.select(F.col("b").alias("a"), F.col("least").alias("b")).union(
                least.select("a", F.col("least").alias("b"))
            )
        return out.where(F.col("a") != F.col("b")).distinct()

    edges = written(links.where(F.col("a") != F.col("b")).select("a", "b").distinct(), "links")
    before = None
    while True:
        edges = written(star(star(edges, True), False), "edges")
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a"))).first()
        if now == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
                edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
            )
        before = now


def near_duplicates(docs: DataFrame, width: int, percent: int, among: DataFrame | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id and kept, one row per row of ``docs`` (doc_id, text; more are ignored).

    Texts are linked when ``100 * shared >= percent * united`` of their ``width``-word shingles, confirmed
    on the full sets.  A component's id is its smallest doc_id; ``kept`` marks that document.  A null text, or one
    without words, has no shingles and links with nothing.  Repeated rows are linked, and each is kept or
    not as its id is.  Different texts under one id are taken as one document.  A row without an id is kept, with
    a null component.  An empty table gives no rows.  With ``among`` (doc_id) only rows of these ids take part and
    are returned; they are chosen by their sketches, so no text is shuffled for it.
    """
    similarity = percent / 100
    chunks = chunks_for(similarity)
    values = chunks * CHUNK
    errors = max(2 * chunks - 1, most_errors(values, similarity))
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    sketch = docs.mapInArrow(
        lambda b: sketch_batches(b, width, values),
        "doc_id long, n_shingles long, one long, two long, signature binary",
    )
    if among is not None:
        sketch = sketch.join(among.select(F.col("doc_id").cast("long")).distinct(), "doc_id", "left_semi")
    sketch = written(sketch, "sketch")
    same = ["one", "two", "n_shingles"]
    usable = sketch.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    classes = written(
        usable.groupBy(*same).agg(F.min("doc_id").alias("rep"), F.min("signature").alias("signature")), "classes"
    )
    keys = classes.select("rep", "signature").mapInArrow(lambda b: key_batches(b, chunks), "key long, rep long")
    shared = keys.groupBy("key").agg(F.min("rep").alias("cell"), F.count(F.lit(1)).alias("n")).where("n > 1")
    members = written(keys.join(shared.select("key", "cell"), "key").select("cell", "rep").distinct(), "members")
    weights = members.join(classes.select("rep", "n_shingles"), "rep").groupBy("cell").agg(
        F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("total")
    )
    blocks = F.greatest(F.ceil(F.col("total") / BLOCK_SHINGLES), F.ceil(F.col("n") / BLOCK_CLASSES)).cast("int")
    sized = members.join(weights.select("cell", blocks.alias("blocks")), "cell")
    own = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    sized = sized.select("cell", "rep", own.alias("block"), other.alias("other")).select(
        "cell", "rep", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")
    )
    wanted = members.select(F.col("rep").alias("doc_id")).distinct()
    near = maybe_in(docs, "doc_id", bloom(wanted, "doc_id"))
    sets = near.join(wanted, "doc_id", "left_semi").mapInArrow(
        lambda b: set_batches(b, width, values), "rep long, shingles binary, signature binary"
    )

    def link(table: pa.Table) -> pa.Table:
        table = table.sort_by("rep")
        ids = np.asarray(table.column("rep"))
        found = cell_links(
            ids, np.asarray(table.column("block")), [_unpack(s) for s in table.column("shingles").to_pylist()],
            np.frombuffer(b"".join(table.column("signature").to_pylist()), np.uint16).reshape(len(ids), values),
            percent, errors,
        )
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    links = sized.join(sets, "rep").groupBy("cell", "i", "j").applyInArrow(link, "a long, b long")
    linked = components(links)
    named = classes.select(*same, "rep").join(linked, F.col("rep") == F.col("node"), "left").select(
        *same, F.coalesce("component", "rep").alias("class_id")
    )
    component = F.coalesce("class_id", "doc_id")
    return sketch.join(named, same, "left").select(
        "doc_id", "n_shingles", component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
    )
