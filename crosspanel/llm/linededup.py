"""Near-duplicate lines by an exact set-similarity join.

A line is the set of its words.  Words are ordered by rarity, counted over all texts.  Two lines of
similarity t share a word among the first ``n - ceil(t n) + 1`` of the longer and the first
``n - ceil(2 t / (1 + t) n) + 1`` of the shorter; the places of that word and the lengths bound the
overlap, and 128 parity bits of each set bound the difference.  What passes is verified on the full sets.

Lines with equal sets are one class, at the place of the first.  Prefix entries are shuffled once by word, packed
in buckets of words, and swept there; a class leaves the sweep of a word with its earliest candidate, or where that
one is in doubt with the next ones too, ``MOST`` in all, so no rows grow with the square of a group.  A sweep holds all entries of a word in one task; each is compared with
those before it until it has one candidate more than it gives, so lines that all match their first one cost two
comparisons each, and lines of one word that don't match one another cost the square.  Only a class whose earliest
candidates all fail on the full sets, and that has more, is joined with all of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from crosspanel.llm import words as W
from crosspanel.llm.base import released, written
from crosspanel.llm.membership import bloom, hits

PERCENT = 80
#: Lines with fewer distinct words are never compared, and stay; the SQL of op7 sets this bound.  One compares all.
MIN_WORDS = 1
#: The table of word counts: 2 ** 24 hashed counters, one byte each (the logarithm) where it is broadcast.
COUNTER_BITS, BLOCK_BITS = 24, 14
LINES = "row long, doc_id long, line_no int, class long, size int, even long, odd long, prefix array<struct<word: long, pos: int>>"
#: Entries of a bucket of words, about, and classes that an extracting task remembers.
SWEEP_ROWS = 100_000
SEEN = 50_000
#: Candidates that a sweep gives for an entry at most, where the earlier ones are in doubt.
MOST = 16
ENTRY = {"doc_id": "i8", "line_no": "i4", "class": "i8", "size": "i4", "even": "i8", "odd": "i8", "word": "i8", "pos": "i4"}
FIRST = -(1 << 63)  # stands for a null id, which sorts first


def count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, counts): a partition's word counts, as pairs of place in the block and count."""
    held: list[np.ndarray] = []
    totals = (np.empty(0, np.uint32), np.empty(0, np.int64))

    def merged() -> tuple[np.ndarray, np.ndarray]:
        found, n = np.unique(np.concatenate(held), return_counts=True) if held else (np.empty(0, np.uint32), np.empty(0, int))
        both = np.concatenate([totals[0], found])
        keys, at = np.unique(both, return_inverse=True)
        return keys, np.bincount(at, np.concatenate([totals[1], n]), len(keys)).astype(np.int64)

    size = 0
    for batch in released(batches):
        for _, _, data, offsets in W.text_slices(batch.column("text")):
            hashes, _ = W.words(data, offsets)
            held.append((hashes >> np.uint64(64 - COUNTER_BITS)).astype(np.uint32))
            size += len(hashes)
            if size > 2_000_000:
                totals, held, size = merged(), [], 0
    keys, counts = merged()
    if len(keys):
        blocks = keys >> np.uint32(BLOCK_BITS)
        cuts = np.flatnonzero(np.r_[True, blocks[1:] != blocks[:-1], True])
        pairs = np.stack([keys & np.uint32((1 << BLOCK_BITS) - 1), np.minimum(counts, 2**32 - 1)], 1).astype("<u4")
        yield pa.RecordBatch.from_arrays(
            [pa.array(blocks[cuts[:-1]].astype(np.int32)), pa.array([pairs[a:b].tobytes() for a, b in zip(cuts, cuts[1:])])],
            ["block", "counts"],
        )


def merge_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, codes): 0 for no word, 1 for one, then rising with the logarithm of the count."""
    sums: dict[int, np.ndarray] = {}
    for batch in released(batches):
        for block, packed in zip(batch.column("block").to_pylist(), batch.column("counts").to_pylist()):
            pairs = np.frombuffer(packed, "<u4").reshape(-1, 2)
            counts = sums.setdefault(block, np.zeros(1 << BLOCK_BITS, np.int64))
            counts[pairs[:, 0]] += pairs[:, 1]
    if sums:
        codes = [
            np.where(c > 0, np.minimum(1 + np.ceil(7 * np.log2(np.maximum(c, 1))), 255), 0).astype(np.uint8) for c in sums.values()
        ]
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums), pa.int32()), pa.array([c.tobytes() for c in codes])], ["block", "codes"]
        )


def rarity(docs: DataFrame) -> np.ndarray:
    """A code for each counter, over all words of all texts: 16 MB at any size of the input."""
    counts = docs.select("text").mapInArrow(count_batches, "block int, counts binary")
    merged = counts.repartition(64, "block").mapInArrow(merge_batches, "block int, codes binary")
    table = np.zeros(1 << COUNTER_BITS, np.uint8)
    for r in merged.collect():
        table[r.block << BLOCK_BITS : (r.block + 1) << BLOCK_BITS] = np.frombuffer(r.codes, np.uint8)
    return table


def line_sets(data: np.ndarray, offsets: np.ndarray, codes: np.ndarray | None):
    """(row, line number, distinct words) of the lines with words: flat words, their line starts, row, number.

    With ``codes`` a line's words are in order of rarity.
    """
    starts, ends, row = W.spans(data, offsets, W.SPACE)
    hashes = W.span_hashes(W.byte_values(data), starts, ends)
    breaks = np.cumsum(np.concatenate([[0], data == 0x0A]))
    line = breaks[starts] + row
    number = breaks[starts] - breaks[offsets[row]]
    rare = codes[hashes >> np.uint64(64 - COUNTER_BITS)].astype(np.uint64) if codes is not None else np.uint64(0)
    order = np.argsort(line.astype(np.uint64) << np.uint64(40) | rare << np.uint64(32) | hashes >> np.uint64(32))
    same = line[order[1:]] == line[order[:-1]]
    tied = same & (hashes[order[1:]] != hashes[order[:-1]]) & (hashes[order[1:]] >> np.uint64(32) == hashes[order[:-1]] >> np.uint64(32))
    if tied.any() or (len(line) and line[-1] >= 1 << 24):
        # Different words with equal upper halves: their order must not hang on where they stand in the line.
        order = np.lexsort((hashes, np.broadcast_to(rare, hashes.shape), line))
    hashes, line, row, number = hashes[order], line[order], row[order], number[order]
    fresh = np.ones(len(hashes), bool)
    fresh[1:] = (hashes[1:] != hashes[:-1]) | (line[1:] != line[:-1])
    hashes, line, row, number = hashes[fresh], line[fresh], row[fresh], number[fresh]
    cuts = np.flatnonzero(np.r_[True, line[1:] != line[:-1]]) if len(line) else np.empty(0, int)
    return hashes, cuts, row[cuts], number[cuts]


def probe_length(size, percent: int):
    """Words of the longer line's prefix; works on numbers and arrays."""
    return size + (-percent * size // 100) + 1


def index_length(size, percent: int):
    """Words of the shorter line's prefix."""
    return size + (-2 * percent * size // (100 + percent)) + 1


def partnered(size, percent: int):
    """Whether a set of this size can match another than its equal: one word more is the nearest."""
    return 100 * size >= percent * (size + 1)


def line_batches(batches: Iterator[pa.RecordBatch], codes: np.ndarray, percent: int, least: int) -> Iterator[pa.RecordBatch]:
    """A row for each line; its prefix too where the task meets the class for the first time, or earlier than before."""
    seen: dict[int, tuple[int, int]] = {}
    for batch in released(batches):
        keys, ids = np.asarray(batch.column("row")), np.asarray(batch.column("doc_id").fill_null(FIRST))
        for at, _, data, offsets in W.text_slices(batch.column("text")):
            hashes, cuts, row, number = line_sets(data, offsets, codes)
            sizes = np.diff(np.append(cuts, len(hashes)))
            want = np.flatnonzero(sizes >= least)
            if not len(want):
                continue
            one = np.add.reduceat(W.mix(hashes + np.uint64(0x77)), cuts)[want].view(np.int64)
            # Each word flips one of 128 bits: two sets differ in at least as many words as bits.
            bit = W.mix(hashes + np.uint64(0x99)) >> np.uint64(57)
            flips = np.uint64(1) << (bit >> np.uint64(1))
            even, odd = (
                np.bitwise_xor.reduceat(np.where((bit & np.uint64(1)) == half, flips, np.uint64(0)), cuts)[want].view(np.int64)
                for half in (np.uint64(0), np.uint64(1))
            )
            doc = ids[at + row[want]]
            if len(seen) > SEEN:
                seen.clear()
            fresh = np.zeros(len(want), bool)
            for i, (key, place) in enumerate(zip(one.tolist(), zip(doc.tolist(), number[want].tolist()))):
                before = seen.get(key)
                if before is None or place < before:
                    seen[key] = place
                    fresh[i] = True
            # A smaller set matches its equals only, which are its class: it needs no entry.
            prefix = probe_length(sizes[want], percent) * (fresh & partnered(sizes[want], percent))
            pos = np.arange(int(prefix.sum())) - np.repeat(np.cumsum(prefix) - prefix, prefix)
            place = pos + np.repeat(cuts[want], prefix)
            # A word that occurs once in all texts has no partner: its place counts, its entry isn't needed.
            shared = codes[hashes[place] >> np.uint64(64 - COUNTER_BITS)] > 1
            line_of = np.repeat(np.arange(len(want)), prefix)[shared]
            ends = np.searchsorted(line_of, np.arange(len(want) + 1)).astype(np.int32)
            entry = pa.StructArray.from_arrays(
                [pa.array(hashes[place[shared]].view(np.int64)), pa.array(pos[shared].astype(np.int32))], ["word", "pos"]
            )
            lists = pa.ListArray.from_arrays(pa.array(ends), entry)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(keys[at + row[want]]), pa.array(doc), pa.array(number[want].astype(np.int32)), pa.array(one),
                    pa.array(sizes[want].astype(np.int32)), pa.array(even), pa.array(odd), lists,
                ],
                ["row", "doc_id", "line_no", "class", "size", "even", "odd", "prefix"],
            )


def _candidate(a, b, percent: int) -> np.ndarray:
    """Prefix, length, position and parity filters on pairs of entries of one word, given as columns."""
    big, small = np.maximum(a["size"], b["size"]), np.minimum(a["size"], b["size"])
    total = a["size"] + b["size"]
    need = -(-percent * total // (100 + percent))
    longer = a["size"] >= b["size"]
    pos = np.where(longer, b["pos"], a["pos"])  # of the shorter
    good = (100 * small >= percent * big) & (pos < index_length(small, percent))
    good &= np.minimum(a["size"] - a["pos"], b["size"] - b["pos"]) >= need
    at = np.flatnonzero(good)
    bits = [np.bitwise_count((a[k][at] ^ b[k][at]).view(np.uint64)).astype(np.int64) for k in ("even", "odd")]
    good[at] = bits[0] + bits[1] <= total[at] - 2 * need[at]
    return good


def _doubtful(a, b, percent: int) -> np.ndarray:
    """Whether a candidate may well fail: its bits leave little room for the words that flip one bit back."""
    total = a["size"] + b["size"]
    differ = sum(np.bitwise_count((a[k] ^ b[k]).view(np.uint64)).astype(np.int64) for k in ("even", "odd"))
    return differ + differ * differ // 128 + 2 > total - 2 * (-(-percent * total // (100 + percent)))


def _ordered(rows: dict[str, np.ndarray]) -> np.ndarray:
    """Places of the rows by word, then doc_id, line and class; of a word's rows of one class the first only."""
    doc, line, word = rows["doc_id"], rows["line_no"], rows["word"]
    low = int(doc.min()) if len(doc) else 0
    if len(doc) and int(doc.max()) - low < 1 << 31 and 0 <= int(line.min()) and int(line.max()) < 1 << 31:
        place = (doc - low) << 31 | line
        order = np.argsort(place)
        kind = rows["class"][order]
        clear = not ((place[order[1:]] == place[order[:-1]]) & (kind[1:] != kind[:-1])).any()
    else:
        clear = False
    if not clear:
        order = np.lexsort((rows["class"], line, doc))
    order = order[np.argsort(word[order], kind="stable")]
    # Rows of one class under a word are side by side after a sort by both, the earliest first.
    both = W.mix(W.mix(word[order].view(np.uint64)) + rows["class"][order].view(np.uint64))
    by = np.argsort(both, kind="stable")
    same = np.zeros(len(order), bool)
    same[by[1:]] = (both[by[1:]] == both[by[:-1]]) & (rows["class"][order[by[1:]]] == rows["class"][order[by[:-1]]])
    return order[~same]


def _swept(rows: dict[str, np.ndarray], percent: int, most: int):
    """(rows in order, y, x, count, given) of whole words, in any order of rows.

    ``y`` and ``x`` are places in the ordered rows: an entry and an earlier candidate under its word, the earliest
    first, up to one that is not in doubt or to ``most``.  ``given`` is how many an entry has there, ``count`` is
    larger by one if it has more.
    """
    order = _ordered(rows)
    r = {k: v[order] for k, v in rows.items()}
    n = len(order)
    start = np.maximum.accumulate(np.where(np.r_[True, r["word"][1:] != r["word"][:-1]], np.arange(n), 0)) if n else np.arange(0)
    count, given = np.zeros(n, np.int64), np.full(n, most)
    names, size = ("size", "pos", "even", "odd"), np.append(r["size"], np.zeros(8, np.int64))
    found_y, found_x = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    # Every entry meets those before it, the earliest first, until it has one candidate more than it gives.
    # Those still left, sorted out every few rounds, stand beside the first of their word and the sizes they may match.
    left = np.flatnonzero(start < np.arange(n))
    base, least, largest = start[left], -(-percent * size[left] // 100), 100 * size[left] // percent
    k = 0
    while len(left):
        x = base + k
        other = size[x]
        near = np.flatnonzero((other >= least) & (other <= largest) & (x < left))
        y, x = left[near], x[near]
        good = _candidate({c: r[c][x] for c in names}, {c: r[c][y] for c in names}, percent)
        near, y, x = near[good], y[good], x[good]
        new = count[y] < given[y]
        count[y] += 1
        largest[near[count[y] > given[y]]] = -1
        near, y, x = near[new], y[new], x[new]
        found_y.append(y)
        found_x.append(x)
        sure = ~_doubtful({c: r[c][x] for c in names}, {c: r[c][y] for c in names}, percent)
        given[y[sure]] = count[y[sure]]
        k += 1
        if k < 8 or k % 8 == 0:
            still = np.flatnonzero((base + k < left) & (largest >= 0))
            left, base, least, largest = left[still], base[still], least[still], largest[still]
    return r, np.concatenate(found_y), np.concatenate(found_x), count, given


def sweep(rows: dict[str, np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(class, its earliest earlier candidate under the word, 1 or 2 for more) of whole words, in any order of rows."""
    r, y, x, count, _ = _swept(rows, percent, 1)
    return r["class"][y], r["class"][x], count[y]


def place_keys(doc: np.ndarray, line: np.ndarray) -> np.ndarray:
    """A number for the place of a line."""
    return W.mix(W.mix(doc.astype(np.int64).view(np.uint64)) + line.astype(np.uint64)).view(np.int64)


def entry_columns(batch: pa.RecordBatch, wanted: np.ndarray | None = None) -> dict[str, np.ndarray]:
    """The prefix entries of lines as columns; with ``wanted`` those whose word may be there."""
    prefix = batch.column("prefix")
    entry, line = prefix.flatten(), np.repeat(np.arange(len(prefix)), np.asarray(prefix.value_lengths()))
    columns = {k: np.asarray(entry.field(k)) for k in ("word", "pos")}
    if wanted is not None:
        hit = np.flatnonzero(hits(wanted, columns["word"]))
        line, columns = line[hit], {k: v[hit] for k, v in columns.items()}
    return {k: np.asarray(batch.column(k))[line] for k in ENTRY if k not in columns} | columns


def bucket_batches(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """(bucket, entries): the prefix entries of lines by the bucket of their word, packed column after column."""
    held: list[dict[str, np.ndarray]] = []

    def packed() -> pa.RecordBatch:
        rows = {k: np.concatenate([h[k] for h in held]) for k in ENTRY}
        bucket = (rows["word"].view(np.uint64) % np.uint64(buckets)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        bucket, rows = bucket[order], {k: rows[k][order].astype(t) for k, t in ENTRY.items()}
        cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True]) if len(bucket) else np.zeros(1, int)
        data = [b"".join(rows[k][a:b].tobytes() for k in ENTRY) for a, b in zip(cuts, cuts[1:])]
        return pa.RecordBatch.from_arrays([pa.array(bucket[cuts[:-1]]), pa.array(data, pa.binary())], ["bucket", "entries"])

    for batch in released(batches):
        held.append(entry_columns(batch))
        if sum(len(h["word"]) for h in held) >= 2 * SWEEP_ROWS:
            yield packed()
            held.clear()
    if held:
        yield packed()


def unpacked(data: list[bytes]) -> dict[str, np.ndarray]:
    """The entries of a bucket as columns."""
    width = sum(np.dtype(t).itemsize for t in ENTRY.values())
    out, at = {}, 0
    for k, t in ENTRY.items():
        parts = [np.frombuffer(d, t, len(d) // width, at * (len(d) // width)) for d in data]
        out[k] = np.concatenate(parts).astype(np.int64)
        at += np.dtype(t).itemsize
    return out


def sweep_batches(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """(y, its place, x, its place, whether y has more candidates under the word) from packed entries sorted by bucket."""
    def given(data: list[bytes]) -> pa.RecordBatch:
        r, y, x, count, most = _swept(unpacked(data), percent, MOST)
        keys = place_keys(r["doc_id"], r["line_no"])
        columns = r["class"][y], keys[y], r["class"][x], keys[x], (count > most)[y]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["y", "y_at", "x", "x_at", "more"])

    held: list[bytes] = []
    last = None
    for batch in released(batches):
        for bucket, data in zip(batch.column("bucket").to_pylist(), batch.column("entries").to_pylist()):
            if held and bucket != last:
                yield given(held)
                held = []
            held.append(data)
            last = bucket
    if held:
        yield given(held)


def wanted_lines(data: np.ndarray, offsets: np.ndarray, ids: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of the lines whose place may be wanted, and their offsets; ``ids`` are the rows' doc_ids."""
    breaks = np.flatnonzero(data == 0x0A)
    counts = np.bincount(np.searchsorted(offsets, breaks, "right") - 1, minlength=len(ids)) + 1
    row = np.repeat(np.arange(len(ids)), counts)
    number = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
    at = np.flatnonzero(hits(wanted, place_keys(ids[row], number)))
    starts = np.sort(np.concatenate([offsets[:-1], breaks + 1]))[at]
    lengths = np.sort(np.concatenate([offsets[1:], breaks]))[at] - starts
    ends = np.concatenate([[0], np.cumsum(lengths)])
    return data[np.arange(ends[-1]) + np.repeat(starts - ends[:-1], lengths)], ends


def set_batches(batches: Iterator[pa.RecordBatch], wanted: np.ndarray, least: int) -> Iterator[pa.RecordBatch]:
    """(class, words) of the lines whose place may be wanted, once for each class a task remembers."""
    seen: set[int] = set()
    for batch in released(batches):
        ids = np.asarray(batch.column("doc_id").fill_null(FIRST))
        for first, end, data, offsets in W.text_slices(batch.column("text")):
            hashes, cuts, _, _ = line_sets(*wanted_lines(data, offsets, ids[first:end], wanted), None)
            sizes = np.diff(np.append(cuts, len(hashes)))
            if not len(cuts):
                continue
            one = np.add.reduceat(W.mix(hashes + np.uint64(0x77)), cuts).view(np.int64)
            if len(seen) > SEEN:
                seen.clear()
            own = []
            for i, key in zip(np.flatnonzero(sizes >= least).tolist(), one[sizes >= least].tolist()):
                if key not in seen:
                    seen.add(key)
                    own.append(i)
            own = np.array(own, np.int64)
            ends = np.concatenate([[0], np.cumsum(sizes[own])])
            flat = np.arange(int(ends[-1])) + np.repeat(cuts[own] - ends[:-1], sizes[own])
            sets = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(hashes[flat].view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(one[own]), sets], ["class", "words"])


def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(y, its place, x, its place) from places as structs."""
    for batch in batches:
        at = [place_keys(*[np.asarray(f) for f in batch.column(c).flatten()]) for c in ("yp", "xp")]
        columns = batch.column("y"), pa.array(at[0]), batch.column("x"), pa.array(at[1])
        yield pa.RecordBatch.from_arrays(list(columns), ["y", "y_at", "x", "x_at"])


def entry_batches(batches: Iterator[pa.RecordBatch], wanted: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The prefix entries of lines whose word may be wanted."""
    for batch in released(batches):
        rows = entry_columns(batch, wanted)
        yield pa.RecordBatch.from_arrays([pa.array(rows[k]) for k in ENTRY], list(ENTRY))


def _passes(y: dict[str, Column], x: dict[str, Column], percent: int) -> Column:
    """The filters of ``_candidate`` as a join condition, for ``x`` earlier than ``y``."""
    total = x["size"] + y["size"]
    need = F.ceil(percent * total / (100 + percent))
    short_pos = F.when(y["size"] >= x["size"], x["pos"]).otherwise(y["pos"])
    short = F.least(x["size"], y["size"])
    earlier = F.struct(x["doc_id"], x["line_no"], x["class"]) < F.struct(y["doc_id"], y["line_no"], y["class"])
    return (
        earlier
        & (100 * short >= percent * F.greatest(x["size"], y["size"]))
        & (short_pos < short - F.ceil(2 * percent * short / (100 + percent)) + 1)
        & (F.least(x["size"] - x["pos"], y["size"] - y["pos"]) >= need)
        & (sum(F.bit_count(x[k].bitwiseXOR(y[k])) for k in ("even", "odd")) <= total - 2 * need)
    )


def removed_lines(docs: DataFrame, percent: int = PERCENT, least: int = MIN_WORDS) -> DataFrame:
    """(row, line_no) of every line that has an earlier match; ``docs`` has row, doc_id and text.

    Lines are ordered by doc_id (null first), line number and set.  A line with ``least`` distinct words or more goes
    if any earlier line shares ``percent`` of a hundred of the words that either has.
    """
    codes = rarity(docs)
    lines = written(docs.select("row", "doc_id", "text").mapInArrow(
        lambda b: line_batches(b, codes, percent, least), LINES
    ), "lines")
    of_line = [k for k in ENTRY if k not in ("word", "pos")]
    listed = lines.where(F.size("prefix") > 0).select(*of_line, "prefix")
    n, total = lines.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    buckets = (n + total * (100 - percent) // 100) // SWEEP_ROWS + 1
    found = listed.mapInArrow(lambda b: bucket_batches(b, buckets), "bucket int, entries binary").repartition(
        "bucket"
    ).sortWithinPartitions("bucket").mapInArrow(
        lambda b: sweep_batches(b, percent), "y long, y_at long, x long, x_at long, more boolean"
    )
    pairs = written(found.groupBy("y", "y_at", "x", "x_at").agg(F.max("more").alias("more")), "pairs")
    def verified(tried: DataFrame) -> DataFrame:
        """Classes ``y`` of pairs that the full sets confirm."""
        needed = bloom(tried.select(F.col("y_at").alias("at")).union(tried.select("x_at")), "at")
        sets = written(docs.select("doc_id", "text").mapInArrow(
            lambda b: set_batches(b, needed, least), "class long, words array<long>"
        ).dropDuplicates(["class"]), "sets")
        both = tried.join(sets.select(F.col("class").alias("y"), F.col("words").alias("yw")), "y").join(
            sets.select(F.col("class").alias("x"), F.col("words").alias("xw")), "x"
        )
        shared = F.size(F.array_intersect("yw", "xw"))
        return both.where(100 * shared >= percent * (F.size("yw") + F.size("xw") - shared)).select("y").distinct()

    matched = written(verified(pairs), "matched")
    more = pairs.where("more").select(F.col("y").alias("class")).distinct()
    open_ = written(more.join(matched.select(F.col("y").alias("class")), "class", "left_anti"), "open")
    if open_.head(1):
        names = ("doc_id", "line_no", "class", "size", "pos", "even", "odd")
        # Tasks give a class's entries at the place where each met it; its own place is the first.
        one = listed.join(open_, "class", "left_semi").select(*of_line, F.inline("prefix"))
        ys = one.groupBy("word", "class", "size", "pos", "even", "odd").agg(F.min(F.struct("doc_id", "line_no")).alias("p"))
        ys = written(ys.select("*", "p.*").drop("p"), "entries")
        words = bloom(ys, "word")
        xs = listed.mapInArrow(lambda b: entry_batches(b, words), listed.select(*of_line, F.inline("prefix")).schema)
        sides = [e.select("word", F.struct(*names).alias(side)) for e, side in ((ys, "y"), (xs, "x"))]
        y, x = ({k: F.col(f"{side}.{k}") for k in names} for side in "yx")
        place = lambda side: F.min(F.struct(side["doc_id"], side["line_no"]))
        rest = sides[0].join(sides[1], "word").where(_passes(y, x, percent)).groupBy(
            F.col("y.class").alias("y"), F.col("x.class").alias("x")
        ).agg(place(y).alias("yp"), place(x).alias("xp"))
        rest = rest.join(pairs, ["y", "x"], "left_anti").mapInArrow(keyed, "y long, y_at long, x long, x_at long")
        matched = matched.union(verified(written(rest, "rest"))).distinct()
    flags = matched.select(F.col("y").alias("class")).withColumn("matched", F.lit(True))
    classes = lines.groupBy("class").agg(
        F.min(F.struct("doc_id", "line_no")).alias("place"), F.count(F.lit(1)).alias("n")
    )
    gone = classes.join(flags, "class", "left").where("n > 1 OR matched").select("class", "place", "matched")
    later = (F.col("doc_id") != F.col("place.doc_id")) | (F.col("line_no") != F.col("place.line_no"))
    return lines.drop("prefix").join(gone, "class").where(F.coalesce("matched", F.lit(False)) | later).select("row", "line_no")


def dedup_lines(docs: DataFrame, percent: int = PERCENT, least: int = MIN_WORDS) -> DataFrame:
    """(doc, text, removed): every row of ``docs`` as a struct, its text without the removed lines, and their count.

    ``docs`` has doc_id and text, and any more columns, which can't clash with the working ones.  A null text stays
    null, an empty one empty.  Rows that repeat one another in id and text are one document: they are
    treated alike.  An empty table gives no rows.  Kept lines stay as they are, in their order.
    """
    row = F.xxhash64("doc_id", "text").alias("row")
    inner = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", row)
    gone = removed_lines(inner, percent, least).groupBy("row").agg(F.collect_set("line_no").alias("gone"))
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), row)
    kept = F.filter(F.split("doc.text", "\n", -1), lambda _, i: ~F.array_contains("gone", i))
    text = F.when(F.col("gone").isNull(), F.col("doc.text")).otherwise(F.array_join(kept, "\n"))
    return whole.join(gone, "row", "left").select(
        "doc", text.alias("text"), F.coalesce(F.size("gone"), F.lit(0)).alias("removed")
    )
