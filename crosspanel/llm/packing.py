"""Packing token sequences by swap-based local search.

Documents are cut so that only their first piece may be shorter than a sequence.  The pieces are dealt
evenly into groups of bounded size; a group is packed best fit first, and the bins that are left underfull
are improved by moving one piece, exchanging one for one or two for one, whenever that raises the sum of
squared fills, until no pair of them can be improved or the group needs no fewer bins.
"""

from __future__ import annotations

import math
import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from crosspanel.llm.tokens import encoder

CAPACITY = 1024
END = 2
#: Pieces that one task packs together, about.
GROUP_PIECES = 16384

PIECE = "piece int, start long, length long, ids_crc32 long"


def piece_batches(batches: Iterator[pa.RecordBatch], path: str, capacity: int, end: int) -> Iterator[pa.RecordBatch]:
    """The pieces of each row (row columns repeated), from column ``text``; the text goes."""
    coder = encoder(path)
    for whole in batches:
        # A thousand texts at a time bound the ids that are held.
        for at_row in range(0, whole.num_rows, 1000):
            batch = whole.slice(at_row, 1000)
            names = [n for n in batch.schema.names if n != "text"]
            texts = [t or "" for t in batch.column("text").to_pylist()]
            ids, offsets = coder.encode(texts)
            rows: list[tuple[int, int, int, int, int]] = []
            for i in range(len(texts)):
                own = np.append(ids[offsets[i] : offsets[i + 1]], np.uint32(end)).astype("<u4")
                cuts = [0, *range(len(own) % capacity or capacity, len(own) + 1, capacity)]
                for piece, (at, to) in enumerate(zip(cuts, cuts[1:])):
                    rows.append((i, piece, at, to - at, zlib.crc32(own[at:to].tobytes())))
            source, *values = zip(*rows)
            columns = [batch.column(n).take(pa.array(source, pa.int64())) for n in names]
            columns += [pa.array(v, t) for v, t in zip(values, (pa.int32(), *[pa.int64()] * 3))]
            yield pa.RecordBatch.from_arrays(columns, [*names, "piece", "start", "length", "ids_crc32"])


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins of positions: largest piece first, each into the fullest bin that has room."""
    bins: list[list[int]] = []
    room: list[int] = []  # rooms that some open bin has, sorted
    open_bins: dict[int, list[int]] = defaultdict(list)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        at = bisect_left(room, sizes[i])
        if at == len(room):
            bins.append([i])
            left, into = capacity - sizes[i], len(bins) - 1
        else:
            left = room[at]
            into = open_bins[left].pop()
            if not open_bins[left]:
                room.pop(at)
            bins[into].append(i)
            left -= sizes[i]
        if left:
            if not open_bins[left]:
                insort(room, left)
            open_bins[left].append(into)
    return bins


def _improve(a: list[int], b: list[int], sizes: list[int], capacity: int) -> bool:
    """One move, swap or two-for-one swap from ``b`` into ``a`` that raises the squared fills most, if any.

    With fills fa and fb, shifting d tokens to ``a`` changes their squared sum by 2 d (fa - fb + d), so
    among the shifts that fit, d > 0 and largest is best when fa + d > fb.
    """
    fa, fb = sum(sizes[i] for i in a), sum(sizes[i] for i in b)
    room = capacity - fa
    if room <= 0:
        return False
    least = max(0, fb - fa)  # d must be above it to raise the sum
    best, change = least, None
    for j in b:
        if best < sizes[j] <= room:
            best, change = sizes[j], ([], [j])
    if best < room:
        out = sorted((sizes[i], i) for i in a)
        values = [s for s, _ in out]
        give = [(sizes[j], [j]) for j in b]
        give += [(sizes[b[x]] + sizes[b[y]], [b[x], b[y]]) for x in range(len(b)) for y in range(x)]
        for total, js in give:
            # The smallest piece of ``a`` that makes room for them.
            at = bisect_left(values, total - room)
            if at < len(out) and total - values[at] > best:
                best, change = total - values[at], ([out[at][1]], js)
        pairs = sorted((sizes[a[x]] + sizes[a[y]], x, y) for x in range(len(a)) for y in range(x))
        values = [p[0] for p in pairs]
        for j in b:
            at = bisect_left(values, sizes[j] - room)
            if at < len(pairs) and sizes[j] - values[at] > best:
                best, change = sizes[j] - values[at], ([a[pairs[at][1]], a[pairs[at][2]]], [j])
    if change is None:
        return False
    for i in change[0]:
        a.remove(i)
        b.append(i)
    for j in change[1]:
        b.remove(j)
        a.append(j)
    return True


def _values(members: list[int], sizes: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct sizes of a bin's pieces, and of its pairs of pieces."""
    one, times = np.unique(np.array([sizes[i] for i in members], np.int64), return_counts=True)
    rows, columns = np.triu_indices(len(one), 1)
    return one, np.unique(np.concatenate([one[rows] + one[columns], 2 * one[times > 1]]))


class _Offers:
    """What every underfull bin can give: flat (value, bin) entries, one table for pieces and one for pairs.

    Entries of a bin that has changed are set to zero, which no bin takes, and its new ones appended.
    """

    def __init__(self) -> None:
        self.value, self.owner, self.used, self.span = np.zeros(1024, np.int64), np.zeros(1024, np.int64), 0, {}

    def put(self, k: int, values: np.ndarray) -> None:
        if k in self.span:
            at, to = self.span.pop(k)
            self.value[at:to] = 0
        if not len(values):
            return
        if self.used + len(values) > len(self.value):
            live = np.flatnonzero(self.value[: self.used])
            value, owner = self.value[live], self.owner[live]
            room = 2 * (len(live) + len(values)) + 1024
            self.value, self.owner, self.used = np.zeros(room, np.int64), np.zeros(room, np.int64), len(live)
            self.value[: len(live)], self.owner[: len(live)] = value, owner
            cuts = np.flatnonzero(np.diff(owner)) + 1
            starts = [0, *cuts.tolist()] if len(live) else []
            self.span = {int(owner[x]): (x, y) for x, y in zip(starts, [*starts[1:], len(live)])}
        at, to = self.used, self.used + len(values)
        self.value[at:to], self.owner[at:to], self.used = values, k, to
        self.span[k] = (at, to)

    def best(self, taken: np.ndarray, room: int, capacity: int, least: np.ndarray, fills: np.ndarray):
        """(fill of the giver, -shift, giver) of the emptiest bin that can give, or None.

        ``taken`` are the sorted sizes that may go back; the shift is the largest that fits the room.
        """
        value = np.arange(capacity + 1)
        at = np.searchsorted(taken, value - room)
        back = np.append(taken, capacity + 1)[at]
        shift = np.maximum(value - back, 0)[self.value[: self.used]]
        owner = self.owner[: self.used]
        found = np.flatnonzero(shift > least[owner])
        if not len(found):
            return None
        pick = found[np.argmin(fills[owner[found]] * (capacity + 1) - shift[found])]
        k = int(owner[pick])
        return int(fills[k]), -int(shift[pick]), k


def local_search(bins: list[list[int]], sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins after improving the underfull ones; ends when the lower bound is met or no pair of bins can be improved.

    Every ordered pair of underfull bins is looked at: with fills fa and fb, shifting d tokens from b to a changes
    their squared sum by 2 d (fa - fb + d), so a shift counts that fits the room of a and exceeds max(0, fb - fa).  The
    squared sum rises with every change, so the search ends; full bins can take no part in a change.
    """
    least = -(-sum(sizes) // capacity)
    fills = np.array([sum(sizes[i] for i in b) for b in bins], np.int64)
    count = int((fills > 0).sum())
    values: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    pieces, pairs = _Offers(), _Offers()

    def offer(k: int) -> None:
        open_bin = 0 < fills[k] < capacity
        values[k] = _values(bins[k] if open_bin else [], sizes)
        pieces.put(k, values[k][0])
        pairs.put(k, values[k][1])

    for k in np.flatnonzero((fills > 0) & (fills < capacity)).tolist():
        offer(k)
    none = np.zeros(1, np.int64)
    changed = True
    while changed and count > least:
        changed = False
        # The fuller bins take first, from the emptiest that can give.
        for a in sorted((k for k in values if 0 < fills[k] < capacity), key=lambda k: -fills[k]):
            while count > least and 0 < fills[a] < capacity:
                room = int(capacity - fills[a])
                need = np.maximum(fills - fills[a], 0)
                need[a] = capacity + 1
                one, two = values[a]
                whole = np.unique(np.concatenate([none, one, two]))
                single = pieces.best(whole, room, capacity, need, fills)
                double = pairs.best(one, room, capacity, need, fills)
                if single is None and double is None:
                    break
                b = min(f for f in (single, double) if f is not None)[2]
                _improve(bins[a], bins[b], sizes, capacity)
                for k in (a, b):
                    fills[k] = sum(sizes[i] for i in bins[k])
                count -= not bins[b]
                offer(a)
                offer(b)
                changed = True
    return [b for b in bins if b]


def pack_group(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(bin, offset) of every piece and the number of bins."""
    small = np.flatnonzero(sizes < capacity)
    full = np.flatnonzero(sizes >= capacity)
    values = sizes[small].tolist()
    bins = local_search(best_fit(values, capacity), values, capacity)
    place, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    for k, members in enumerate(bins):
        at = 0
        for i in sorted(members):
            place[small[i]], offset[small[i]] = k, at
            at += values[i]
    place[full] = len(bins) + np.arange(len(full))
    return place, offset, len(bins) + len(full)


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """``pieces`` (with length and any more columns) with ``sequence_id`` and ``offset``.

    ``pieces`` should be a stored table: it is counted first.  A sequence is gapless from offset 0.  Pieces are
    dealt out evenly whatever their columns hold; a task packs its share in groups of
    ``group_pieces``, so that its memory doesn't grow with the input.
    """
    parts = max(1, math.ceil(pieces.count() / group_pieces))
    names = pieces.columns

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 32
        held: list[pa.RecordBatch] = []
        rows = bins = 0

        def packed() -> pa.RecordBatch:
            nonlocal bins
            table = pa.Table.from_batches(held).combine_chunks()
            place, offset, more = pack_group(np.asarray(table.column("length")), capacity)
            columns = [*(table.column(n).chunk(0) for n in names), pa.array(place + base + bins), pa.array(offset)]
            bins += more
            return pa.RecordBatch.from_arrays(columns, [*names, "sequence_id", "offset"])

        for batch in found:
            if not batch.num_rows:
                continue
            held.append(batch)
            rows += batch.num_rows
            if rows >= 2 * group_pieces:
                yield packed()
                held, rows = [], 0
        if held:
            yield packed()

    extra = [T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]
    # In a fixed order, so that a task that runs again packs alike.
    dealt = pieces.repartition(parts).sortWithinPartitions(*names)
    return dealt.mapInArrow(batches, T.StructType([*pieces.schema.fields, *extra]))


def cut(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """doc_id with piece, start, length and ids_crc32 of every piece of every row.

    A null text counts as empty and gives one piece, the end token.  Repeated rows give their own pieces.
    More columns of ``docs`` are ignored.  ``path`` is the tokenizer's file, at the same place on all machines.
    """
    return docs.select("doc_id", "text").mapInArrow(
        lambda batches: piece_batches(batches, path, capacity, end), f"doc_id long, {PIECE}"
    )
