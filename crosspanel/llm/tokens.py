"""Byte-level BPE ids of whole texts.

Texts are cut into the tokenizer's pre-tokens with NumPy; each distinct one is encoded once per worker by
the tokenizer's model and looked up after that.  Texts that hold a special token's string or a code point
that Unicode has not assigned go through the tokenizer as they are.
"""

from __future__ import annotations

import unicodedata
from functools import cache
from itertools import repeat

import numpy as np
from tokenizers import Tokenizer

from crosspanel.llm import words as W

LETTER, NUMBER, BLANK, OTHER, ODD = range(5)
#: White_Space of Unicode, as \\s means in the pattern of byte-level tokenizers.  Fixed values.
BLANKS = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: Contractions that are pre-tokens of their own, in the order they are tried.  Fixed values.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
SLICE = 1 << 18
#: Distinct pre-tokens that a worker keeps at most; beyond that it starts anew.
KEPT = 150_000


@cache
def _kinds() -> np.ndarray:
    out = np.full(0x110000, OTHER, np.uint8)
    for code in range(0x110000):
        category = unicodedata.category(chr(code))
        if category[0] == "L":
            out[code] = LETTER
        elif category[0] == "N":
            out[code] = NUMBER
        elif category == "Cn":
            out[code] = ODD
    out[BLANKS] = BLANK
    return out


@cache
def _byte_symbols() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {b: chr(b) for b in shown}
    hidden = [b for b in range(256) if b not in table]
    return table | {b: chr(256 + i) for i, b in enumerate(hidden)}


def pre_tokens(points: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where pre-tokens begin in the code points of the rows that ``offsets`` bounds."""
    n = len(points)
    kind = _kinds()[points]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    start = np.zeros(n + 1, bool)
    start[1:n] = kind[1:] != kind[:-1]
    start |= edge
    space = points == 0x20
    blank = kind == BLANK
    # The last blank of a run before something else: a space goes with what follows, another blank stands alone.
    last = np.zeros(n, bool)
    last[:-1] = blank[:-1] & ~blank[1:] & ~edge[1:n]
    start[:n][last] = True
    at = np.flatnonzero(last & space)
    start[at + 1] = False
    # An apostrophe that begins a pre-token of its own takes a following contraction with it.
    quotes = np.flatnonzero((points == 0x27) & start[:n])
    for i in quotes:
        after = points[i + 1 : i + 3]
        if i + 1 >= n or edge[i + 1] or kind[i + 1] != LETTER:
            continue
        for form in CONTRACTIONS:
            size = len(form)
            if i + size < n and not edge[i + 1 : i + size + 1].any() and after[:size].tolist() == [ord(c) for c in form]:
                start[i + 1] = False
                start[i + size + 1] = True
                break
    return np.flatnonzero(start[:n])


class Encoder:
    """Ids of texts, with the pre-tokens seen so far."""

    def __init__(self, path: str) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder()
        self.special = [token.content for token in added.values()]
        self.forget()

    def forget(self) -> None:
        self.place: dict[int, int] = {}
        self.ends = np.zeros(1024, np.int64)
        self.ids = np.zeros(4096, np.uint32)

    def _learn(self, keys: list[int], texts: list[str]) -> None:
        symbols, model = _byte_symbols(), self.tokenizer.model
        found = [
            [t.id for t in model.tokenize(text.encode("utf-8", "surrogatepass").decode("latin-1").translate(symbols))]
            for text in texts
        ]
        known = len(self.place)
        used = int(self.ends[known])
        ends = used + np.cumsum([len(f) for f in found])
        self.ends = _room(self.ends, known + len(keys) + 1)
        self.ids = _room(self.ids, int(ends[-1]))
        self.ends[known + 1 : known + len(keys) + 1] = ends
        self.ids[used : ends[-1]] = [i for f in found for i in f]
        self.place.update(zip(keys, range(known, known + len(keys))))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, one text after another, and the offsets of the texts in them."""
        ids, sizes = [], []
        at = 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size + len(texts[end]) <= SLICE):
                size += len(texts[end])
                end += 1
            found, counts = self._slice(texts[at:end])
            ids.append(found)
            sizes.append(counts)
            at = end
        return (
            np.concatenate(ids or [np.empty(0, np.uint32)]),
            np.concatenate([[0], np.cumsum(np.concatenate(sizes or [np.empty(0, np.int64)]))]).astype(np.int64),
        )

    def _slice(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        joined = "".join(texts)
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        if any(s in joined for s in self.special) or (len(points) and (_kinds()[points] == ODD).any()):
            return self._whole(texts)
        starts = pre_tokens(points, offsets)
        if not len(starts):
            return np.empty(0, np.uint32), np.zeros(len(texts), np.int64)
        ends = np.append(starts[1:], len(points))
        keys = W.span_hashes(W.mix(points.astype(np.uint64) + np.uint64(1)) | np.uint64(1), starts, ends)
        distinct, where, back = np.unique(keys, return_index=True, return_inverse=True)
        if len(self.place) + len(distinct) > KEPT:
            self.forget()
        names = distinct.tolist()
        place = np.fromiter(map(self.place.get, names, repeat(-1)), np.int64, len(names))
        new = np.flatnonzero(place < 0)
        if len(new):
            place[new] = len(self.place) + np.arange(len(new))
            self._learn(distinct[new].tolist(), [joined[starts[i] : ends[i]] for i in where[new]])
        at = place[back]
        sizes = self.ends[at + 1] - self.ends[at]
        ids = self.ids[_ranges(self.ends[at], sizes)]
        total = np.concatenate([[0], np.cumsum(sizes)])
        bounds = total[np.searchsorted(starts, offsets)]
        return ids, np.diff(bounds)

    def _whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [self.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
        return np.array([i for f in found for i in f], np.uint32), np.array([len(f) for f in found], np.int64)


def _room(array: np.ndarray, size: int) -> np.ndarray:
    """``array``, or a longer copy with room for ``size`` entries."""
    if size <= len(array):
        return array
    longer = np.zeros(2 * size, array.dtype)
    longer[: len(array)] = array
    return longer


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The positions start, ..., start + size - 1 of every range, one after another."""
    total = int(sizes.sum())
    if not total:
        return np.empty(0, np.int64)
    before = np.cumsum(sizes) - sizes
    return np.arange(total) + np.repeat(starts - before, sizes)


@cache
def encoder(path: str) -> Encoder:
    return Encoder(path)
