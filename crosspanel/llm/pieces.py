"""SentencePiece encoding of merge-type models by backtracking, and decoding.

The merge procedure joins, again and again, the best scored adjacent pair (leftmost on ties).  What it ends
with is the one sequence of pieces in which every two neighbours, re-merged on their own, come out as those
same two.  So a text is encoded from left to right: an Aho-Corasick pass gives the longest piece at each
place, a piece is taken when it is compatible with the one before it, else the next shorter one is tried,
and when none fits the last piece is given back and its end marked in a bitfield as failed, for good.

A character without a piece takes part as itself and becomes its UTF-8 bytes' pieces.  The procedure runs on
each word, cut where no piece of the model reaches across; a worker keeps words it has met.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, functions as F, types as T

from crosspanel.llm.base import keep_columns

SPACE = "▁"
#: Words that a worker keeps at most (beyond that it starts anew), the longest one kept, and pairs of pieces.
KEPT_WORDS, KEPT_LENGTH, KEPT_PAIRS = 400_000, 48, 1_000_000
#: Texts that are encoded at a time inside a batch.
SLICE = 256


class Kept(dict):
    """Words and their ids; a word that isn't there is encoded, and kept if it is short."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, word: str) -> tuple[int, ...]:
        ids = self.encode(word)
        if len(word) <= KEPT_LENGTH:
            if len(self) >= KEPT_WORDS:
                self.clear()
            self[word] = ids
        return ids


class PieceCoder:
    """Encoder and decoder of one merge-type model with byte fallback and no user-defined pieces."""

    def __init__(self, path: str):
        self.model = model = sentencepiece.SentencePieceProcessor(model_file=path)
        bytes_ = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        if not all(map(model.is_byte, bytes_)):
            raise ValueError("the model has no byte pieces")
        ids = range(model.get_piece_size())
        if any(map(model.is_unused, ids)):
            raise ValueError("the model has unused pieces")
        self.bytes = bytes_
        plain = [i for i in ids if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
        self.names = [model.id_to_piece(i) for i in plain]
        self.sizes = list(map(len, self.names))
        self.scores = {p: model.get_score(i) for p, i in zip(self.names, plain)}
        self.plain, self.places = plain, {p: k for k, p in enumerate(self.names)}
        self.automaton = ahocorasick.Automaton()
        for k, piece in enumerate(self.names):
            self.automaton.add_word(piece, k)
        self.automaton.make_automaton()
        #: The longest piece that a piece properly begins with; -1: none.
        self.shorter = [-1] * len(plain)
        for k, piece in enumerate(self.names[: len(plain)]):
            if len(piece) > 1:
                starts = (self.places.get(piece[:n]) for n in range(len(piece) - 1, 0, -1))
                self.shorter[k] = next((q for q in starts if q is not None), -1)
                if self.shorter[k] < 0:
                    self.shorter[k] = self.character(piece[0])
        self.words = self._splitter()
        self.forget()

    def _splitter(self):
        """Cuts a normalised text only where no piece reaches across, so that its parts are encoded on their own.

        That is before a space mark, at line breaks and tabs that no piece holds, and between letters and
        others, as far as the pieces at hand bear each rule out.
        """
        if any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.names):
            return re.compile(r"[\s\S]+").findall
        alone = "".join(c for c in "\n\r\t" if not any(c in p for p in self.names))
        marks = SPACE + re.escape(alone)
        figures = "".join({c for p in self.names for c in p if re.match(r"[^\W\d_]", c) and not c.isalpha()})
        letter, other = f"[^\\W\\d_{marks}{figures}]", f"[\\W\\d_{figures}]"
        other = f"(?:(?![{marks}]){other})"
        parts = f"{SPACE}*(?:{letter}+|{other}+)|{SPACE}+"
        if any(re.search(f"{letter}{other}|{other}{letter}", p) for p in self.names):
            parts = f"{SPACE}*[^{marks}]+|{SPACE}+"
        return re.compile((f"[{re.escape(alone)}]|" if alone else "") + parts).findall

    def forget(self) -> None:
        self.kept = Kept(self.word_ids)
        self.pairs: dict[int, bool] = {}

    def merge(self, text: str) -> list[str]:
        """The merge procedure itself, for short texts: best score first, leftmost on ties."""
        parts, scores = list(text), self.scores
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = scores.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def character(self, text: str) -> int:
        """The place in ``names`` of a character that has no piece; it is listed there when first met."""
        found = self.places.get(text)
        if found is None:
            found = self.places[text] = len(self.names)
            self.names.append(text)
            self.sizes.append(1)
            self.shorter.append(-1)
        return found

    def compatible(self, left: int, right: int) -> bool:
        """Whether re-merging the two gives them back.  Left of -1: whether the right one merges to itself."""
        ends = [self.names[p] for p in (left, right) if p >= 0]
        return self.merge("".join(ends)) == ends

    def pieces(self, text: str) -> list[int]:
        """The pieces of a normalised text, as places in ``names``, by backtracking."""
        size, sizes, pairs, shorter = len(text), self.sizes, self.pairs, self.shorter
        longest = [-1] * size
        for end, piece in self.automaton.iter(text):
            # Ends rise, so the last match that starts at a place is its longest.
            longest[end - sizes[piece] + 1] = piece
        failed = bytearray(size // 8 + 1)
        taken: list[int] = []
        at, last = 0, -1
        while at < size:
            piece = longest[at]
            if piece < 0:
                piece = self.character(text[at])
            while True:
                end = at + sizes[piece]
                if not failed[end >> 3] >> (end & 7) & 1:
                    key = (last + 1) << 21 | piece
                    fits = pairs.get(key)
                    if fits is None:
                        if len(pairs) >= KEPT_PAIRS:
                            pairs.clear()
                        fits = pairs[key] = self.compatible(last, piece)
                    if fits:
                        taken.append(piece)
                        at, last = end, piece
                        break
                piece = shorter[piece]
                if piece < 0:
                    # Nothing fits here: the last piece is given back, and a shorter one is tried in its place.
                    failed[at >> 3] |= 1 << (at & 7)
                    piece = taken.pop()
                    at -= sizes[piece]
                    last = taken[-1] if taken else -1
        return taken

    def word_ids(self, word: str) -> tuple[int, ...]:
        out: list[int] = []
        for piece in self.pieces(word):
            if piece < len(self.plain):
                out.append(self.plain[piece])
            else:
                out.extend(self.bytes[b] for b in self.names[piece].encode())
        return tuple(out)

    def encode(self, texts: list[str]) -> list[list[int]]:
        look = self.kept.__getitem__
        return [list(chain.from_iterable(map(look, self.words(t)))) for t in self.model.normalize(texts)] if texts else []

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.model.decode(ids) if ids else []


@cache
def coder(path: str) -> PieceCoder:
    return PieceCoder(path)


def _sliced(batches: Iterator[pa.RecordBatch], column: str, convert) -> Iterator[pa.RecordBatch]:
    """Each batch with ``column`` replaced by what ``convert`` makes of it (name, array), a slice at a time."""
    for whole in batches:
        for start in range(0, whole.num_rows, SLICE):
            batch = whole.slice(start, SLICE)
            rest = [n for n in batch.schema.names if n != column]
            name, values = convert(batch.column(column))
            yield pa.RecordBatch.from_arrays([*map(batch.column, rest), values], [*rest, name])


def _lists(column: pa.ListArray) -> list[list[int]]:
    at = np.asarray(column.offsets).tolist()
    flat = column.values.to_numpy(zero_copy_only=False)
    return [flat[i:j].tolist() for i, j in zip(at, at[1:])]


def encode_texts(docs: DataFrame, path: str) -> DataFrame:
    """(doc, ids): every row of ``docs`` as a struct, and the ids of its whole column ``text``.

    Equal to the library's encode without begin, end or sampling.  A null or empty text has no ids; a text
    without spaces is one word and is encoded whole; repeated rows stay; an empty table gives no rows; other
    columns, whatever their names, are inside ``doc``.
    """
    rows = keep_columns(docs, "doc").withColumn("text", F.coalesce("doc.text", F.lit("")))
    schema = T.StructType([rows.schema["doc"], T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def run(batches):
        def convert(texts: pa.Array):
            return "ids", pa.array(coder(path).encode(texts.to_pylist()), pa.list_(pa.int32()))

        return _sliced(batches, "text", convert)

    return rows.mapInArrow(run, schema)


def decode_ids(rows: DataFrame, path: str) -> DataFrame:
    """(row, text): every row as a struct, and the text that its column ``ids`` decodes to.

    Equal to the library's decode.  Null or no ids give an empty text; ids outside of the model raise.
    """
    kept = keep_columns(rows, "row").withColumn("ids", F.coalesce("row.ids", F.array().cast("array<int>")))
    schema = T.StructType([kept.schema["row"], T.StructField("text", T.StringType())])

    def run(batches):
        return _sliced(batches, "ids", lambda ids: ("text", pa.array(coder(path).decode(_lists(ids)), pa.string())))

    return kept.mapInArrow(run, schema)
