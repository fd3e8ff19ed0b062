"""Operator 3: harmonic packing of token sequences.

Lengths are parted into reciprocal-capacity classes: a document of class k
is longer than capacity/(k+1) and at most capacity/k long, so k of a class
fit in one bin whatever their lengths, and a bin of class k gets k whole
documents. What is longer than a sequence is cut into whole sequences and a
rest of some class. Documents under capacity/``classes`` are the last class,
filled first-come. Each task fills its own bins: nothing is shuffled, and no
task waits for another.

The room that k documents leave in a bin is filled too: with a document of
the last class where one fits, and once the open rooms add up to
``OPEN_ROOM`` sequences, with the next document, whole in the tightest room
that holds it and else cut over the largest ones. So no sequence is padded,
about one document a sequence is cut, and a task holds few bins.

When a task ends, the bins with most room are emptied into the others, and
what is left over is split into power-of-two lengths.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PIECES = ("doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
# Fixed value: the split pattern of the byte-level vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
OPEN_ROOM = 4  # sequences; bounds the bins that wait for a filling
LONG_TEXT = 1 << 18
LONG_RUN = 1 << 14  # white space of this length in a long text is encoded apart: the pattern's stack grows with a run
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"  # what ``\s`` is to both encoders


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies use, to bytes."""
    printable = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(rest)}


class Encoder:
    """Ids of a byte-level BPE ``tokenizers`` file, without tokens that a template would add.

    The file's merges are in id order, so its vocabulary is a rank table
    and the rank-based encoder gives the same ids several times faster
    (tests compare both). The file's added tokens are found in the text
    first, the leftmost and then the longest; what is between two of them
    is encoded as a text of its own.
    """

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        added = [t for t in spec.get("added_tokens", []) if t["content"]]
        if any(t.get(k) for t in added for k in ("single_word", "lstrip", "rstrip")):
            raise ValueError("added tokens must match by their contents alone")
        self.added = {t["content"]: t["id"] for t in added}
        longest = sorted(self.added, key=len, reverse=True)
        self.split = re.compile("|".join(map(re.escape, longest)) if longest else r"(?!)")
        back = byte_alphabet()
        ranks = {bytes(back[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in self.added}
        self.encoding = tiktoken.Encoding("byte-bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.cut = re.compile(r"(?<=\S)(?=[ \t\r\n])")  # white space in every definition of it
        self.run = re.compile(f"(?<![{WHITE}])[{WHITE}]{{{LONG_RUN},}}")

    def ids(self, text: str) -> np.ndarray:
        """All ids, those of added tokens too."""
        parts, at = [], 0
        for m in self.split.finditer(text):
            parts += [self._between(text[at:m.start()]), np.array([self.added[m[0]]], dtype=np.uint32)]
            at = m.end()
        if not parts:
            return self._between(text)
        return np.concatenate([*parts, self._between(text[at:])])

    def _between(self, text: str) -> np.ndarray:
        """Ids of a text without added tokens.

        A very long one goes in pieces. A long run of white space is one
        token's piece but for its last character, which the pattern leaves
        to what follows; at the end of the text it is the whole run.
        """
        if len(text) <= LONG_TEXT:
            return self._ordinary(text)
        parts, at = [], 0
        for m in self.run.finditer(text):
            end = m.end() if m.end() == len(text) else m.end() - 1
            parts += [*self._pieces(text[at:m.start()]),
                      np.array(self.encoding._encode_single_piece(text[m.start():end]), dtype=np.uint32)]
            at = end
        return np.concatenate([*parts, *self._pieces(text[at:])])

    def _pieces(self, text: str) -> Iterator[np.ndarray]:
        """Ids of a text in pieces, cut before white space where no token can cross."""
        at = 0
        while at < len(text):
            m = self.cut.search(text, at + LONG_TEXT) if at + LONG_TEXT < len(text) else None
            end = m.start() if m else len(text)
            yield self._ordinary(text[at:end])
            at = end

    def _ordinary(self, text: str) -> np.ndarray:
        return np.array(self.encoding.encode_ordinary(text), dtype=np.uint32)


class Bins:
    """The open bins of one task. A piece is (doc_id, start, ids, doc_tokens)."""

    def __init__(self, capacity: int, classes: int, first_sequence: int):
        if capacity < 1 or classes < 1:
            raise ValueError("capacity and classes must be at least 1")
        self.capacity, self.classes, self.next = capacity, classes, first_sequence
        self.open: dict[int, list] = {}  # class -> whole documents of its open bin
        self.last, self.last_len = [], 0
        self.waiting: dict[int, list] = {}  # bin number -> pieces of a bin with room
        self.rooms: list[tuple[int, int]] = []  # (room, bin number), sorted
        self.room, self.bins = 0, 0

    def _emit(self, pieces: list, out: list) -> None:
        offset = 0
        for doc_id, start, ids, total in pieces:
            out.append((doc_id, start, ids, total, self.next, offset))
            offset += len(ids)
        self.next += 1

    @staticmethod
    def _cut(piece: tuple, at: int) -> tuple[tuple, tuple]:
        doc_id, start, ids, total = piece
        return (doc_id, start, ids[:at], total), (doc_id, start + at, ids[at:], total)

    def _wait(self, pieces: list, out: list) -> None:
        """A bin with its fixed count: out if full, else it waits for a filling."""
        room = self.capacity - sum(len(p[2]) for p in pieces)
        if not room:
            self._emit(pieces, out)
            return
        self.waiting[self.bins] = pieces
        insort(self.rooms, (room, self.bins))
        self.room += room
        self.bins += 1

    def _fill(self, piece: tuple, out: list) -> tuple:
        """Put a piece in the tightest room that holds it, else in the largest ones; returns what is left."""
        while self.rooms and len(piece[2]):
            at = bisect_left(self.rooms, (len(piece[2]), -1))
            room, number = self.rooms.pop(min(at, len(self.rooms) - 1))
            now, piece = self._cut(piece, room)
            self.waiting[number].append(now)
            self.room -= len(now[2])
            if len(now[2]) == room:
                self._emit(self.waiting.pop(number), out)
            else:
                insort(self.rooms, (room - len(now[2]), number))
        return piece

    def add(self, doc_id: int | None, ids: np.ndarray, out: list) -> None:
        piece = (doc_id, 0, ids, len(ids))
        while len(piece[2]) > self.capacity:
            now, piece = self._cut(piece, self.capacity)
            self._emit([now], out)
        if len(ids) > self.capacity:
            piece = (*piece[:2], piece[2].copy(), piece[3])  # the open bins shall not hold the whole of it
        n = len(piece[2])
        if not n:
            return
        k = self.capacity // n
        small = k >= self.classes
        if self.room >= OPEN_ROOM * self.capacity or small and self.rooms and self.rooms[-1][0] >= n:
            self._fill(piece, out)
        elif small:
            self._add_last(piece, out)
        else:
            bin_ = self.open.setdefault(k, [])
            bin_.append(piece)
            if len(bin_) == k:
                self._wait(self.open.pop(k), out)

    def _add_last(self, piece: tuple, out: list) -> None:
        while len(piece[2]):
            now, piece = self._cut(piece, self.capacity - self.last_len)
            self.last.append(now)
            self.last_len += len(now[2])
            if self.last_len == self.capacity:
                self._emit(self.last, out)
                self.last, self.last_len = [], 0

    def close(self, out: list) -> None:
        """Fill the rooms from unfinished bins; the rest in sequences of power-of-two length."""
        left = [p for k in sorted(self.open) for p in self.open[k]] + self.last
        self.last, self.last_len = [], 0
        while left or self.rooms:
            for piece in left:
                self._add_last(self._fill(piece, out), out)
            left = []
            if self.rooms:
                room, number = self.rooms.pop()
                self.room -= room
                left = self.waiting.pop(number)
        for size in (1 << b for b in reversed(range(self.last_len.bit_length()))):
            if self.last_len & size:
                now, need = [], size
                while need:
                    piece, rest = self._cut(self.last.pop(0), need)
                    now.append(piece)
                    need -= len(piece[2])
                    if len(rest[2]):
                        self.last.insert(0, rest)
                self._emit(now, out)


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
         capacity: int = 2048, classes: int = 16, end_id: int = 1) -> DataFrame:
    """Pieces of all documents with their places in sequences, as :data:`PIECES`.

    ``ids`` are little-endian unsigned 32-bit ids. A document is its ids and
    ``end_id``, so null and empty texts have one token. Repeated rows and
    null ids are documents of their own. An empty table gives no piece.
    A very long text is cut into whole sequences; texts of one length fill
    bins of one class. ``sequence_id`` is the task's number in the high bits and a count in the
    low; a retried task makes the same rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(tokenizer_path)
        bins = Bins(capacity, classes, TaskContext.get().partitionId() << 36)

        def table(out: list) -> pa.RecordBatch:
            doc, start, ids, total, seq, offset = zip(*out)
            long = [pa.array(x, pa.int64()) for x in (doc, start, [len(x) for x in ids], total, seq, offset)]
            blob = pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary())
            return pa.RecordBatch.from_arrays([*long[:3], blob, *long[3:]],
                                              names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

        out: list = []
        for batch in batches:
            for doc_id, text in zip(batch.column("id"), batch.column("text")):
                ids = np.append(encoder.ids(text.as_py() or ""), np.uint32(end_id)).astype(np.uint32)
                bins.add(doc_id.as_py(), ids, out)
                if len(out) >= 4096:
                    yield table(out)
                    out = []
        bins.close(out)
        if out:
            yield table(out)

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, PIECES)


def sequences(pieces: DataFrame) -> DataFrame:
    """``sequence_id, ids``: each sequence's ids in order, as little-endian bytes (at most ``capacity`` ids)."""
    parts = F.sort_array(F.collect_list(F.struct("offset", F.hex("ids").alias("h"))))
    return (pieces.groupBy("sequence_id").agg(parts.alias("p"))
            .select("sequence_id", F.unhex(F.array_join(F.col("p.h"), "")).alias("ids")))
