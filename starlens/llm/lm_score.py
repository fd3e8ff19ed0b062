"""Operator 6: probability of a text under a subword lattice.

A word's lattice holds every segmentation into pieces of an existing
vocabulary. Pieces are weighted by their counts in the training words plus
a prior from the vocabulary's own scores; a forward recursion in log space
sums all segmentations. A training word is one more arc over its whole
lattice, weighted by its discounted count; what the discounts free goes to
the pieces. Word probabilities, with the end of text as one more token, sum
to one.

Scale: the counts of words grow with the corpus, so no task holds them all.
Texts are dealt into chunks of about ``chunk_bytes``; a chunk's distinct
words, some hundred thousand, are joined with the counts (one row a chunk
and word: a word found everywhere has one row a chunk, and that join splits
when skewed) and meet the chunk's texts in one task. Only the piece counts,
at most one row a piece of the vocabulary, come to the driver.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starlens.llm.scratch import Scratch, text_or_empty

SPACE = "▁"
MIX = np.uint64(0x9E3779B97F4A7C15)
DISCOUNT = 0.75
LONG_WORD = 64
LN10 = math.log(10.0)


@dataclass
class Pieces:
    """Natural-log weights of a vocabulary's pieces."""

    path: str
    text: list[str] = field(default_factory=list)
    log: np.ndarray | None = None
    end: float = 0.0

    @staticmethod
    def load(path: str, counts: dict[int, int], n_texts: int) -> Pieces:
        """Counts plus a prior of one count a piece, parted by the vocabulary's scores (ranks, hence 1/rank)."""
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        weight = np.array([0.0 if sp.is_control(i) or sp.is_unknown(i) else 1.0 / (2.0 + max(0.0, -sp.get_score(i)))
                           for i in range(n)])
        weight *= n / weight.sum()
        for i, c in counts.items():
            if weight[i]:
                weight[i] += c
        total = weight.sum() + n_texts + 1
        with np.errstate(divide="ignore"):
            log = np.log(weight / total)
        text = [f"\0{sp.id_to_piece(i)}" if sp.is_byte(i) else sp.id_to_piece(i) for i in range(n)]
        starts = sum(w for w, t in zip(weight, text) if t.startswith(SPACE)) + n_texts + 1
        return Pieces(path, text, log, math.log((n_texts + 1) / starts))


class Lattice:
    """Marginal log-probabilities of words over all their segmentations."""

    def __init__(self, pieces: Pieces):
        self.log = {t: float(w) for t, w in zip(pieces.text, pieces.log) if np.isfinite(w) and t[:1] != "\0"}
        byte = {t[1:]: float(w) for t, w in zip(pieces.text, pieces.log) if t[:1] == "\0"}
        self.byte = [byte.get(f"<0x{b:02X}>", -50.0) for b in range(256)]
        self.longest = max(map(len, self.log))
        hashes = np.array([self._hash(t) for t in self.log], np.uint64)
        order = np.argsort(hashes)
        self.hashes, self.weights = hashes[order], np.array(list(self.log.values()))[order]
        self.chars: dict[int, float] = {}

    @staticmethod
    def _hash(text: str) -> int:
        h = 0
        for c in text:
            h = (h * int(MIX) + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
        return h

    def _char(self, code: int) -> float:
        """A character outside the vocabulary, as its bytes."""
        if code not in self.chars:
            self.chars[code] = sum(self.byte[b] for b in chr(code).encode("utf-8", "replace"))
        return self.chars[code]

    def one(self, word: str) -> float:
        """The forward recursion for one word."""
        text, n = SPACE + word, len(word) + 1
        alpha = [-math.inf] * (n + 1)
        alpha[0] = 0.0
        for j in range(1, n + 1):
            terms = [alpha[i] + w for i in range(max(0, j - self.longest), j)
                     if (w := self.log.get(text[i:j])) is not None]
            if text[j - 1] not in self.log:
                terms.append(alpha[j - 1] + self._char(ord(text[j - 1])))
            top = max(terms)
            alpha[j] = top + math.log(sum(math.exp(t - top) for t in terms))
        return alpha[n]

    def many(self, words: list[str]) -> np.ndarray:
        """The same recursion, words of equal length side by side."""
        out = np.empty(len(words))
        by: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            by.setdefault(len(w), []).append(i)
        for n, at in by.items():
            if n > LONG_WORD:
                for i in at:
                    out[i] = self.one(words[i])
                continue
            codes = np.frombuffer("".join(SPACE + words[i] for i in at).encode("utf-32-le", "surrogatepass"), np.uint32)
            out[at] = self._forward(codes.reshape(len(at), n + 1).T.astype(np.uint64))
        return out

    def _forward(self, codes: np.ndarray) -> np.ndarray:
        n, b = codes.shape
        alpha = np.full((n + 1, b), -np.inf)
        alpha[0] = 0.0
        for i in range(n):
            h = np.zeros(b, np.uint64)
            for j in range(i, min(n, i + self.longest)):
                h = h * MIX + codes[j] + np.uint64(1)
                at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
                hit = self.hashes[at] == h
                if j == i and not hit.all():
                    miss = ~hit
                    extra = np.array([self._char(int(c)) for c in codes[j][miss]])
                    alpha[j + 1][miss] = np.logaddexp(alpha[j + 1][miss], alpha[i][miss] + extra)
                if hit.any():
                    alpha[j + 1][hit] = np.logaddexp(alpha[j + 1][hit], alpha[i][hit] + self.weights[at[hit]])
        return alpha[n]


def _split(text: bytes) -> list[bytes]:
    return text.lower().split()  # bytes: A-Z only, and white space 20, 09-0D


def _chunk_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by chunk to (chunk, word, training count), once a chunk and word."""
    count: Counter = Counter()
    now = None

    def flush() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(count), now), pa.int32()), pa.array(list(count), pa.binary()),
             pa.array(list(count.values()), pa.int64())], names=["chunk", "word", "c"])

    for batch in batches:
        texts = batch.column("text").cast(pa.binary())
        for chunk, held, text in zip(batch.column("chunk").to_pylist(), batch.column("held_out").to_pylist(), texts):
            if chunk != now:
                if count:
                    yield flush()
                count, now = Counter(), chunk
            words = _split(text.as_py())
            if held:
                for w in words:
                    if w not in count:
                        count[w] = 0
            else:
                count.update(words)
    if count:
        yield flush()


def _piece_counts(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        total = np.zeros(sp.get_piece_size(), np.int64)
        for batch in batches:
            words = [w.decode("utf-8", "replace") for w in batch.column("word").to_pylist()]
            for ids, c in zip(sp.encode(words, num_threads=1), batch.column("c").to_pylist()):
                for i in ids:
                    total[i] += c
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], names=["piece", "c"])

    return run


def _word_logs(pieces: Pieces, n: int, v: int):
    """(word, c) to (word, c, log10 probability)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(pieces)
        for batch in batches:
            c = batch.column("c").to_numpy(zero_copy_only=False).astype(float)
            words = [w.decode("utf-8", "replace") for w in batch.column("word").to_pylist()]
            logs = lattice.many(words) if words else np.zeros(0)
            yield pa.RecordBatch.from_arrays(
                [batch.column("word"), batch.column("c"), pa.array(mixed_log10(c, logs, n, v), pa.float64())],
                names=["word", "c", "lp"])

    return run


def mixed_log10(c: np.ndarray, lattice_log: np.ndarray, n: int, v: int) -> np.ndarray:
    """log10 of the discounted count's share plus the freed share of the lattice."""
    if not n:
        return lattice_log / LN10
    share = np.maximum(c - DISCOUNT, 0.0) / n
    free = math.log(DISCOUNT * v / n)
    with np.errstate(divide="ignore"):
        return np.logaddexp(np.log(share), free + lattice_log) / LN10


SCORES = ("doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def _score_chunks(n: int, v: int, end_c: int, end_lp: float):
    """Rows sorted by chunk, its words (kind 0) before its texts (kind 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, place, cs, lps, base, known, lp = None, {}, [], [], None, None, None

        def log_base(c: np.ndarray) -> np.ndarray:
            return np.log10((c + 0.5) / (n + 0.5 * (v + 1)))

        end_base = float(log_base(np.array(float(end_c))))
        for batch in batches:
            chunks = batch.column("chunk").to_numpy(zero_copy_only=False)
            kinds = batch.column("kind").to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((np.diff(chunks) != 0) | (np.diff(kinds) != 0)) + 1
            rows = []
            for a, b in zip([0, *cuts], [*cuts, batch.num_rows]):
                if a == b:
                    continue
                part = batch.slice(a, b - a)
                if chunks[a] != now:
                    now, place, cs, lps, base = chunks[a], {}, [], [], None
                if kinds[a] == 0:
                    place.update(zip(part.column("word").to_pylist(), range(len(place), len(place) + b - a)))
                    cs.append(part.column("c").to_numpy(zero_copy_only=False))
                    lps.append(part.column("lp").to_numpy(zero_copy_only=False))
                    base = None
                    continue
                if base is None:
                    c = np.concatenate(cs).astype(float) if cs else np.zeros(0)
                    base, known, lp = log_base(c), c > 0, np.concatenate(lps) if lps else np.zeros(0)
                texts = part.column("text").cast(pa.binary())
                for doc_id, held, text in zip(part.column("doc_id").to_pylist(), part.column("held_out").to_pylist(), texts):
                    at = np.fromiter(map(place.__getitem__, _split(text.as_py())), np.int64)
                    rows.append((doc_id, held, len(at) + 1, int(known[at].sum()) + (end_c > 0), n,
                                 float(base[at].sum()) + end_base, float(lp[at].sum()) + end_lp))
            if rows:
                types = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)],
                                                 names=[f.split()[0] for f in SCORES.split(", ")])

    return run


def score_texts(docs: DataFrame, held_out, vocabulary_path: str, scratch: Scratch, id_col: str = "doc_id",
                text_col: str = "text", chunk_bytes: int = 12 << 20) -> DataFrame:
    """One row a document, as :data:`SCORES`; ``held_out`` is a boolean column expression on ``docs``.

    Learns from all rows that are not held out. Null and empty texts are
    the end token alone. Repeated rows count and are returned as often as
    they occur; null ids are kept. With nothing to learn from, N and V are
    0 and the vocabulary's prior alone scores. An empty table gives an
    empty table.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"),
                       text_or_empty(text_col).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text")).alias("b"), F.count(F.lit(1)).alias("n"),
                    F.count_if(~F.col("held_out")).alias("train")).first()
    n_texts = int(size["train"])
    n_chunks = max(1, math.ceil((size["b"] or 0) / chunk_bytes))
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_chunks)).cast("int"))

    words = (rows.repartitionById(n_chunks, "chunk").sortWithinPartitions("chunk")
             .mapInArrow(_chunk_words, "chunk int, word binary, c long"))
    pairs = scratch.save(words, "pairs")
    counts = scratch.save(pairs.groupBy("word").agg(F.sum("c").alias("c")), "counts")
    total = counts.agg(F.sum("c").alias("n"), F.count_if(F.col("c") > 0).alias("v")).first()
    n, v = int(total["n"] or 0) + n_texts, int(total["v"] or 0) + (n_texts > 0)
    used = (counts.where(F.col("c") > 0).mapInArrow(_piece_counts(vocabulary_path), "piece int, c long")
            .groupBy("piece").agg(F.sum("c").alias("c")).collect())  # at most one row a piece
    pieces = Pieces.load(vocabulary_path, {r["piece"]: r["c"] for r in used}, n_texts)
    end_lp = float(mixed_log10(np.array([float(n_texts)]), np.array([pieces.end]), n, v)[0])

    known = counts.mapInArrow(_word_logs(pieces, n, v), "word binary, c long, lp double")
    null = F.lit(None)
    lexicon = pairs.select("chunk", "word").join(known, "word").select(
        "chunk", F.lit(0).alias("kind"), "word", "c", "lp", null.cast("long").alias("doc_id"),
        null.cast("boolean").alias("held_out"), null.cast("string").alias("text"))
    texts = rows.select("chunk", F.lit(1).alias("kind"), null.cast("binary").alias("word"), null.cast("long").alias("c"),
                        null.cast("double").alias("lp"), "doc_id", "held_out", "text")
    return (lexicon.union(texts).repartitionById(n_chunks, "chunk").sortWithinPartitions("chunk", "kind")
            .mapInArrow(_score_chunks(n, v, n_texts, end_lp), SCORES))
