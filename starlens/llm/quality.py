"""Operator 13: quality scores from preferences between documents.

A Bradley-Terry model: a document of label 1 is preferred to one of label 0
with probability ``sigmoid(s(a) - s(b))``, where ``s`` is linear in the
features of a text, so the weights minimise the logistic loss on feature
differences. Features come from whole texts only: shares of byte classes and
of their neighbours, and how often words and lines repeat. Preference pairs
are drawn from a bounded sample of labelled documents, at most ``per_label``
of each label (the smallest md5 of their ids); its features are all that
comes to the driver.

The threshold is a quantile of scores over all labelled training documents:
the share of label 0 among them. Scores are shifted so that it lies at
``cut`` (0.3) on the scale from 0 to 1.

Defined cases. A null text is an empty one; an empty text has the features
of no evidence and a score like any other. Labels other than 0 and 1 and ids
labelled both ways are no preference. Of rows that repeat a training id one
text is learned from. Without both labels there is no pair to learn from and
every score is the share of label 1 among the labelled ids, 0.5 without any.
Repeated rows each get a row; input columns named like the results are
replaced; an empty table stays empty.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starlens.llm.scratch import Scratch

FOLD = 4 << 20  # code points of a text handled at once
SPACE = re.compile(r"\s")
PRIOR = 40  # bytes (words, lines) of no evidence: shares of short texts shrink towards 0


def byte_classes() -> np.ndarray:
    """Class of every byte: letters by case, digits, white space, kinds of marks, others."""
    kinds = np.full(256, 9, np.uint8)
    for chars, kind in ((b"abcdefghijklmnopqrstuvwxyz", 0), (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", 1), (b"0123456789", 2),
                        (b" \t", 3), (b"\n\r\v\f", 4), (b".,;:?'\"()-", 5), (b"!", 6), (b"|/\\<>=_", 7), (b"#$%&*+@[]^`{}~", 8)):
        kinds[np.frombuffer(chars, np.uint8)] = kind
    kinds[128:] = 10
    return kinds


CLASSES = byte_classes()
KINDS = 11
REACH = 20  # log odds of the sample's farthest score, so that none rounds to 0 or 1
WORD_WINDOW = 64  # words whose repeats are counted together
SIZE = KINDS + KINDS * KINDS + 4


def features(text: str | None) -> np.ndarray:
    """Shares of byte classes and class pairs, of repeated words and lines, and mean word length."""
    pairs, singles = np.zeros(KINDS * KINDS), np.zeros(KINDS)
    words = again = repeats = lines = same = letters = 0
    at, size, before, last = 0, len(text or ""), None, None
    while at < size:
        stop = SPACE.search(text, at + FOLD)
        end = stop.end() if stop else size
        part = text[at:end]
        kinds = CLASSES[np.frombuffer(part.encode("utf-8", "replace"), np.uint8)].astype(np.intp)
        singles += np.bincount(kinds, minlength=KINDS)
        pairs += np.bincount(kinds[:-1] * KINDS + kinds[1:], minlength=KINDS * KINDS)
        found = part.split()
        words += len(found)
        letters += sum(map(len, found))
        again += sum(a == b for a, b in zip(found, found[1:])) + (bool(found) and found[0] == before)
        before = found[-1] if found else before
        for i in range(0, len(found), WORD_WINDOW):
            window = found[i:i + WORD_WINDOW]
            repeats += len(window) - len(set(window))
        for line in part.split("\n"):
            same += line == last and line != ""
            lines += 1
            last = line
        at = end
    n = singles.sum()
    return np.concatenate([singles / (n + PRIOR), pairs / (n + PRIOR),
                           [again / (words + PRIOR), repeats / (words + PRIOR), same / (lines + PRIOR),
                            letters / (words + PRIOR) / 10]])


def labelled_ids(labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    """One row for every id with one valid label."""
    value = F.col(label_col).cast("double")
    ids = (labels.where(F.col(id_col).isNotNull() & value.isin(0.0, 1.0)).groupBy(F.col(id_col).alias("id"))
           .agg(F.min(value).alias("label"), F.max(value).alias("most")))
    return ids.where(F.col("label") == F.col("most")).select("id", "label")


def training_features(docs: DataFrame, ids: DataFrame, per_label: int, id_col: str, text_col: str) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the sample, in the order of the ids' hashes.

    Only ids whose hash lies in the share that holds about twice
    ``per_label`` are ranked, and ids are chosen without their texts.
    """
    present = docs.select(F.col(id_col).alias("id")).distinct()
    order = F.md5(F.col("id").cast("string"))
    ids = ids.join(present, "id", "left_semi")
    counts = {r["label"]: r["n"] for r in ids.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    place = F.conv(F.substring(order, 1, 8), 16, 10).cast("double") / (1 << 32)
    chosen = None
    for label, n in sorted(counts.items()):
        part = (ids.where((F.col("label") == label) & (place * n < 2 * per_label + 200))
                .orderBy(order, "id").limit(per_label))
        chosen = part if chosen is None else chosen.unionByName(part)
    if chosen is None:
        return np.zeros((0, SIZE)), np.zeros(0)
    # at most per_label rows a label
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id")
    schema = f"id {docs.schema[id_col].dataType.simpleString()}, label double, f array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f = np.array([features(t) for t in batch.column(2).to_pylist()]).reshape(-1, SIZE)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1),
                 pa.ListArray.from_arrays(np.arange(len(f) + 1, dtype=np.int32) * np.int32(SIZE), f.ravel())], names=["id", "label", "f"])

    found = rows.select("id", "label", "text").mapInArrow(run, schema).groupBy("id").agg(F.min("label").alias("label"), F.min("f").alias("f"))
    sample = found.orderBy(order, "id").collect()
    return np.array([r["f"] for r in sample]).reshape(-1, SIZE), np.array([r["label"] for r in sample])


def fit(x: np.ndarray, y: np.ndarray, pairs: int = 40_000, ridge: float = 1e-3, steps: int = 20, seed: int = 13) -> np.ndarray | None:
    """Newton steps on the mean logistic loss of preference pairs; None without both labels."""
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return None
    scale = x.std(axis=0) + 1e-3
    z = x / scale
    g = np.random.default_rng(seed)
    d = z[g.choice(good, pairs)] - z[g.choice(bad, pairs)]
    w = np.zeros(x.shape[1])

    def loss(v: np.ndarray) -> float:
        return float(np.logaddexp(0, -(d @ v)).mean() + ridge / 2 * v @ v)

    now = loss(w)
    for _ in range(steps):
        miss = 1 / (1 + np.exp(np.clip(d @ w, -500, 500)))
        slope = ridge * w - d.T @ miss / pairs
        bend = (d * (miss * (1 - miss))[:, None]).T @ d / pairs + ridge * np.eye(len(w))
        step, size = np.linalg.solve(bend, slope), 1.0
        while loss(w - size * step) > now and size > 1e-6:
            size /= 2
        w = w - size * step
        before, now = now, loss(w)
        if before - now < 1e-9:
            break
    return w / scale


def raw_scores(docs: DataFrame, weights: np.ndarray, text_col: str = "text", out: str = "raw") -> DataFrame:
    """``docs`` with its text replaced by the raw score; nothing is shuffled."""
    keep = [c for c in docs.columns if c not in (text_col, out)]
    source = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(text_col).cast("string").alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema if f.name != "__text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [float(features(t) @ weights) for t in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(raw, pa.float64())], names=[*keep, out])

    return source.mapInArrow(run, f"{schema}, {out} double" if keep else f"{out} double")


def quantile(values: DataFrame, col: str, share: float, levels: int = 4, bins: int = 1000) -> float | None:
    """The least bound under which ``share`` of all values lie, by counts in ever finer bins (at most ``bins`` rows a pass)."""
    ends = values.agg(F.min(col).alias("a"), F.max(col).alias("b"), F.count(col).alias("n")).first()
    if not ends["n"]:
        return None
    low, high, want = ends["a"], ends["b"], share * ends["n"]
    for _ in range(levels):
        width = (high - low) / bins
        if not width > 0:
            break
        place = F.least(F.floor((F.col(col) - low) / width), F.lit(bins - 1).cast("long"))
        inside = values.where((F.col(col) >= low) & (F.col(col) <= high))
        counts = inside.groupBy(place.alias("bin")).agg(F.count(F.lit(1)).alias("n")).orderBy("bin").collect()
        for r in counts:
            if want <= r["n"]:
                low, high = low + r["bin"] * width, low + (r["bin"] + 1) * width
                break
            want -= r["n"]
        else:
            return high
    return high


def score_documents(docs: DataFrame, labels: DataFrame, training: Column, scratch: Scratch, id_col: str = "doc_id",
                    text_col: str = "text", label_col: str = "quality", per_label: int = 4000, cut: float = 0.3,
                    keep: dict[str, Column] | None = None) -> DataFrame:
    """``(id, *keep, score, predicted)`` for every row of ``docs``.

    Labels count only for rows of ``docs`` where ``training`` holds; ``keep``
    names further columns of the result.
    """
    extra = dict(keep or {})
    ids = scratch.save(labelled_ids(labels, id_col, label_col), "labelled")
    learn = docs.where(training)
    x, y = training_features(learn, ids, per_label, id_col, text_col)
    weights = fit(x, y)
    if weights is None:
        score = F.lit(float(y.mean()) if len(y) else 0.5)
        out = docs.select(F.col(id_col), *[c.alias(n) for n, c in extra.items()], score.alias("score"))
        return out.withColumn("predicted", (F.col("score") >= cut).cast("int"))
    source = docs.select(F.col(id_col).alias("id"), training.alias("__learn"), *[c.alias(f"__{n}") for n, c in extra.items()],
                         F.col(text_col).alias("text"))
    scored = scratch.save(raw_scores(source, weights), "scored")
    known = scored.where("__learn").join(ids, "id").select("label", "raw")
    zeros = known.agg(F.avg(1 - F.col("label"))).first()[0]
    threshold = quantile(known, "raw", zeros) if zeros is not None else 0.0
    steep = 1 / max(1.0, float(np.abs(x @ weights - threshold).max()) / REACH)
    logit = float(np.log(cut / (1 - cut)))
    score = 1 / (1 + F.exp(-((F.col("raw") - threshold) * steep + logit)))
    out = scored.select(F.col("id").alias(id_col), *[F.col(f"__{n}").alias(n) for n in extra], score.alias("score"))
    return out.withColumn("predicted", (F.col("score") >= cut).cast("int"))
