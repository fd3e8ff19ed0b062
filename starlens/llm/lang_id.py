"""Operator 4: language of a text by a bidirectional gated recurrent network over bytes.

The network labels every byte position; a document's language is the one
with the largest mean probability over all its positions. Texts are cut
into windows of equal length that run side by side in numpy; the last
window of a text ends at its end, and bytes it shares with the one before
count once. Weights are trained here, by backpropagation through time, on a
bounded sample: at most ``per_lang`` documents a language (the smallest
md5 of their ids) and ``per_doc`` windows of each. The sample is the only
thing that comes to the driver. Prediction reads every byte of every text
and shuffles nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from starlens.llm.scratch import others

UND = "und"
BATCH = 2048
FOLD = 16 << 20  # bytes of text held as windows at once


@dataclass
class Model:
    """Per direction: input table (3h, 256), recurrent (3h, h), recurrent bias (h); output (k, 2h) and bias."""

    langs: list[str]
    w: list[np.ndarray]
    u: list[np.ndarray]
    c: list[np.ndarray]
    v: np.ndarray
    b: np.ndarray
    window: int

    @property
    def hidden(self) -> int:
        return self.u[0].shape[1]

    def params(self) -> list[np.ndarray]:
        return [*self.w, *self.u, *self.c, self.v, self.b]


def new_model(langs: list[str], hidden: int, window: int, seed: int) -> Model:
    g = np.random.default_rng(seed)

    def r(*shape, scale):
        return (g.standard_normal(shape) * scale).astype(np.float32)

    return Model(langs, [r(3 * hidden, 256, scale=0.3) for _ in range(2)],
                 [r(3 * hidden, hidden, scale=hidden ** -0.5) for _ in range(2)],
                 [np.zeros((hidden, 1), np.float32) for _ in range(2)],
                 r(len(langs), 2 * hidden, scale=0.3), np.zeros((len(langs), 1), np.float32), window)


def _step(x: np.ndarray, h: np.ndarray, u: np.ndarray, c: np.ndarray) -> tuple:
    """One gated step on columns: update z, reset r, candidate n."""
    k = h.shape[0]
    a = u @ h
    zr = np.tanh((x[:2 * k] + a[:2 * k]) * np.float32(0.5))
    zr *= np.float32(0.5)
    zr += np.float32(0.5)
    q = a[2 * k:]
    q += c
    n = np.tanh(x[2 * k:] + zr[k:] * q)
    return n + zr[:k] * (h - n), zr, q, n


def _run(m: Model, d: int, x: np.ndarray, order: range, out: np.ndarray, add: bool) -> None:
    """Run direction ``d`` and put its share of the logits into ``out``; all buffers are reused."""
    k, n = m.hidden, x.shape[1]
    half = np.float32(0.5)
    h, g, a = np.zeros((k, n), np.float32), np.empty((3 * k, n), np.float32), np.empty((3 * k, n), np.float32)
    logits = np.empty((len(m.langs), n), np.float32)
    zr, q, cand = g[:2 * k], a[2 * k:], g[2 * k:]
    v = np.ascontiguousarray(m.v[:, d * k:(d + 1) * k])
    for t in order:
        m.w[d].take(x[t], axis=1, out=g, mode="clip")
        np.matmul(m.u[d], h, out=a)
        zr += a[:2 * k]
        zr *= half
        np.tanh(zr, out=zr)
        zr *= half
        zr += half
        q += m.c[d]
        q *= zr[k:]
        cand += q
        np.tanh(cand, out=cand)
        h -= cand
        h *= zr[:k]
        h += cand
        np.matmul(v, h, out=logits)
        if add:
            out[t] += logits
        else:
            np.add(logits, m.b, out=out[t])


def probabilities(m: Model, x: np.ndarray) -> np.ndarray:
    """(positions, languages, windows) for bytes ``x`` of (positions, windows)."""
    steps, n = x.shape
    x = x.astype(np.intp)
    out = np.empty((steps, len(m.langs), n), np.float32)
    _run(m, 0, x, range(steps), out, add=False)
    _run(m, 1, x, range(steps - 1, -1, -1), out, add=True)
    out -= out.max(axis=1, keepdims=True)
    np.exp(out, out=out)
    out /= out.sum(axis=1, keepdims=True)
    return out


def gradients(m: Model, x: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Loss (mean over positions) and its gradients, by backpropagation through time."""
    steps, n = x.shape
    k = m.hidden
    trace, states = [], []
    for d, order in enumerate((range(steps), range(steps - 1, -1, -1))):
        h, rows, hs = np.zeros((k, n), np.float32), [], np.empty((steps, k, n), np.float32)
        for t in order:
            new, zr, q, cand = _step(m.w[d].take(x[t], axis=1), h, m.u[d], m.c[d])
            rows.append((t, h, zr, q, cand))
            h = hs[t] = new
        trace.append(rows)
        states.append(hs)
    both = np.concatenate(states, axis=1)
    logits = np.einsum("ck,tkn->tcn", m.v, both) + m.b
    logits -= logits.max(axis=1, keepdims=True)
    p = np.exp(logits)
    p /= p.sum(axis=1, keepdims=True)
    at = np.arange(n)
    loss = float(-np.log(p[:, y, at] + 1e-9).mean())
    p[:, y, at] -= 1
    p /= steps * n
    gv, gb = np.einsum("tcn,tkn->ck", p, both), p.sum(axis=(0, 2))[:, None]
    gh = np.einsum("ck,tcn->tkn", m.v, p)
    gw, gu, gc = [], [], []
    for d in range(2):
        dw, du, dc = np.zeros_like(m.w[d]), np.zeros_like(m.u[d]), np.zeros_like(m.c[d])
        back = np.zeros((k, n), np.float32)
        for t, h, zr, q, cand in reversed(trace[d]):
            g = back + gh[t, d * k:(d + 1) * k]
            z, r = zr[:k], zr[k:]
            dn = g * (1 - z) * (1 - cand * cand)
            dz = g * (h - cand) * z * (1 - z)
            dr = dn * q * r * (1 - r)
            dq = dn * r
            da = np.concatenate([dz, dr, dq])
            dx = np.concatenate([dz, dr, dn])
            du += da @ h.T
            dc += dq.sum(axis=1, keepdims=True)
            np.add.at(dw.T, x[t], dx.T)
            back = g * z + m.u[d].T @ da
        gw.append(dw)
        gu.append(du)
        gc.append(dc)
    return loss, [*gw, *gu, *gc, gv.astype(np.float32), gb.astype(np.float32)]


def fit(windows: np.ndarray, labels: np.ndarray, langs: list[str], hidden: int = 8, steps: int = 400,
        batch: int = 96, rate: float = 0.02, seed: int = 7) -> Model:
    """Adam on balanced random batches; ``windows`` is (examples, positions) of bytes."""
    g = np.random.default_rng(seed)
    m = new_model(langs, hidden, windows.shape[1], seed)
    by = [np.flatnonzero(labels == i) for i in range(len(langs))]
    first, second = [np.zeros_like(p) for p in m.params()], [np.zeros_like(p) for p in m.params()]
    for i in range(1, steps + 1):
        pick = np.concatenate([g.choice(rows, max(1, batch // len(langs))) for rows in by])
        _, grads = gradients(m, windows[pick].T, labels[pick])
        now = rate * min(1.0, 2 * (1 - i / (steps + 1)))
        for p, gr, a, b in zip(m.params(), grads, first, second):
            np.clip(gr, -1, 1, out=gr)
            a += 0.1 * (gr - a)
            b += 0.01 * (gr * gr - b)
            p -= now * (a / (1 - 0.9 ** i)) / (np.sqrt(b / (1 - 0.99 ** i)) + 1e-8)
    return m


def cut(text: bytes, window: int) -> tuple[np.ndarray, int, int]:
    """The windows of a text, and how many positions of the last one are new, and where they begin.

    A text under one window is filled up with spaces, which do not count.
    """
    n = len(text)
    if n < window:
        return np.frombuffer(text + b" " * (window - n), np.uint8)[None], n, 0
    full, rest = divmod(n, window)
    raw = np.frombuffer(text, np.uint8)
    rows = raw[:full * window].reshape(full, window)
    if not rest:
        return rows, window, 0
    return np.concatenate([rows, raw[None, n - window:]]), rest, window - rest


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))  # stops at the first letter


def predict_texts(m: Model, texts: list[str | None]) -> tuple[list[str], list[float]]:
    """Language and mean probability of each text; ``und`` and 0 for null or letterless text."""
    k = len(m.langs)
    sums, count = np.zeros((len(texts), k)), np.zeros(len(texts))
    rows, owner, weights = [], [], []
    held = 0

    def flush() -> None:
        nonlocal rows, owner, weights, held
        if not rows:
            return
        x, own, w = np.concatenate(rows), np.concatenate(owner), np.concatenate(weights)
        for a in range(0, len(x), BATCH):
            part = np.ascontiguousarray(x[a:a + BATCH].T)
            p = probabilities(m, part)
            lo, hi = w[a:a + BATCH, 0], w[a:a + BATCH, 1]
            total = p.sum(axis=0)
            for j in np.flatnonzero((lo > 0) | (hi < m.window)):
                total[:, j] = p[lo[j]:hi[j], :, j].sum(axis=0)
            np.add.at(sums, own[a:a + BATCH], total.T)
        rows, owner, weights, held = [], [], [], 0

    for i, text in enumerate(texts):
        if not has_letter(text):
            continue
        raw = text.encode("utf-8", "replace")
        count[i] = len(raw)
        span = FOLD // m.window * m.window
        for at in range(0, len(raw), span):
            x, new, start = cut(raw[at:at + span], m.window)
            w = np.tile(np.array([[0, m.window]]), (len(x), 1))
            w[-1] = (start, start + new)
            rows.append(x)
            owner.append(np.full(len(x), i))
            weights.append(w)
            held += x.size
            if held >= FOLD:
                flush()
    flush()
    best = sums.argmax(axis=1)
    langs = [m.langs[b] if c else UND for b, c in zip(best, count)]
    score = [float(min(1.0, s[b] / c)) if c else 0.0 for s, b, c in zip(sums, best, count)]
    return langs, score


def training_windows(labelled: DataFrame, id_col: str, text_col: str, lang_col: str, window: int,
                     per_lang: int, per_doc: int) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """A bounded sample: ids are ranked without their texts, then only chosen texts are cut.

    Ids with a text that is not empty are counted and ranked once for each of
    their languages. Only those whose hash lies in the share that holds about
    twice ``per_lang`` are ranked, so a common language is no large task.
    """
    rank = Window.partitionBy("lang").orderBy("order", "id")
    texts = labelled.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"),
                            F.col(text_col).cast("string").alias("text"))
    texts = texts.where(F.col("lang").isNotNull() & F.col("id").isNotNull() & (F.octet_length("text") > 0))
    ids = texts.select("id", "lang").distinct().withColumn("order", F.md5(F.col("id").cast("string")))
    counts = ids.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    place = F.conv(F.substring("order", 1, 8), 16, 10).cast("double") / (1 << 32)
    chosen = (ids.join(F.broadcast(counts), "lang").where(place * F.col("n") < 2 * per_lang + 200)
              .withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= per_lang).select("id", "lang"))
    raw = F.encode("text", "utf-8")
    room = F.greatest(F.octet_length("text") - window, F.lit(0)) + 1
    starts = [F.pmod(F.xxhash64("id", F.lit(k)), room.cast("long")).cast("int") + 1 for k in range(per_doc)]
    # at most per_lang rows a language, and the model has an output for each language
    rows = (texts.join(F.broadcast(chosen), ["id", "lang"])
            .select("id", "lang", F.array(*[F.substring(raw, s, F.lit(window)) for s in starts]).alias("w"))
            .groupBy("id", "lang").agg(F.min("w").alias("w")).collect())
    langs = sorted({r["lang"] for r in rows})
    x, y = [], []
    for r in sorted(rows, key=lambda r: (r["lang"], r["id"])):
        for w in r["w"]:
            x.append(np.frombuffer(bytes(w).ljust(window, b" "), np.uint8))
            y.append(langs.index(r["lang"]))
    return (np.stack(x) if x else np.zeros((0, window), np.uint8)), np.array(y, int), langs


def train(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          window: int = 64, per_lang: int = 600, per_doc: int = 3, **kw) -> Model | None:
    """Fit on labelled rows; None if no row has both text and language."""
    x, y, langs = training_windows(labelled, id_col, text_col, lang_col, window, per_lang, per_doc)
    return fit(x, y, langs, **kw) if len(langs) else None


def predict(docs: DataFrame, model: Model | None, text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """``docs`` (without its text, if so asked) plus ``lang_pred`` and ``score``.

    Null text and text without a letter are ``und`` with score 0, as is
    every text if there is no model. Repeated rows each get a row. Input
    columns with the two names are replaced; an empty table stays empty.
    """
    keep = others(docs, "lang_pred", "score")
    source = docs.select(*[F.col(f"`{c}`") for c in keep])
    back = [c for c in keep if keep_text or c != text_col]
    schema = StructType([*[source.schema[c] for c in back], StructField("lang_pred", StringType()), StructField("score", DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(keep.index(text_col)).to_pylist()
            if model is None:
                langs, score = [UND] * len(texts), [0.0] * len(texts)
            else:
                langs, score = predict_texts(model, texts)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(keep.index(c)) for c in back], pa.array(langs, pa.string()), pa.array(score, pa.float64())],
                names=[*back, "lang_pred", "score"])

    return source.mapInArrow(run, schema)


def with_letters(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text :func:`predict` labels if there is a model."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([has_letter(x.as_py()) for x in batch.column(at)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
