"""Operator 11: whitening of embeddings from exact, bit-sliced cross-products.

Every entry ``c`` becomes the integer ``floor(64 * c) + 1000000``. The fit
list holds each distinct integer vector once. Its entries, shifted to begin
at 0 in every dimension, are cut into bit planes: one bit of one dimension
over many rows, packed into 64-bit words. For two planes of bits ``a`` and
``b`` the population count of their AND, weighted by ``2 ** (a + b)``, is
their share of the two dimensions' sum of products, so a task only counts
bits and Spark only adds up counts. A shift changes no covariance. Counts
are joined and centred as whole numbers (``n * sum(xy) - sum(x) * sum(y)``),
and only the centred matrix, divided once by ``n * n``, is rounded to double
before the eigenvectors are taken.

Tasks hold one batch of planes and ``dims ** 2`` counters for each weight;
the driver receives the same counters once, whatever the number of rows.

Defined cases. A null vector, or one with a null or non-finite entry, is
dropped. So is a vector whose length is not ``dims`` (by default the most
common length of whole vectors, the greater of equally common ones), as it
has no place in the space. Integers beyond a long's range end at about its
bounds; a deviation of more than 38 digits is null. Repeated rows each get their rows; a null id stays null. A direction
without variance (an eigenvalue under 1e-12 of the greatest) is no component:
an empty table, or a single distinct vector, gives no rows. Other columns
of the input are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starlens.llm.scratch import Scratch

# Fixed values of the integer form.
SCALE, OFFSET = 64, 1_000_000
BOUND = 9.2e18  # inside a long with room for the offset
DIGITS = 10 ** 38  # bound of a decimal
NO_VARIANCE = 1e-12
ROWS = 8192  # of a batch of planes


@dataclass
class Whitening:
    """``n`` distinct vectors, shift ``low`` and sums ``total`` of the shifted entries (exact); projection (dims, k)."""

    n: int
    low: list[int]
    total: list[int]
    bits: list[int]
    projection: np.ndarray
    explained: list[float]
    identity_error: float

    @property
    def dims(self) -> int:
        return len(self.low)


def whole(vec_col: str) -> Column:
    """Whether a vector and all its entries are there and finite."""
    return F.coalesce(F.forall(vec_col, lambda c: c.isNotNull() & (F.abs(c) < F.lit(float("inf")))), F.lit(False))


def common_length(vectors: DataFrame, vec_col: str) -> int:
    found = (vectors.where(whole(vec_col)).groupBy(F.size(vec_col).alias("k")).agg(F.count(F.lit(1)).alias("n"))
             .orderBy(F.desc("n"), F.desc("k")).limit(1).collect())
    return found[0]["k"] if found else 0


def integers(column: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the whole vectors of length ``dims`` in a list column, and their integers (rows, dims)."""
    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # null entries become NaN
    rows = np.flatnonzero((lengths == dims) & column.is_valid().to_numpy(zero_copy_only=False))
    starts = (np.cumsum(lengths) - lengths)[rows]
    x = values[starts[:, None] + np.arange(dims)]
    good = np.isfinite(x).all(axis=1)
    x = np.clip(np.floor(x[good] * SCALE), -BOUND, BOUND).astype(np.int64) + OFFSET
    return rows[good], x


def as_binary(x: np.ndarray) -> pa.Array:
    """Each row's little-endian longs as one binary value."""
    n, width = x.shape[0], x.shape[1] * 8
    offsets = np.arange(n + 1, dtype=np.int32) * np.int32(width)
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(x, "<i8"))])


def from_binary(column: pa.Array, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<i8").reshape(-1, dims)


def fit_list(vectors: DataFrame, vec_col: str, dims: int) -> DataFrame:
    """Each distinct integer vector once, as binary ``x``; repeats are dropped before the shuffle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([as_binary(integers(batch.column(0), dims)[1])], names=["x"])

    return vectors.select(vec_col).mapInArrow(run, "x binary").distinct()


def ranges(fitted: DataFrame, dims: int) -> tuple[int, list[int], list[int]]:
    """Number of vectors, and the least and greatest integer of every dimension."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, low, high = 0, None, None
        for batch in batches:
            if batch.num_rows:
                x = from_binary(batch.column(0), dims)
                n += len(x)
                low = x.min(axis=0) if low is None else np.minimum(low, x.min(axis=0))
                high = x.max(axis=0) if high is None else np.maximum(high, x.max(axis=0))
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(dims)), pa.array([n] * dims), pa.array(low), pa.array(high)],
                                             names=["d", "n", "low", "high"])

    parts = fitted.mapInArrow(run, "d long, n long, low long, high long")
    rows = sorted(parts.groupBy("d").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")).collect())
    return (rows[0]["n"] if rows else 0), [r["low"] for r in rows], [r["high"] for r in rows]


def planes(x: np.ndarray, low: np.ndarray, dim: np.ndarray, bit: np.ndarray) -> np.ndarray:
    """(planes, words): bit ``bit[p]`` of dimension ``dim[p]`` of all rows, 64 rows to a word."""
    shifted = x.view(np.uint64) - low.view(np.uint64)  # unsigned, so right over the whole range of a long
    cut = ((shifted[:, dim] >> bit.astype(np.uint64)) & np.uint64(1)).astype(np.uint8)
    packed = np.packbits(cut.T, axis=1)
    return np.pad(packed, ((0, 0), (0, -packed.shape[1] % 8))).view(np.uint64)


def plane_counts(fitted: DataFrame, low: list[int], bits: list[int]) -> DataFrame:
    """``(i, j, s, n)``: rows whose bits of dimensions i <= j are both set, for bits that add up to s.

    ``j`` of -1 counts the set bits ``s`` of dimension ``i`` alone.
    """
    dims = len(low)
    dim = np.repeat(np.arange(dims), bits)
    bit = np.concatenate([np.arange(b) for b in bits]) if dims else np.zeros(0, int)
    shift = np.array(low, np.int64)
    weights = max(1, 2 * max(bits, default=0) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = np.zeros((dims, dims, weights), np.int64)
        alone = np.zeros((dims, weights), np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                p = planes(from_binary(batch.column(0).slice(at, ROWS), dims), shift, dim, bit)
                for q in range(len(p)):
                    n = np.bitwise_count(p[q] & p[q:]).sum(axis=1, dtype=np.int64)
                    alone[dim[q], bit[q]] += n[0]
                    n[1:][dim[q + 1:] == dim[q]] *= 2  # the two orders of unlike bits of one dimension
                    both[dim[q], dim[q:], bit[q] + bit[q:]] += n
        i, j, s = np.nonzero(both)
        k, t = np.nonzero(alone)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([i, k])), pa.array(np.concatenate([j, np.full(len(k), -1)])),
             pa.array(np.concatenate([s, t])), pa.array(np.concatenate([both[i, j, s], alone[k, t]]))],
            names=["i", "j", "s", "n"])

    counts = fitted.mapInArrow(run, "i long, j long, s long, n long")
    return counts.groupBy("i", "j", "s").agg(F.sum("n").alias("n"))


def covariance(n: int, total: list[int], products: dict[tuple[int, int], int]) -> np.ndarray:
    """Centred in whole numbers, then rounded once."""
    v = np.zeros((len(total), len(total)))
    for i, a in enumerate(total):
        for j in range(i, len(total)):
            v[i, j] = v[j, i] = (n * products.get((i, j), 0) - a * total[j]) / (n * n)
    return v


def fit(vectors: DataFrame, scratch: Scratch, vec_col: str = "embedding", components: int = 16,
        dims: int | None = None) -> Whitening | None:
    """Learn the components; None if no vector is whole."""
    dims = common_length(vectors, vec_col) if dims is None else dims
    if not dims:
        return None
    fitted = scratch.save(fit_list(vectors, vec_col, dims), "fit")
    n, low, high = ranges(fitted, dims)
    if not n:
        return None
    bits = [(b - a).bit_length() for a, b in zip(low, high)]
    counts = plane_counts(fitted, low, bits).toArrow()
    scratch.drop("fit")
    total, products = [0] * dims, {}
    for i, j, s, k in zip(*(counts.column(c).to_pylist() for c in ("i", "j", "s", "n"))):
        if j < 0:
            total[i] += k << s
        else:
            products[i, j] = products.get((i, j), 0) + (k << s)
    v = covariance(n, total, products)
    e, vectors_ = np.linalg.eigh(v)
    order = np.argsort(-e, kind="stable")[:components]
    order = order[(e[order] > 0) & (e[order] > NO_VARIANCE * e.max())]
    kept = vectors_[:, order]
    kept = kept * np.where(kept[np.abs(kept).argmax(axis=0), np.arange(len(order))] < 0, -1.0, 1.0)
    projection = kept / np.sqrt(e[order])
    error = float(np.abs(projection.T @ v @ projection - np.eye(len(order))).max()) if len(order) else 0.0
    return Whitening(n, low, total, bits, projection, [float(x / np.trace(v)) for x in e[order]], error)


def centred(model: Whitening, x: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """``x`` minus the mean as double (rows, dims), and each row's exact sum of ``(n * x - sum) ** 2``.

    In longs where every step fits one, else in whole numbers of any length.
    """
    ends = [(int(v), low) for row in (x.min(axis=0), x.max(axis=0)) for v, low in zip(row, model.low)] if len(x) else []
    bits = max([abs(v - low).bit_length() for v, low in ends] + model.bits) + model.n.bit_length() + 1
    kind = np.int64 if bits <= 62 else object
    d = (x.astype(kind) - np.array(model.low, kind)) * model.n - np.array(model.total, kind)
    offsets = (d / model.n).astype(np.float64)
    if 2 * bits + model.dims.bit_length() > 62:
        d = d.astype(object)
    return offsets, [int(k) for k in (d * d).sum(axis=1)]


def transform(vectors: DataFrame, model: Whitening | None, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """A row for every whole vector and component: the whitened value and the exact deviation."""
    id_type = vectors.schema[id_col].dataType.simpleString()
    k = 0 if model is None else model.projection.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, x = integers(batch.column(1), model.dims)
            offsets, deviation = centred(model, x)
            white = offsets @ model.projection
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows)), pa.array([Decimal(v) if v < DIGITS else None for v in deviation], pa.decimal128(38, 0)),
                 pa.ListArray.from_arrays(np.arange(len(rows) + 1, dtype=np.int32) * np.int32(k), white.ravel())],
                names=["id", "deviation", "w"])

    source = vectors.select(F.col(id_col).alias("id"), vec_col)
    if k:
        rows = source.mapInArrow(run, f"id {id_type}, deviation decimal(38,0), w array<double>")
    else:
        rows = source.where(F.lit(False)).select("id", F.lit(0).cast("decimal(38,0)").alias("deviation"),
                                                 F.array().cast("array<double>").alias("w"))
    explained = F.lit(model.explained if k else []).cast("array<double>")
    return (rows.select("id", "deviation", F.posexplode("w").alias("at", "whitened"))
            .select(F.col("id").alias(id_col), (F.col("at") + 1).alias("component"),
                    F.lit(model.n if k else 0).cast("long").alias("n"), "deviation", "whitened",
                    F.get(explained, F.col("at")).alias("explained"),
                    F.lit(model.identity_error if k else 0.0).alias("identity_error")))
