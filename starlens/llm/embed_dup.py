"""Operator 10: near-duplicate vectors by an epsilon grid order join.

Unit vectors with cosine ``c`` are ``sqrt(2 - 2c)`` apart; that is epsilon.
Vectors are projected on the leading principal axes of all vectors, put in
cells of width epsilon along each axis and sorted by label and cells (grid
order). The length of what the axes leave over is one more coordinate. The
sequence is cut into blocks with a bounding box on these coordinates; a
projection never lengthens a distance, so blocks whose boxes are more than
epsilon apart hold no pair and are skipped. Blocks that share a
neighbourhood of leading cells are joined; within two blocks the join goes
on recursively on halves down to short runs, where vectors whose coordinates
alone are more than epsilon apart are skipped one by one. Only the others'
whole products are taken.

Equal vectors are one class first. Blocks have a bounded number of vectors
however common a cell is, and the pairs of a dense block come back as counts
and a spanning forest, never as rows. The driver sees one matrix of
dimension squared for each length of vector.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starlens.llm.components import components
from starlens.llm.scratch import Scratch

AXES, BLOCK, LEAF, FAN = 6, 256, 64, 16
SLACK = 1e-9


def unit_rows(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length one in double precision (first by their largest part, against overflow)."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Valid vectors as bytes of doubles with a digest; others are left out."""
    for batch in batches:
        rows = []
        for vec_id, label, v in zip(batch.column("vec_id").to_pylist(), batch.column("label").to_pylist(), batch.column("v")):
            v = v.as_py()
            if label is None or not v or None in v:
                continue
            x = np.array(v, float)
            if np.isfinite(x).all() and x.any():
                x = x + 0.0  # -0 is 0
                rows.append((vec_id, label, len(x), hashlib.md5(x.tobytes()).digest(), x.tobytes()))
        cols = list(zip(*rows)) or [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int64(), pa.string(), pa.int32(), pa.binary(), pa.binary()])],
                                         names=["vec_id", "label", "dim", "digest", "data"])


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of 1, x and x x' over the task's unit vectors, a row for each length."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        dims = batch.column("dim").to_numpy(zero_copy_only=False)
        for d in np.unique(dims):
            part = batch.filter(pa.array(dims == d)).column("data").to_pylist()
            x = unit_rows(np.frombuffer(b"".join(part)).reshape(-1, d))
            x = np.concatenate([np.ones((len(x), 1)), x], axis=1)
            total[int(d)] = total.get(int(d), 0.0) + x.T @ x
    yield pa.RecordBatch.from_arrays(
        [pa.array(list(total), pa.int32()), pa.array([m.ravel().tolist() for m in total.values()], pa.list_(pa.float64()))],
        names=["dim", "m"])


def principal_axes(vectors: DataFrame, axes: int) -> dict[int, np.ndarray]:
    """Leading orthonormal axes for each length of vector, from all vectors."""
    sums = (vectors.select("dim", "data").mapInArrow(_moments, "dim int, m array<double>")
            .select("dim", F.posexplode("m").alias("i", "x")).groupBy("dim", "i").agg(F.sum("x").alias("x"))
            .groupBy("dim").agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("m")).collect())
    out = {}
    for row in sums:
        d = row["dim"]
        m = np.array([e["x"] for e in row["m"]]).reshape(d + 1, d + 1)
        mean = m[0, 1:] / m[0, 0]
        _, v = np.linalg.eigh(m[1:, 1:] / m[0, 0] - np.outer(mean, mean))
        out[d] = np.ascontiguousarray(v[:, ::-1][:, :axes])
    return out


def _project(axes: dict[int, np.ndarray], eps: float, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy(zero_copy_only=False)
            y = np.zeros((batch.num_rows, k + 1))
            data = batch.column("data").to_pylist()
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                x = unit_rows(np.frombuffer(b"".join(data[i] for i in at)).reshape(-1, d))
                y[at, :min(d, k)] = x @ axes[int(d)]
            y[:, k] = np.sqrt(np.maximum(0.0, 1.0 - (y[:, :k] ** 2).sum(axis=1)))  # length of the rest
            cells = np.floor(y[:, :k] / eps).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([r.tobytes() for r in y], pa.binary()), *[pa.array(cells[:, i]) for i in range(k)]],
                names=[*batch.schema.names, "y", *[f"c{i}" for i in range(k)]])

    return run


def _cut(k: int, block: int):
    """Rows in grid order to blocks of at most ``block`` vectors of one label and length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held: list[tuple] = []
        out: list[tuple] = []

        def close() -> None:
            nonlocal number, held
            if held:
                y = np.frombuffer(b"".join(r[5] for r in held)).reshape(-1, k + 1)
                cells = sorted({r[6] for r in held})
                out.append((number, held[0][0], held[0][1], y.min(axis=0).tolist(), y.max(axis=0).tolist(), len(held),
                            [{"x": a, "y": b} for a, b in cells], np.array([r[2] for r in held], np.int64).tobytes(),
                            np.array([r[3] for r in held], np.int64).tobytes(), y.tobytes(), b"".join(r[4] for r in held)))
                number, held = number + 1, []

        cell = pa.struct([("x", pa.int32()), ("y", pa.int32())])
        types = [pa.int64(), pa.string(), pa.int32(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.int32(),
                 pa.list_(cell), pa.binary(), pa.binary(), pa.binary(), pa.binary()]

        def table() -> pa.RecordBatch:
            nonlocal out
            cols = list(zip(*out)) or [()] * len(types)
            out = []
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)],
                                              names=[f.split()[0] for f in BLOCKS.split(", ")])

        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("label", "dim", "rep", "copies", "data", "y", "c0", "c1")]
            for label, dim, rep, copies, data, y, c0, c1 in zip(*cols):
                if held and (len(held) == block or held[-1][:2] != (label, dim)):
                    close()
                held.append((label, dim, rep, copies, data, y, (c0, c1)))
            if len(out) >= 32:
                yield table()
        close()
        yield table()

    return run


BLOCKS = ("block long, label string, dim int, lo array<double>, hi array<double>, n int, "
          "cells array<struct<x:int,y:int>>, reps binary, copies binary, y binary, data binary")


class _Side:
    def __init__(self, row: dict):
        self.block = row["block"]
        self.reps, self.copies = np.frombuffer(row["reps"], np.int64), np.frombuffer(row["copies"], np.int64)
        self.x = unit_rows(np.frombuffer(row["data"]).reshape(-1, row["dim"]))
        self.y = np.frombuffer(row["y"]).reshape(len(self.reps), -1)
        self.boxes: dict[tuple[int, int], tuple] = {}

    def box(self, a: int, b: int) -> tuple:
        if (a, b) not in self.boxes:
            self.boxes[a, b] = (self.y[a:b].min(axis=0), self.y[a:b].max(axis=0))
        return self.boxes[a, b]


def near_pairs(y: np.ndarray, z: np.ndarray, eps2: float) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the pairs that their leading coordinates do not keep apart."""
    apart = (y * y).sum(axis=1)[:, None] + (z * z).sum(axis=1) - 2 * y @ z.T
    return np.nonzero(apart <= eps2 + SLACK)


def join_blocks(p: _Side, q: _Side, cosine: float, eps2: float) -> np.ndarray:
    """The matrix of links between two blocks, by recursion on sequence halves."""
    found = np.zeros((len(p.reps), len(q.reps)), bool)
    todo = [(0, len(p.reps), 0, len(q.reps))]
    while todo:
        a, b, c, d = todo.pop()
        (lo, hi), (lo2, hi2) = p.box(a, b), q.box(c, d)
        gap = np.maximum(0.0, np.maximum(lo2 - hi, lo - hi2))
        if gap @ gap > eps2:
            continue
        if b - a <= LEAF and d - c <= LEAF:
            i, j = near_pairs(p.y[a:b], q.y[c:d], eps2)
            if len(i) * 4 > (b - a) * (d - c):  # most may be links: one product of the runs is cheaper
                found[a:b, c:d] = p.x[a:b] @ q.x[c:d].T >= cosine
            else:
                found[a + i, c + j] = np.einsum("ij,ij->i", p.x[a + i], q.x[c + j]) >= cosine
        elif b - a >= d - c:
            todo += [(a, (a + b) // 2, c, d), ((a + b) // 2, b, c, d)]
        else:
            todo += [(a, b, c, (c + d) // 2), (a, b, (c + d) // 2, d)]
    return found


def forest(found: np.ndarray, p: np.ndarray, q: np.ndarray) -> list[tuple[int, int]]:
    """Edges from each linked node to the smallest node of its component within the matrix."""
    big = np.iinfo(np.int64).max
    a, b = p.copy(), q.copy()
    while True:
        a2 = np.minimum(a, np.where(found, b[None, :], big).min(axis=1, initial=big))
        b2 = np.minimum(b, np.where(found, a2[:, None], big).min(axis=0, initial=big))
        if (a2 == a).all() and (b2 == b).all():
            break
        a, b = a2, b2
    return [(int(x), int(y)) for x, y in {*zip(p, a), *zip(q, b)} if x != y]


def _compare(cosine: float, eps2: float):
    """Rows (task, side, block) sorted by task and side to link counts and forest edges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, left = None, None
        for batch in batches:
            out: list[tuple] = []
            for row in batch.to_pylist():
                if row["task"] != now:
                    now, left = row["task"], _Side(row)
                    continue
                other = _Side(row)
                found = join_blocks(left, other, cosine, eps2)
                if left.block == other.block:
                    np.fill_diagonal(found, False)
                if not found.any():
                    continue
                counts = [(left.reps, found @ other.copies)]
                if left.block != other.block:
                    counts.append((other.reps, left.copies @ found))
                for reps, n in counts:
                    out += [(int(reps[i]), None, int(n[i])) for i in np.flatnonzero(n)]
                out += [(x, y, 0) for x, y in forest(found, left.reps, other.reps)]
            cols = list(zip(*out)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["a", "b", "links"])

    return run


def near_vectors(vectors: DataFrame, scratch: Scratch, id_col: str = "vec_id", vec_col: str = "embedding",
                 label_col: str = "label", cosine: float = 0.98, axes: int = AXES, block: int = BLOCK) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row.

    Rows of equal, non-null label and equal length are linked at cosine
    ``>= cosine``. A vector that is null, empty, zero, or holds a null or a
    non-finite component is linked with nothing. Repeated rows are vectors
    of their own (linked with each other); rows of one id with different
    vectors are one node. A null id is returned with a null component and
    not kept; its row counts as a link of others and joins them, but names
    no component. An empty table gives an empty table.
    """
    eps = float(np.sqrt(2 - 2 * cosine))
    # the node of a class without an id: above every id, so no component is named by it
    no_id = F.lit((1 << 63) - 1) - F.pmod(F.xxhash64("label", "dim", "digest"), F.lit(1 << 61))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"),
                          F.col(vec_col).cast("array<double>").alias("v"))
    valid = scratch.save(rows.mapInArrow(_read, "vec_id long, label string, dim int, digest binary, data binary"), "valid")
    classes = scratch.save(valid.groupBy("label", "dim", "digest").agg(
        F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("copies")).withColumn("rep", F.coalesce("first", no_id)), "classes")
    a, b = valid.alias("a"), classes.alias("b")
    same = F.col("a.vec_id").eqNullSafe(F.col("b.first"))
    for c in ("label", "dim", "digest"):
        same = same & (F.col(f"a.{c}") == F.col(f"b.{c}"))
    distinct = (a.join(b, same).select("b.label", "b.dim", "b.digest", "rep", "copies", "data")
                .dropDuplicates(["label", "dim", "digest"]).drop("digest"))
    basis = principal_axes(valid, axes)
    cells = [f"c{i}" for i in range(axes)]
    schema = "label string, dim int, rep long, copies long, data binary, y binary, " + ", ".join(f"{c} int" for c in cells)
    placed = distinct.mapInArrow(_project(basis, eps, axes), schema)
    blocks = scratch.save(placed.repartitionByRange("label", "dim", *cells, "rep")
                          .sortWithinPartitions("label", "dim", *cells, "rep").mapInArrow(_cut(axes, block), BLOCKS), "blocks")

    # block pairs: leading cells within one step, boxes within epsilon
    spots = blocks.select("block", "label", "dim", "lo", "hi", F.explode("cells").alias("c"))
    step = F.array(*[F.lit(i) for i in (-1, 0, 1)])
    near = spots.withColumn("x", F.explode(step)).withColumn("y", F.explode(step)).select(
        F.col("block").alias("a"), "label", "dim", F.col("lo").alias("lo_a"), F.col("hi").alias("hi_a"),
        (F.col("c.x") + F.col("x")).alias("x"), (F.col("c.y") + F.col("y")).alias("y"))
    there = spots.select(F.col("block").alias("b"), "label", "dim", "lo", "hi", F.col("c.x").alias("x"), F.col("c.y").alias("y"))
    gap2 = sum((F.pow(F.greatest(F.lit(0.0), F.col("lo")[i] - F.col("hi_a")[i], F.col("lo_a")[i] - F.col("hi")[i]), 2)
                for i in range(axes + 1)), F.lit(0.0))
    pairs = (near.join(there, ["label", "dim", "x", "y"]).where((F.col("a") <= F.col("b")) & (gap2 <= eps * eps + SLACK))
             .select("a", "b").distinct())
    pairs = scratch.save(pairs.withColumn("g", F.pmod(F.xxhash64("b"), F.lit(FAN))), "pairs")

    body = ["block", "dim", "reps", "copies", "y", "data"]
    first = pairs.select("a", "g").distinct().join(blocks, F.col("a") == F.col("block")).select("a", "g", F.lit(0).alias("side"), *body)
    rest = pairs.join(blocks, F.col("b") == F.col("block")).select("a", "g", F.lit(1).alias("side"), *body)
    tasks = (first.union(rest).withColumn("task", F.xxhash64("a", "g")).drop("a", "g")
             .repartition("task").sortWithinPartitions("task", "side"))
    links = scratch.save(tasks.mapInArrow(_compare(cosine, eps * eps + SLACK), "a long, b long, links long"), "links")
    joined = components(links.where(F.col("b").isNotNull()), "a", "b", scratch)
    counted = links.where(F.col("b").isNull()).groupBy("a").agg(F.sum("links").alias("others"))

    per_class = (classes.join(counted, classes["rep"] == counted["a"], "left").join(joined, classes["rep"] == joined["node"], "left")
                 .select("label", "dim", "digest", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("links"),
                         F.coalesce("component", "rep").alias("component")))
    linked = valid.select("vec_id", "label", "dim", "digest").join(per_class, ["label", "dim", "digest"], "left").select(
        "vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    invalid = rows.where(~_is_valid("v", "label")).select("vec_id", F.lit(0).cast("long").alias("n_links"),
                                                         F.col("vec_id").alias("component_id"))
    return linked.union(invalid).select(
        "vec_id", "n_links", F.when(F.col("vec_id").isNotNull(), F.col("component_id")).alias("component_id"),
        F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def _is_valid(v: str, label: str):
    """The rows that :func:`_read` keeps, as a column."""
    finite = F.forall(F.col(v), lambda e: F.coalesce(~F.isnan(e) & (F.abs(e) < float("inf")), F.lit(False)))
    some = F.exists(F.col(v), lambda e: F.coalesce(e != 0, F.lit(False)))
    return F.coalesce(F.col(label).isNotNull() & F.col(v).isNotNull() & finite & some, F.lit(False))
