"""Operator 2: near-duplicate documents by a signature-coordinate inverted join.

A document's minhash signature has ``COORDS`` coordinates. Each (coordinate,
value) pair is a posting list of documents; two documents whose shingle sets
have Jaccard similarity ``s`` collide in about ``s * COORDS`` lists. Pairs are
kept if they collide in at least ``t`` lists, ``t`` six standard deviations
below the mean at the threshold, and are then confirmed on full sets.

Prefix: a list of one document joins nothing, and a document with fewer
than ``t`` shared values has no partner. Of its ``c`` shared values only the
``c - t + 1`` rarest need be merged: a partner must be in one of those lists.
Skip: the longer lists are never merged; a candidate's other collisions are
counted on the two signatures.

Equal sets are one class before all this. Lists are not paired out: each
list names its most central document as pivot (the largest sum of list
lengths), and documents are first compared with their pivots. What is linked
to a pivot is one component; only documents not linked to it are compared
with the rest of its group, block against block, and pairs that are in one
component already are left out. No list or group meets in one task. The
links of a block are returned as a spanning forest: links that would join
what is joined already change no component.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starlens.llm.components import components
from starlens.llm.scratch import Scratch, text_or_empty

COORDS, SHINGLE, PERCENT, SIGMA, BLOCK = 128, 5, 80, 6.0, 96
REMEMBERED = 1 << 16  # digests of one id's texts held by a task; a text beyond may be compared twice
_RNG = np.random.default_rng(20240229)
POWERS = _RNG.integers(1, 1 << 63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
FACTORS = _RNG.integers(1, 1 << 63, COORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
FOLD = np.uint64(0x9E3779B97F4A7C15)


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    return h


def shingle_set(text: bytes, size: int = SHINGLE) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct ``size``-word shingles; a shorter text is one shingle, no words none."""
    words = text.lower().split()  # bytes: A-Z only, and white space 20, 09-0D
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, n)
    k = min(size, n)
    h = np.full(n - k + 1, k, np.uint64)
    for j in range(k):
        h += w[j:n - k + 1 + j] * POWERS[j]
    return np.unique(_mix(h))


def signature(shingles: np.ndarray, buffer: np.ndarray) -> np.ndarray:
    """Minimum of each coordinate's permutation, folded to 32 bits."""
    low = np.full(COORDS, np.iinfo(np.uint64).max, np.uint64)
    step = buffer.shape[1]
    for a in range(0, len(shingles), step):
        part = shingles[a:a + step]
        out = buffer[:, :len(part)]
        np.multiply(FACTORS[:, None], part[None, :], out=out)
        np.minimum(low, out.min(axis=1), out=low)
    return ((low * FOLD) >> np.uint64(32)).astype(np.uint32).view(np.int32)


def match_threshold(percent: int = PERCENT, coords: int = COORDS, sigma: float = SIGMA) -> int:
    s = percent / 100
    return max(1, math.floor(coords * s - sigma * math.sqrt(coords * s * (1 - s))))


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    buffer = np.empty((COORDS, 512), np.uint64)
    for batch in batches:
        n, digests, signatures = [], [], []
        for text in batch.column("text").cast(pa.binary()):
            s = shingle_set(text.as_py())
            n.append(len(s))
            digests.append(hashlib.md5(s.tobytes()).digest() if len(s) else None)
            signatures.append(signature(s, buffer) if len(s) else None)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(digests, pa.binary()),
             pa.array(signatures, pa.list_(pa.int32()))], names=["doc_id", "n", "digest", "sig"])


def _full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    buffer = np.empty((COORDS, 512), np.uint64)
    last, met = None, set()
    for batch in batches:
        sets, taken = [], []
        for i, (rep, text) in enumerate(zip(batch.column("rep").to_pylist(), batch.column("text").cast(pa.binary()))):
            s = shingle_set(text.as_py())
            if rep != last:
                last, met = rep, set()
            key = hashlib.md5(s.tobytes()).digest()
            if key not in met:  # rows that repeat an id come one after the other
                if len(met) == REMEMBERED:
                    met.clear()
                met.add(key)
                taken.append(i)
                sets.append(s)
        yield pa.RecordBatch.from_arrays(
            [batch.column("rep").take(pa.array(taken, pa.int64())), pa.array([len(s) for s in sets], pa.int64()),
             pa.array([signature(s, buffer) for s in sets], pa.list_(pa.int32())),
             pa.array([s.tobytes() for s in sets], pa.binary())], names=["rep", "n", "sig", "shingles"])


class _Rows:
    """Members of a block: id, component, open flag, size, signature, full set."""

    def __init__(self, part: pa.Table):
        self.rep = part.column("rep").to_numpy()
        self.comp = part.column("comp").to_numpy()
        self.open = part.column("open").to_numpy(zero_copy_only=False)
        self.n = part.column("n").to_numpy()
        sig = part.column("sig").combine_chunks()
        self.sig = sig.flatten().to_numpy(zero_copy_only=False).reshape(len(sig), COORDS)
        self.sets = [np.frombuffer(x, np.uint64) for x in part.column("shingles").to_pylist()]


def confirm(a: _Rows, b: _Rows, percent: int, t: int) -> list[tuple[int, int]]:
    """Links between ``a`` and ``b`` that join two components, as a spanning forest.

    Bound on sizes, then signature collisions, then the full sets.
    """
    links: list[tuple[int, int]] = []
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (y := parent.get(x, x)) != x:
            parent[x] = parent.get(y, y)
            x = y
        return x

    for i in range(len(a.rep)):
        ok = (a.rep[i] != b.rep) & (a.comp[i] != b.comp)
        ok &= 100 * np.minimum(a.n[i], b.n) >= percent * np.maximum(a.n[i], b.n)
        if a.open[i]:
            ok &= ~b.open | (a.rep[i] < b.rep)  # a pair of two open documents is met twice
        at = np.flatnonzero(ok)
        if len(at):
            at = at[(a.sig[i] == b.sig[at]).sum(axis=1) >= t]
        if parent:
            at = np.array([j for j in at if root(int(a.comp[i])) != root(int(b.comp[j]))], int)
        if not len(at):
            continue
        mine = a.sets[i]
        theirs = np.concatenate([b.sets[j] for j in at])
        hit = mine[np.minimum(np.searchsorted(mine, theirs), len(mine) - 1)] == theirs
        starts = np.concatenate([[0], np.cumsum(b.n[at])[:-1]])
        both = np.add.reduceat(hit.astype(np.int64), starts)
        for j in at[100 * both >= percent * (a.n[i] + b.n[at] - both)]:
            x, y = root(int(a.comp[i])), root(int(b.comp[j]))
            if x != y:
                parent[max(x, y)] = min(x, y)
                links.append((int(a.rep[i]), int(b.rep[j])))
    return links


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Runs of equal ``task`` in rows sorted by it."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        task = batch.column("task").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(task)) + 1).tolist(), batch.num_rows]
        if held and held[-1].column("task")[-1].as_py() != task[0]:
            yield pa.Table.from_batches(held)
            held = []
        for x, y in zip(cuts, cuts[1:]):
            held.append(batch.slice(x, y - x))
            if y < batch.num_rows:
                yield pa.Table.from_batches(held)
                held = []
    if held:
        yield pa.Table.from_batches(held)


def _compare(percent: int, t: int):
    """Rows (task, side, ...) sorted by task to links between its two sides."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int]] = []
        for table in _groups(batches):
            side = table.column("side").to_numpy()
            a, b = table.filter(pa.array(side == 0)), table.filter(pa.array(side == 1))
            if len(a) and len(b):
                out += confirm(_Rows(a), _Rows(b), percent, t)
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())],
                                         names=["a", "b"])

    return run


def _run_tasks(left: DataFrame, right: DataFrame, percent: int, t: int) -> DataFrame:
    """Links between ``left`` and ``right`` rows of equal (pivot, i, j)."""
    cols = ["rep", "comp", "open", "n", "sig", "shingles"]
    rows = (left.withColumn("side", F.lit(0)).select("pivot", "i", "j", "side", *cols)
            .union(right.withColumn("side", F.lit(1)).select("pivot", "i", "j", "side", *cols)))
    return (rows.withColumn("task", F.xxhash64("pivot", "i", "j")).drop("pivot", "i", "j")
            .repartition("task").sortWithinPartitions("task").mapInArrow(_compare(percent, t), "a long, b long"))


def _pairs_by_prefix(reps: DataFrame, t: int, scratch: Scratch) -> DataFrame:
    """``(pivot, rep)``: each document with the pivots of its prefix lists."""
    postings = reps.select("rep", F.posexplode("sig").alias("coord", "value"))
    postings = postings.select("rep", F.shiftleft(F.col("coord").cast("long"), 32)
                               .bitwiseOR(F.col("value").cast("long").bitwiseAND(F.lit(0xFFFFFFFF))).alias("token"))
    # what is joined on a token or a pivot is a written table: under an aggregate a hot one would not be split
    lists = scratch.save(postings.groupBy("token").agg(F.count(F.lit(1)).alias("f")).where(F.col("f") > 1), "lists")
    shared = postings.join(lists, "token").groupBy("rep").agg(
        F.sort_array(F.collect_list(F.struct("f", "token"))).alias("tokens"), F.sum("f").alias("central"))
    prefix = (shared.where(F.size("tokens") >= t)
              .select("rep", "central", F.explode(F.slice("tokens", 1, F.size("tokens") - (t - 1))).alias("x"))
              .select("rep", "central", F.col("x.token").alias("token")))
    prefix = scratch.save(prefix, "prefix")
    pivots = (prefix.groupBy("token").agg(F.max(F.struct(F.col("central"), (-F.col("rep")).alias("neg"))).alias("p"),
                                          F.count(F.lit(1)).alias("f"))
              .where(F.col("f") > 1).select("token", (-F.col("p.neg")).alias("pivot")))
    pivots = scratch.save(pivots, "pivots")
    return prefix.join(pivots, "token").where(F.col("rep") != F.col("pivot")).select("pivot", "rep").distinct()


def near_duplicates(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text",
                    percent: int = PERCENT, block: int = BLOCK) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs``.

    Documents with ``100 * intersection >= percent * union`` are linked;
    ``component_id`` is the smallest id reachable. A text without words
    (null, empty, white space) has no shingle and is linked with nothing.
    Rows that repeat an id are one node with all its texts' sets. A row
    with a null id is returned with a null component and is not kept.
    An empty table gives an empty table.
    """
    t = match_threshold(percent)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    sketch = scratch.save(rows.mapInArrow(_sketch, "doc_id long, n long, digest binary, sig array<int>"), "sketch")
    # one node, and one signature, a class of equal sets, however many rows it has
    classes = (sketch.where(F.col("digest").isNotNull()).groupBy("digest")
               .agg(F.min("doc_id").alias("rep"), F.first("sig").alias("sig")).where(F.col("rep").isNotNull()))
    classes = scratch.save(classes, "classes")
    stars = scratch.save(_pairs_by_prefix(classes.select("rep", "sig"), t, scratch), "stars")

    wanted = stars.select(F.col("rep").alias("w")).union(stars.select("pivot")).distinct()
    # texts are dealt by id at every size; a broadcast of the ids would have no bound
    texts = rows.join(wanted.hint("merge"), rows["doc_id"] == wanted["w"], "left_semi").select(F.col("doc_id").alias("rep"), "text")
    sets = scratch.save(texts.mapInArrow(_full_sets, "rep long, n long, sig array<int>, shingles binary"), "sets")

    # first round: every document against its pivots
    sizes = stars.groupBy("pivot").agg(F.count(F.lit(1)).alias("g"))
    sizes = scratch.save(sizes.select("pivot", F.ceil(F.col("g") / block).cast("int").alias("blocks")), "sizes")
    members = stars.join(sizes, "pivot").withColumn("j", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    alone = [F.col("rep").alias("comp"), F.lit(False).alias("open")]
    right = members.join(sets, "rep").select("pivot", F.lit(0).alias("i"), "j", "rep", *alone, "n", "sig", "shingles")
    left = (sizes.join(sets, sizes["pivot"] == sets["rep"])
            .withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            .select("pivot", F.lit(0).alias("i"), "j", "rep", *alone, "n", "sig", "shingles"))
    to_pivot = scratch.save(_run_tasks(left, right, percent, t), "to-pivot")
    comp = scratch.save(components(to_pivot, "a", "b", scratch, "cc1"), "comp1")

    # second round: what its pivot did not take, against the rest of the pivot's group
    of_rep = comp.select(F.col("node").alias("rep"), F.col("component").alias("rep_comp"))
    of_pivot = comp.select(F.col("node").alias("pivot"), F.col("component").alias("pivot_comp"))
    group = (stars.join(of_rep, "rep", "left").join(of_pivot, "pivot", "left")
             .withColumn("comp", F.coalesce("rep_comp", "rep"))
             .withColumn("open", F.col("comp") != F.coalesce("pivot_comp", "pivot"))
             .select("pivot", "rep", "comp", "open"))
    group = scratch.save(group, "group")
    # a group is compared further if it holds an open document and another component
    plan = (group.groupBy("pivot").agg(F.count(F.lit(1)).alias("g"), F.count_if("open").alias("o"))
            .where((F.col("o") > 0) & (F.col("g") > 1))
            .select("pivot", F.ceil(F.col("g") / block).cast("int").alias("js"), F.ceil(F.col("o") / block).cast("int").alias("is")))
    plan = scratch.save(plan, "plan")
    full = group.join(plan, "pivot").join(sets, "rep")
    left = (full.where("open").withColumn("i", F.pmod(F.xxhash64("rep", F.lit(1)), F.col("is")).cast("int"))
            .withColumn("j", F.explode(F.sequence(F.lit(0), F.col("js") - 1))))
    right = (full.withColumn("j", F.pmod(F.xxhash64("rep"), F.col("js")).cast("int"))
             .withColumn("i", F.explode(F.sequence(F.lit(0), F.col("is") - 1))))
    more = scratch.save(_run_tasks(left, right, percent, t), "more")
    known = comp.where(F.col("node") != F.col("component")).select(F.col("node").alias("a"), F.col("component").alias("b"))
    final = components(known.union(more), "a", "b", scratch, "cc2")

    scratch.drop("lists", "prefix", "pivots", "sizes", "sets", "group", "plan")
    by_class = classes.join(final, classes["rep"] == final["node"], "left").select(
        F.col("digest").alias("class"), F.coalesce("component", "rep").alias("component"))
    return (sketch.select("doc_id", "n", "digest").join(by_class, F.col("digest") == F.col("class"), "left")
            .withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")))
            .select("doc_id", F.col("n").alias("n_shingles"), "component_id",
                    F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept")))
