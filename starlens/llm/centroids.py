"""Operator 12: centroid clustering in built-in expressions.

Components become whole numbers ``floor(scale * x)``. A round is one pass:
the centroids are literal arrays of the plan, ``zip_with`` and ``aggregate``
give each vector's squared distance to all of them (``|x|^2 - 2 x.c + |c|^2``,
exact in longs; where products are small enough, a long holds those of two or
three centroids side by side, which saves as many passes over a vector), and ``array_min`` of (distance, number) structs chooses the
cluster, the smaller number on ties. One sum a dimension, in generated code
and partially aggregated before the shuffle, gives every cluster's new
centroid, so the driver sees ``k`` rows a round and a hot cluster is one row
a task.

Defined cases. A vector is kept if it has exactly ``dims`` components, none
null or non-finite; others get no row. Components beyond +-2^27 after scaling
end there, so that distances fit a long; inertias are decimals, as a sum
may not. Repeated rows each count and each
get a row. Rows without an id come last among the candidates for the first
centroids; equal hashes are ordered by vector. With fewer kept vectors than
``k`` there are as many centroids; with none the result is empty. Other
columns are ignored, whatever their names.
"""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starlens.llm.scratch import Scratch

REACH = 1 << 27


def kept_vectors(vectors: DataFrame, dims: int, scale: int, id_col: str, vec_col: str) -> DataFrame:
    """``(id, x, norm)``: whole numbers of the vectors that take part, and their squared lengths."""
    fit = F.forall(vec_col, lambda c: c.isNotNull() & (F.abs(c) < F.lit(float("inf"))))
    to_int = lambda c: F.floor(F.greatest(F.least(c.cast("double") * scale, F.lit(float(REACH))), F.lit(-float(REACH))))
    x = (vectors.where((F.size(vec_col) == dims) & fit)
         .select(F.col(id_col).alias("id"), F.transform(vec_col, to_int).alias("x")))
    return x.withColumn("norm", F.aggregate("x", F.lit(0).cast("long"), lambda s, v: s + v * v))


def literal(numbers: list[int], kind: str = "bigint") -> str:
    """SQL of a constant array, one string that the planner folds."""
    return f"cast(split('{','.join(map(str, numbers))}', ',') AS array<{kind}>)"


def lane_width(centroids: list[list[int]], norm: int) -> int:
    """Bits that hold a vector's product with a centroid, and every partial sum of it: none exceeds ``|x| |c|``."""
    most = max(sum(v * v for v in c) for c in centroids)
    return isqrt(norm * most).bit_length() + 2


def nearest(centroids: list[list[int]], norm: int) -> Column:
    """Struct (distance, cluster) of the nearest centroid to ``x``; the smaller number on ties.

    ``norm`` is the greatest squared length of a vector. The components of
    ``lanes`` centroids are added up at distances of ``width`` bits; their
    products with a vector are then read from the bits of one sum. One SQL
    expression: built call by call from Python it takes seconds.
    """
    width = lane_width(centroids, norm)
    lanes = max(1, min(len(centroids), 62 // width))
    half, mask = 1 << (width - 1), (1 << width) - 1

    def distance(product: str, c: list[int], number: int) -> str:
        return f"named_struct('distance', norm - 2 * {product} + {sum(v * v for v in c)}L, 'cluster', {number})"

    packed = []
    for at in range(0, len(centroids), lanes):
        group = centroids[at:at + lanes]
        sums = [sum(c[d] << (i * width) for i, c in enumerate(group)) for d in range(len(group[0]))]
        total = f"aggregate(zip_with(x, {literal(sums)}, (a, b) -> a * b), 0L, (s, v) -> s + v)"
        rest, structs = "t", []
        for i, c in enumerate(group):
            own = rest if i == len(group) - 1 else f"((({rest} + {half}L) & {mask}L) - {half}L)"
            structs.append(distance(own, c, at + i))
            rest = f"shiftright({rest} - {own}, {width})"
        packed.append(f"transform(array({total}), t -> array({', '.join(structs)}))[0]")
    return F.expr(f"array_min(flatten(array({', '.join(packed)})))")


def first_centroids(kept: DataFrame, k: int, seed: str) -> list[list[int]]:
    """The ``k`` vectors with the smallest sha-256 of seed and id."""
    order = F.sha2(F.concat(F.lit(seed), F.col("id").cast("string")), 256)
    rows = kept.select("x", order.alias("h")).orderBy(F.col("h").asc_nulls_last(), "x").limit(k).collect()
    return [list(r["x"]) for r in rows]


def moved(kept: DataFrame, centroids: list[list[int]], norm: int) -> list[list[int]]:
    """Every centroid's floored mean of its vectors; one without vectors stays."""
    dims = len(centroids[0])
    sums = (kept.select(nearest(centroids, norm)["cluster"].alias("cluster"), "x").groupBy("cluster")
            .agg(F.count(F.lit(1)).alias("n"), *[F.expr(f"sum(x[{d}]) AS s{d}") for d in range(dims)]).collect())
    out = list(centroids)
    for r in sums:
        out[r["cluster"]] = [r[f"s{d}"] // r["n"] for d in range(dims)]
    return out


def cluster(vectors: DataFrame, scratch: Scratch, k: int = 40, rounds: int = 5, dims: int = 64, scale: int = 256,
            seed: str = "2:", id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``(id, cluster, distance, cluster_inertia, inertia, centroid)`` for every kept vector."""
    kept = scratch.save(kept_vectors(vectors, dims, scale, id_col, vec_col), "kept")
    centroids = first_centroids(kept, k, seed)
    norm = kept.agg(F.max("norm")).first()[0]
    for _ in range(rounds if centroids else 0):
        centroids = moved(kept, centroids, norm)
    best = nearest(centroids, norm) if centroids else F.struct(F.lit(0).cast("long").alias("distance"), F.lit(0).alias("cluster"))
    chosen = kept.select("id", best.alias("best")).select("id", "best.cluster", "best.distance")
    chosen = scratch.save(chosen, "chosen")
    scratch.drop("kept")
    sums = chosen.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(28,0)")).alias("s")).collect()  # k rows
    of = {r["cluster"]: int(r["s"]) for r in sums}
    at = F.col("cluster")
    if not centroids:
        return chosen.select(F.col("id").alias(id_col), "cluster", "distance", *[F.lit(0).cast("decimal(38,0)").alias(c) for c in
                             ("cluster_inertia", "inertia")], F.array().cast("array<bigint>").alias("centroid"))
    per = F.expr(literal([of.get(i, 0) for i in range(len(centroids))], "decimal(38,0)"))
    means = F.expr(f"array({', '.join(map(literal, centroids))})")
    return chosen.select(
        F.col("id").alias(id_col), "cluster", "distance", F.get(per, at).alias("cluster_inertia"),
        F.lit(str(sum(of.values()))).cast("decimal(38,0)").alias("inertia"),
        F.get(means, at).alias("centroid"))
