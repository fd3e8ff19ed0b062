"""Connected components of a link table, distributed.

Alternating large-star and small-star steps: every step is a grouped
minimum (partially aggregated, so a hub costs one row a task) and one
equi-join of the links with those minima. The minima are a written table,
not an aggregate under the join: only then can adaptive execution split a
hub's rows. Each round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starlens.llm.scratch import Scratch


def _hash_sum(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)).alias("n"),
                    F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def components(edges: DataFrame, a: str, b: str, scratch: Scratch, name: str = "cc") -> DataFrame:
    """``(node, component)`` for every node of ``edges``; component = smallest node reachable.

    Self-links, repeated links and links with a null end are ignored; a
    node without a link has no row; an empty table gives an empty table.
    """
    links = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    current = scratch.save(links.where(F.col("u") != F.col("v")).distinct(), f"{name}-0")
    state, i = _hash_sum(current), 0
    while True:
        i += 1
        both = current.select("u", "v").union(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = scratch.save(both.groupBy("u").agg(F.min("v").alias("m")), f"{name}-{i}-low")
        # large star: every larger neighbour points to the smallest of the neighbourhood
        large = (both.where(F.col("v") > F.col("u")).join(low, "u")
                 .select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct())
        large = scratch.save(large, f"{name}-{i}-large")
        # small star: a node and its smaller neighbours point to the smallest of them
        low = scratch.save(large.groupBy("u").agg(F.min("v").alias("m")), f"{name}-{i}-low-small")
        joined = large.join(low, "u")
        small = (joined.where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .union(low.select("u", F.col("m").alias("v"))).distinct())
        new = scratch.save(small, f"{name}-{i}")
        new_state = _hash_sum(new)
        scratch.drop(f"{name}-{i}-low", f"{name}-{i}-large", f"{name}-{i}-low-small", f"{name}-{i - 1}")
        current = new
        if new_state == state:
            break
        state = new_state
    return (current.select(F.col("u").alias("node"), F.col("v").alias("component"))
            .union(current.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct())
