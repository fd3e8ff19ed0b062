"""Exact global order statistics without moving all rows into one task.

``with_row_index`` and ``prefix_sums`` range-partition the rows by the
ordering key (balanced by sampling), materialise that partitioning once
with a reliable ``checkpoint`` (to the shared ``spark.checkpoint.dir``,
so a lost executor does not change the partition bounds), and add each
partition's offset from a per-partition summary whose size is the
number of partitions, not the number of rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from starlens.session import ensure_checkpoint_dir, shared_path, size_partitions

SMALL_SLICE = 100_000  # rows whose keys may be broadcast
_POS_BITS = 33  # monotonically_increasing_id = partition index << 33 | position


def _ranged(df: DataFrame, order_cols: Sequence[str], partitions: int | None) -> DataFrame:
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    n = partitions or size_partitions(df)
    mid = F.monotonically_increasing_id()
    ranged = (df.repartitionByRange(n, *order_cols)
              .sortWithinPartitions(*order_cols)
              .withColumn("_mid", mid)
              .withColumn("_pid", F.shiftright(F.col("_mid"), _POS_BITS))
              .withColumn("_pos", F.col("_mid").bitwiseAND(F.lit((1 << _POS_BITS) - 1)))
              .drop("_mid"))
    return ranged.checkpoint(eager=True)


def with_row_index(df: DataFrame, order_cols: Sequence[str], out: str = "row_index",
                   partitions: int | None = None) -> DataFrame:
    """1-based position of each row in ``order_cols`` order (keys must be unique)."""
    ranged = _ranged(df, order_cols, partitions)
    sizes = ranged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("_off", F.coalesce(F.sum("_n").over(w), F.lit(0))).select("_pid", "_off")
    return (ranged.join(F.broadcast(offsets), "_pid")
            .withColumn(out, F.col("_off") + F.col("_pos") + F.lit(1))
            .drop("_pid", "_pos", "_off"))


def row_slice(df: DataFrame, order_cols: Sequence[str], lo: int, hi: int, out: str = "row_index") -> DataFrame:
    """Rows whose 1-based position is in (lo, hi]; null keys come first, rows of equal keys in any order.

    Only the distinct keys with their counts are range-partitioned and
    checkpointed; the at most ``hi - lo`` keys of the slice then pick the
    wide rows. These are written once with a number each, so that rows of
    equal keys have positions of their own. Keys and numbers of a slice of at
    most ``SMALL_SLICE`` rows are sent to all tasks; a longer slice is joined
    as the planner sees fit.
    """
    small = F.broadcast if hi - lo <= SMALL_SLICE else (lambda side: side)
    spark = df.sparkSession
    counts = df.groupBy(*order_cols).agg(F.count(F.lit(1)).alias("__n"))
    inside = (prefix_sums(counts, order_cols, ["__n"])
              .where((F.col("__n_before") < hi) & (F.col("__n_before") + F.col("__n") > lo)))
    first = inside.agg(F.min("__n_before").alias("__first"))
    keys = inside.select(*[F.col(c).alias(f"__key{i}") for i, c in enumerate(order_cols)])
    same = reduce(and_, [df[c].eqNullSafe(keys[f"__key{i}"]) for i, c in enumerate(order_cols)])
    rows = df.join(small(keys), same, "left_semi").withColumn("__row", F.monotonically_increasing_id())
    path = shared_path(spark, "slices", uuid.uuid4().hex)
    rows.write.parquet(path)
    rows = spark.read.schema(rows.schema).parquet(path)
    idx = (with_row_index(rows.select(*order_cols, "__row"), [*order_cols, "__row"], "__at")
           .crossJoin(F.broadcast(first)).select("__row", (F.col("__first") + F.col("__at")).alias(out)))
    idx = idx.where((F.col(out) > lo) & (F.col(out) <= hi))
    return rows.join(small(idx), "__row").select(*df.columns, out)


def prefix_sums(df: DataFrame, order_col: str | Sequence[str], value_cols: Sequence[str],
                partitions: int | None = None, suffix: str = "_before") -> DataFrame:
    """For each row, the sum of each value over all rows with a smaller key.

    ``order_col``, one or several, must be unique (aggregate first).  The running sum
    inside a partition is a window keyed by the partition index; the
    partition offsets come from a table with one row per partition.
    """
    ranged = _ranged(df, [order_col] if isinstance(order_col, str) else order_col, partitions)
    sums = ranged.groupBy("_pid").agg(*[F.sum(v).alias(f"_t_{v}") for v in value_cols])
    wp = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("_pid", *[F.coalesce(F.sum(f"_t_{v}").over(wp), F.lit(0)).alias(f"_o_{v}")
                                    for v in value_cols])
    wl = Window.partitionBy("_pid").orderBy("_pos").rowsBetween(Window.unboundedPreceding, -1)
    local = ranged.select("*", *[F.coalesce(F.sum(v).over(wl), F.lit(0)).alias(f"_l_{v}") for v in value_cols])
    out = local.join(F.broadcast(offsets), "_pid")
    for v in value_cols:
        out = out.withColumn(f"{v}{suffix}", F.col(f"_o_{v}") + F.col(f"_l_{v}"))
    return out.drop("_pid", "_pos", *[f"_o_{v}" for v in value_cols], *[f"_l_{v}" for v in value_cols])
