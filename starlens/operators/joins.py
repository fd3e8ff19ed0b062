"""Joins with prefixed columns and a skew-safe equi-join.

Strategy choice (broadcast hash vs sort-merge) is left to Catalyst and
AQE: a side is broadcast only when its measured size is under
``spark.sql.autoBroadcastJoinThreshold``; AQE re-plans at runtime from
real shuffle sizes and splits skewed partitions of sort-merge joins.

``salted_join`` is the explicit path for a key that may hold a large
share of one side (a hot business, the word "the").  Hot keys are the
keys whose row count is at least ``total / max_hot``; there can be at
most ``max_hot`` of them, so the broadcast hot-key list has a proven
size bound whatever the data size.  The list carries each key's count:
its rows are spread over ``count / rows_per_salt`` tasks on the big side
and the matching small-side rows replicated as often; cold keys join
unsalted.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starlens.session import shared_path

ROWS_PER_SALT = 1_000_000


def prefixed_inner_join(left: DataFrame, right: DataFrame, key: str,
                        left_prefix: str, right_prefix: str, skew_safe: bool = False,
                        max_hot: int = 1000, rows_per_salt: int = ROWS_PER_SALT) -> DataFrame:
    """Inner equi-join on ``key``; every other column gets its side's prefix.

    Keeps one unambiguous key column and no duplicated names, so later
    references to a column cannot be ambiguous.  With ``skew_safe`` the
    left (big) side's keys are counted first (a key-only, partially
    aggregated pass) and keys holding >= 1/max_hot of its rows are salted.
    """
    lcols = [F.col(c).alias(left_prefix + c) for c in left.columns if c != key]
    rcols = [F.col(c).alias(right_prefix + c) for c in right.columns if c != key]
    lsel, rsel = left.select(key, *lcols), right.select(key, *rcols)
    if not skew_safe:
        return lsel.join(rsel, key, "inner")
    counts = left.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    hot = hot_keys(counts, key, "_n", max_hot)
    return salted_join(lsel, rsel, key, hot, rows_per_salt)


def hot_keys(key_counts: DataFrame, key: str, count_col: str, max_hot: int = 1000) -> DataFrame:
    """Keys with at least 1/max_hot of all rows (at most ``max_hot`` keys), with their counts as ``_rows``.

    ``key_counts`` has one row per key with its row count on the big side.
    """
    total = key_counts.agg(F.sum(count_col)).scalar()  # scalar subquery, run once
    return key_counts.filter(F.col(count_col) * F.lit(max_hot) >= total).select(key, F.col(count_col).alias("_rows"))


def salted_join(big: DataFrame, small: DataFrame, key: str, hot: DataFrame,
                rows_per_salt: int = ROWS_PER_SALT, how: str = "inner",
                spread_cols: Sequence[str] | None = None) -> DataFrame:
    """Equi-join ``big`` to ``small`` on ``key``, a hot key in tasks of about ``rows_per_salt`` rows.

    ``hot`` holds at most a bounded number of keys (see ``hot_keys``) and
    is broadcast; ``spread_cols`` choose the big-side columns hashed into
    the salt (all columns by default).  ``how`` is ``inner`` or ``left``
    (left = keep big-side rows without a match).
    """
    flag = hot.select(F.col(key), F.ceil(F.col("_rows") / F.lit(rows_per_salt)).cast("int").alias("_salts"))
    cols = [F.col(c) for c in (spread_cols or big.columns)]
    b = (big.join(F.broadcast(flag), key, "left")
         .withColumn("_salt", F.coalesce(F.pmod(F.xxhash64(*cols), F.col("_salts")).cast("int"), F.lit(0)))
         .drop("_salts"))
    s = (small.join(F.broadcast(flag), key, "left")
         .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_salts"), F.lit(1)) - 1)))
         .drop("_salts"))
    return b.join(s, [key, "_salt"], how).drop("_salt")


# --- tables laid out for repeated joins -------------------------------------------------------
def write_bucketed(df: DataFrame, key: str, buckets: int, name: str | None = None) -> str:
    """Write ``df`` once as a table of ``buckets`` hash buckets on ``key``, sorted by it; returns its name.

    Two tables with equal buckets on a key join on it without a shuffle of
    either, as often as wanted: the exchange is paid at the write. The files
    lie in the shared folder, the name in the session's catalog.
    """
    name = name or f"starlens_{uuid.uuid4().hex}"
    (df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key)
     .option("path", shared_path(df.sparkSession, "bucketed", name)).format("parquet").saveAsTable(name))
    return name


def bucketed_join(left_table: DataFrame, right_table: DataFrame, key: str, left_prefix: str, right_prefix: str) -> DataFrame:
    """``prefixed_inner_join`` of two tables with equal buckets, planned as a merge join of buckets.

    A hot key is one bucket, which is one task: for such keys take ``salted_join``.
    """
    return prefixed_inner_join(left_table.hint("merge"), right_table, key, left_prefix, right_prefix)
