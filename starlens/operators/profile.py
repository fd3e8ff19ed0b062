"""Table profiling: shapes, histograms, group counts, duplicates, nulls.

Each function is one Spark job.  Histograms are a single ``groupBy``
(partial aggregation map-side, so a hot category costs one row per task
in the shuffle) instead of one filter+count job per category.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from starlens.functions._col import as_col


def category_frame(df: DataFrame, name: str, categories: Sequence, dtype: T.DataType) -> DataFrame:
    """A tiny frame holding a fixed category list (bounded by the list)."""
    schema = T.StructType([T.StructField(name, dtype, True), T.StructField("_order", T.IntegerType(), False)])
    return df.sparkSession.createDataFrame([(c, i) for i, c in enumerate(categories)], schema)


def category_histogram(df: DataFrame, col: str, categories: Sequence, dtype: T.DataType,
                       count_name: str = "count") -> DataFrame:
    """Count rows per category; categories with no rows get 0.

    Values outside the list are filtered before the aggregation, so the
    aggregated side is bounded by ``len(categories)``.
    """
    counts = (df.filter(F.col(col).isin(list(categories)))
              .groupBy(col).agg(F.count(F.lit(1)).alias(count_name)))
    cats = category_frame(df, col, categories, dtype)
    return (cats.join(F.broadcast(counts), col, "left")
            .select(col, F.coalesce(F.col(count_name), F.lit(0)).cast("bigint").alias(count_name)))


def group_count(df: DataFrame, *cols: str, count_name: str = "count") -> DataFrame:
    return df.groupBy(*cols).agg(F.count(F.lit(1)).alias(count_name))


def duplicate_count(df: DataFrame, key: str) -> DataFrame:
    """Rows minus distinct keys (a null key counts as one distinct key)."""
    k = F.col(key)
    distinct_keys = F.count_distinct(k) + F.coalesce(F.max(F.when(k.isNull(), 1).otherwise(0)), F.lit(0))
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        distinct_keys.cast("bigint").alias("n_distinct"),
    ).withColumn("n_duplicates", F.col("n_rows") - F.col("n_distinct"))


def distinct_by_key(df: DataFrame, key: str, order_col: str) -> DataFrame:
    """One row per key: the row with the smallest ``order_col``.

    A grouped ``min`` over a struct led by the order column, so the work
    is partially aggregated before the shuffle (a key holding a third of
    the rows is reduced to one row per task), unlike a row_number window.
    """
    others = [c for c in df.columns if c not in (key, order_col)]
    best = F.min(F.struct(F.col(order_col), *[F.col(c) for c in others])).alias("_best")
    return df.groupBy(key).agg(best).select(key, *[F.col(f"_best.{c}").alias(c) for c in [order_col, *others]])


def drop_nulls(df: DataFrame, how: str = "any", subset: Sequence[str] | None = None) -> DataFrame:
    """``any``: drop a row with a null in ``subset``; ``all``: only if all are null."""
    return df.dropna(how=how, subset=list(subset) if subset else None)


def sentinel_split(df: DataFrame, col: str, sentinel: str,
                   equal_name: str = "n_equal", other_name: str = "n_other") -> DataFrame:
    """Rows equal to the sentinel vs rows different from it; nulls are in neither."""
    c = F.col(col)
    return df.agg(F.count_if(c == F.lit(sentinel)).alias(equal_name),
                  F.count_if(c != F.lit(sentinel)).alias(other_name))


def parse_counts(df: DataFrame, raw: Column | str, parsed: Column) -> DataFrame:
    """How many values are present, and how many survive parsing."""
    r = as_col(raw)
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.count(r).alias("n_present"),
                  F.count(parsed).alias("n_parsed"))
