"""Distinct and duplicate counts that add up over parts of a table.

An exact distinct count reads the whole table again for every new day.  A
HyperLogLog sketch of each part is a few KB, can be stored and merged, and
estimates the distinct keys of any union of parts; row and null counts are
exact and add up as they are.  The relative standard error is
1.04 / sqrt(2 ** precision).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PRECISION = 14


def standard_error(precision: int = PRECISION) -> float:
    return 1.04 / 2 ** (precision / 2)


def distinct_sketches(df: DataFrame, key: str, parts: Sequence[str | Column], precision: int = PRECISION) -> DataFrame:
    """``(*parts, n_rows, n_null, sketch)``: a row a part, to be stored and merged later."""
    text = F.col(key).cast("string")
    return df.groupBy(*parts).agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col(key).isNull()).alias("n_null"),
                                  F.hll_sketch_agg(text, precision).alias("sketch"))


def merged_duplicates(sketches: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Rows, estimated distinct keys (null is one) and duplicates of all parts together, or of each group of ``by``."""
    merged = sketches.groupBy(*by).agg(F.coalesce(F.sum("n_rows"), F.lit(0)).alias("n_rows"),
                                       F.coalesce(F.max("n_null"), F.lit(0)).alias("n_null"), F.hll_union_agg("sketch").alias("sketch"))
    keys = F.coalesce(F.hll_sketch_estimate("sketch"), F.lit(0)) + F.when(F.col("n_null") > 0, 1).otherwise(0)
    return (merged.withColumn("n_distinct", keys.cast("bigint"))
            .select(*by, "n_rows", "n_distinct", F.greatest(F.col("n_rows") - F.col("n_distinct"), F.lit(0)).alias("n_duplicates")))
