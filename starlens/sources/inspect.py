"""Looking at a table: first rows and schema, returned as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def head_rows(df: DataFrame, n: int, *order_cols: str) -> DataFrame:
    """First ``n`` rows by a stable key (a bare ``limit`` depends on partitioning).

    Planned as ``TakeOrderedAndProject``: each task keeps its own top n,
    only n rows per task reach the final merge.
    """
    return df.orderBy(*order_cols).limit(n)


def schema_report(df: DataFrame) -> DataFrame:
    """One row per column: position, name, Spark SQL type, nullability."""
    rows = [(i + 1, f.name, f.dataType.simpleString(), f.nullable)
            for i, f in enumerate(df.schema.fields)]
    return df.sparkSession.createDataFrame(
        rows, "position int, column_name string, data_type string, nullable boolean")


def table_shape(df: DataFrame) -> DataFrame:
    """(n_rows, n_cols) in one job."""
    return df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("n_cols", F.lit(len(df.columns)))
