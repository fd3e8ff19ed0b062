"""Parquet table access.

Callers select the columns they need right after the read so Catalyst
prunes the scan (``ReadSchema``) and pushes filters into it
(``PushedFilters``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def table_path(base_dir: str, name: str) -> str:
    return f"{base_dir.rstrip('/')}/{name}.parquet"


def read_table(spark: SparkSession, base_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(table_path(base_dir, name))
    return df.select(*columns) if columns else df


def spread(df: DataFrame, key: str | None = None) -> DataFrame:
    """Give CPU-heavy per-row work (tokenizing whole texts) every core.

    A scan already split into at least ``defaultParallelism`` tasks (the
    normal case on a cluster: many files / row groups) is returned as is,
    so no extra shuffle is added at scale.  A scan with fewer tasks (one
    large row group) is hash-partitioned by ``key``; a later aggregation
    grouped by ``key`` and more columns then reuses that partitioning.
    The task count is read from the planned scan; no job runs.
    """
    want = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= want:
        return df
    return df.repartition(want, key) if key else df.repartition(want)
