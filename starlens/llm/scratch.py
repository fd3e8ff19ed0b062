"""Intermediate tables in the shared folder, and row identities.

A written table cuts lineage and survives the loss of any executor. The
folder is the one the cluster names in ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from starlens.session import shared_path

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Scratch:
    """A fresh folder of Parquet tables under the shared folder."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = shared_path(spark, "llm", f"{name}-{uuid.uuid4().hex}")

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` once and read it back (schema given, none inferred)."""
        df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        """Delete tables that no later plan reads."""
        jvm = self.spark._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.path(name))
            path.getFileSystem(conf).delete(path, True)


def ascii_lower(col: Column) -> Column:
    """A-Z to a-z and nothing else (``lower`` would also change other letters)."""
    return F.translate(col, UPPER, LOWER)


def text_or_empty(col: str) -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def others(df: DataFrame, *names: str) -> list[str]:
    """Columns of ``df`` that no name of ``names`` equals; upper and lower case are one, as in Spark's own look-up."""
    taken = {n.lower() for n in names}
    return [c for c in df.columns if c.lower() not in taken]


def same_row(left: DataFrame, right: DataFrame, *keys: str) -> Column:
    """Null-safe equality on ``keys``, still an equi-join."""
    cond = left[keys[0]].eqNullSafe(right[keys[0]])
    for k in keys[1:]:
        cond = cond & left[k].eqNullSafe(right[k])
    return cond
