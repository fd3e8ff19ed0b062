"""Session helpers.

The library never owns the production session: every operator takes
DataFrames and uses ``df.sparkSession``.  ``local_session`` exists for
tests, the bench and small local runs.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "starlens") -> SparkSession:
    """A local[N] session with AQE on and the UI off."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("STARLENS_DRIVER_MEMORY", "16g"))
        .config("spark.driver.host", "127.0.0.1")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by the cluster.

    ``spark.checkpoint.dir`` is read from the session.  Only a ``local``
    session without it gets a fresh scratch folder: on a cluster a
    machine-local folder would be invisible to the other machines.
    """
    path = spark.conf.get(CHECKPOINT_CONF, None) or spark.sparkContext.getConf().get(CHECKPOINT_CONF, None)
    if not path:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError(f"set {CHECKPOINT_CONF} to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="starlens-ckpt-")
        spark.conf.set(CHECKPOINT_CONF, path)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(path)
    return path


def shared_path(spark: SparkSession, *parts: str) -> str:
    """A path under the shared checkpoint folder (visible to all executors)."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return "/".join([base, "starlens", *parts])


def written(df, name: str):
    """``df``, written once under the shared folder and read back."""
    path = shared_path(df.sparkSession, name, uuid.uuid4().hex)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


UNKNOWN_SIZE = 1 << 60  # Spark's stand-in for a source without statistics


def source_bytes(df) -> int:
    """Bytes of the sources that ``df`` reads: the sum over its plan's leaves.

    A join's own estimate multiplies its sides; the sum of what is read
    does not.  A checkpoint is a leaf that keeps the estimate of the plan it
    came from, so its files are measured instead; other rows held by Spark
    (an RDD, a local list) and sources without statistics count as nothing.
    """
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    total = 0
    for leaf in (leaves.apply(i) for i in range(leaves.size())):
        if leaf.getClass().getSimpleName() == "LogicalRDD":
            total += _checkpoint_bytes(df.sparkSession, leaf.rdd())
        else:
            size = int(str(leaf.stats().sizeInBytes()))
            total += size if size < UNKNOWN_SIZE else 0
    return total


def _checkpoint_bytes(spark: SparkSession, rdd) -> int:
    """Bytes of a checkpointed RDD's files, 0 without a checkpoint."""
    file = rdd.getCheckpointFile()
    if file.isEmpty():
        return 0
    path = spark._jvm.org.apache.hadoop.fs.Path(file.get())
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    return int(path.getFileSystem(conf).getContentSummary(path).getLength())


def size_partitions(df, target_bytes: int = 128 << 20, expansion: int = 4) -> int:
    """Partition count for ``df``: its source bytes, expanded in memory, by ``target_bytes``.

    Follows the data alone: neither the cores nor
    ``spark.sql.shuffle.partitions`` matter, so a fit or a range
    partitioning is the same on any cluster.
    """
    return max(1, min((1 << 31) - 1, -(-source_bytes(df) * expansion // target_bytes)))
