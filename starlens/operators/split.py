"""Deterministic train/test split.

``randomSplit`` draws per partition, so the same seed gives a different
split when the input is partitioned differently.  Here a row's side
depends only on its key and the seed: an md5 of ``seed:key``, first 32
bits, modulo 1000, against the train share in permille.  Purely a
per-row expression: no shuffle, same answer on 1 or 1000 executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def split_bucket(key: str, seed: int) -> Column:
    h = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("bigint") % F.lit(1000)


def split_side(key: str, seed: int, train_fraction: float) -> Column:
    permille = int(round(train_fraction * 1000))
    return F.when(split_bucket(key, seed) < F.lit(permille), F.lit("train")).otherwise(F.lit("test"))


def keyed_split(df: DataFrame, key: str, seed: int, train_fraction: float = 0.7) -> tuple[DataFrame, DataFrame]:
    side = split_side(key, seed, train_fraction)
    tagged = df.withColumn("_side", side)
    return (tagged.filter(F.col("_side") == "train").drop("_side"),
            tagged.filter(F.col("_side") == "test").drop("_side"))


# --- exact sizes ---------------------------------------------------------------------------
HASH_BITS, STEP_BITS = 60, 12
MAX_CLASSES = 10_000


def order_hash(key: str, seed: int) -> Column:
    """The first 60 bits of md5 of ``seed:key``, as a long."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), 1, 15), 16, 10).cast("bigint")


def class_thresholds(df: DataFrame, key: str, class_col: str, seed: int, train_fraction: float) -> DataFrame:
    """``(class, wanted, upto)``: the hash of each class's ``wanted``-th smallest key.

    Selection by digits: a pass counts the next 12 bits of the hashes that
    share the digits found so far, at most 4096 rows a class, and five passes
    fix all 60. Rows are never sorted or shuffled; the counts are. A class
    of which no row is wanted has -1.
    """
    spark = df.sparkSession
    permille = int(round(train_fraction * 1000))
    rows = df.where(F.col(key).isNotNull()).select(F.col(class_col).alias("class"), order_hash(key, seed).alias("h"))
    sizes = rows.groupBy("class").agg(F.count(F.lit(1)).alias("n")).limit(MAX_CLASSES + 1).collect()
    if len(sizes) > MAX_CLASSES:
        raise ValueError(f"more than {MAX_CLASSES} classes")
    kind = rows.schema["class"].dataType.simpleString()
    schema = f"class {kind}, wanted bigint, left bigint, prefix bigint"
    state = [(r["class"], w, w, 0) for r in sizes for w in [(r["n"] * permille + 500) // 1000]]
    for shift in range(HASH_BITS - STEP_BITS, -1, -STEP_BITS):
        now = spark.createDataFrame([s for s in state if s[1]], schema)
        same = rows["class"].eqNullSafe(now["class"]) & (F.shiftright("h", shift + STEP_BITS) == F.col("prefix"))
        # one row a class, at most MAX_CLASSES
        digits = (rows.join(F.broadcast(now), same).groupBy(now["class"], F.shiftright("h", shift).alias("p"))
                  .agg(F.count(F.lit(1)).alias("n"), F.first("left").alias("left")))
        upto = F.sum("n").over(Window.partitionBy("class").orderBy("p"))
        hit = (digits.withColumn("upto", upto).where((F.col("upto") >= F.col("left")) & (F.col("upto") - F.col("n") < F.col("left")))
               .select("class", "p", (F.col("left") - F.col("upto") + F.col("n")).alias("left")).collect())
        found = {r["class"]: (r["left"], r["p"]) for r in hit}
        state = [(c, w, *found.get(c, (0, -1))) for c, w, _, _ in state]
    return spark.createDataFrame([(c, w, p if w else -1) for c, w, _, p in state], f"class {kind}, wanted bigint, upto bigint")


def exact_split_side(df: DataFrame, key: str, class_col: str, seed: int, train_fraction: float = 0.7,
                     out: str = "side") -> DataFrame:
    """``df`` with its side: of each class, exactly the rounded share of rows is ``train``.

    The same rows on any cluster and partitioning. Keys are taken as
    unique: rows of one key and class stay together, so a repeated key may
    shift a size. Rows without a key are ``test``; a null class is a class.
    """
    upto = class_thresholds(df, key, class_col, seed, train_fraction).select(F.col("class").alias("__class"), F.col("upto").alias("__upto"))
    same = F.col(class_col).eqNullSafe(F.col("__class"))
    side = F.when(order_hash(key, seed) <= F.col("__upto"), F.lit("train")).otherwise(F.lit("test"))
    return df.join(F.broadcast(upto), same, "left").withColumn(out, side).drop("__class", "__upto")
