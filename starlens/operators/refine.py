"""Repeated k-means refinement over features computed once.

Texts are tokenized, freed of stop words and hashed a single time, into a
written table.  Every level reads the rows that the level before kept, fits
IDF and k-means on them alone (as a fit from the texts would) and writes them
with their cluster, so no level tokenizes, joins or reads what was left out.
Clusters are numbered from the largest; a row's path is the numbers it got,
such as ``0/1``.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.ml import Pipeline
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import IDF, HashingTF, StopWordsRemover, Tokenizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starlens.operators import models
from starlens.session import shared_path


def _written(df: DataFrame, name: str) -> DataFrame:
    path = shared_path(df.sparkSession, "refine", f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def feature_table(df: DataFrame, key: str, text_col: str = "text", label_col: str = "label",
                  num_features: int = models.DEFAULT_FEATURES) -> DataFrame:
    """``(key, label, n_tokens, counts)``: hashed counts of the tokens without stop words; null texts go."""
    stages = [Tokenizer(inputCol=text_col, outputCol="tokens"), StopWordsRemover(inputCol="tokens", outputCol="kept_tokens"),
              HashingTF(inputCol="kept_tokens", outputCol="counts", numFeatures=num_features)]
    out = df.where(F.col(text_col).isNotNull()).select(key, label_col, text_col)
    for stage in stages:
        out = stage.transform(out)
    return _written(out.select(key, F.col(label_col).alias("label"), F.size("tokens").alias("n_tokens"), "counts"), "features")


def split_level(rows: DataFrame, k: int, key: str, seed: int = 1234) -> DataFrame:
    """``rows`` of a feature table with ``prediction``, their cluster of ``k``, written once."""
    pipeline = Pipeline(stages=[IDF(inputCol="counts", outputCol="features"), KMeans(k=k, seed=seed)])
    model = models.fit(pipeline, rows, key)
    scored = model.transform(rows).select(key, "label", "n_tokens", "counts", "prediction")
    return models.relabel_by_size(_written(scored, "level"))


def refinement_tree(features: DataFrame, key: str, splits: Sequence[int] = (2, 2, 5), keep: int = 0,
                    seed: int = 1234) -> DataFrame:
    """``(key, label, n_tokens, path)`` of every row: level by level, cluster ``keep`` is split again.

    An empty level ends the tree, as does one with fewer rows than clusters
    to find.
    """
    parts, rows, prefix = [], features, ""
    for i, k in enumerate(splits):
        level = split_level(rows, k, key, seed)
        path = F.concat(F.lit(prefix), F.col("prediction").cast("string"))
        last = i == len(splits) - 1
        inside = level.where(F.col("prediction") == keep)
        enough = last or inside.limit(splits[i + 1]).count() == splits[i + 1]
        done = level if last or not enough else level.where(F.col("prediction") != keep)
        parts.append(done.select(key, "label", "n_tokens", path.alias("path")))
        if not enough:
            break
        rows, prefix = inside.drop("prediction"), f"{prefix}{keep}/"
    return reduce(DataFrame.unionByName, parts)


def path_profile(tree: DataFrame) -> DataFrame:
    """Size, average label and average token count of every leaf."""
    return tree.groupBy("path").agg(F.count(F.lit(1)).alias("count"), F.avg("label").alias("avglabel"), F.avg("n_tokens").alias("avgtoken"))
