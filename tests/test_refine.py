"""The refinement tree against fits from the texts, and its shape."""

import pytest
from pyspark.sql import functions as F

from starlens.operators import models, refine
from starlens.plans import entities as E

FEATURES = 1 << 12


@pytest.fixture(scope="module")
def data(spark):
    return E.labelled_texts(spark, "/root/testdata/sf0.01").persist()


def sizes(df, col="prediction"):
    return {r[col]: r["count"] for r in df.groupBy(col).count().collect()}


def test_levels_equal_fits_from_the_texts(spark, data):
    first = models.assign_clusters(models.fit(models.kmeans_pipeline(k=2, num_features=FEATURES), data, "doc_id"), data, "doc_id")
    second = models.recluster(first, data, keep=0, k=3, key="doc_id", num_features=FEATURES)
    features = refine.feature_table(data, "doc_id", num_features=FEATURES)
    tree = refine.refinement_tree(features, "doc_id", (2, 3))
    got = sizes(tree, "path")
    assert got == {"1": sizes(first)[1], **{f"0/{k}": n for k, n in sizes(second).items()}}
    assert tree.select("doc_id").distinct().count() == data.count() == tree.count()


def test_no_text_is_read_after_the_features(spark, data):
    features = refine.feature_table(data, "doc_id", num_features=FEATURES)
    plan = refine.split_level(features, 2, "doc_id")._jdf.queryExecution().optimizedPlan().toString()
    assert "text" not in plan and "documents" not in plan


def test_small_levels_end_the_tree(spark):
    rows = [(1, "aa bb", 1.0), (2, "aa bb cc", 0.0), (3, "zz yy", 1.0), (4, None, 1.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, label double")
    features = refine.feature_table(df, "doc_id", num_features=64)
    tree = refine.refinement_tree(features, "doc_id", (2, 5))
    assert set(sizes(tree, "path")) == {"0", "1"} and tree.count() == 3
    assert refine.path_profile(tree).agg(F.sum("count")).first()[0] == 3
