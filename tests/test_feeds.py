"""All review feeds from one grouped table."""

import pytest
from pyspark.sql import functions as F

from starlens.operators import shares
from starlens.plans import QUERIES, eda


def rows(df):
    return sorted(map(str, df.collect()))


def test_feeds_equal_the_single_queries(spark, sf_small):
    g = eda.review_feeds(spark, sf_small)
    stars = shares.feed_rows(g, "stars", "stars", "count")
    assert rows(stars) == rows(QUERIES["rating_histogram"](spark, sf_small).where("count > 0"))
    triples = shares.feed_rows(g, "engagement", "useful", "funny", "cool", "count")
    assert rows(triples) == rows(QUERIES["group_count_three"](spark, sf_small))
    sums = shares.feed_rows(g, "sentiment", "sentiment", "useful_count", "cool_count", "funny_count", F.col("count").alias("total_count"))
    assert rows(sums) == rows(QUERIES["engagement_by_sentiment"](spark, sf_small))
    assert shares.feed_rows(g, "total", "count").collect()[0][0] == spark.read.parquet(f"{sf_small}/lineitem.parquet").count()


@pytest.mark.parametrize("name", ["review_feeds", "dashboard"])
def test_one_scan_and_the_fact_is_not_expanded(spark, sf_small, name):
    plan = QUERIES[name](spark, sf_small)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1
    assert plan.index("Expand") < plan.index("partial_count")  # above the first aggregate


def test_a_null_key_is_not_a_left_out_key(spark):
    df = spark.createDataFrame([("x", 1, 2), (None, 1, 3), (None, None, 4)], "a string, b int, v int")
    g = shares.grouping_feeds(df, {"by_a": ["a"], "by_b": ["b"], "all": []}, ["v"])
    got = {(r.feed, r.a, r.b): (r["count"], r.v) for r in g.collect()}
    assert got == {("by_a", "x", None): (1, 2), ("by_a", None, None): (2, 7), ("by_b", None, 1): (2, 5), ("by_b", None, None): (1, 4),
                   ("all", None, None): (3, 9)}
    with pytest.raises(ValueError):
        shares.grouping_feeds(df, {"one": ["a", "b"], "two": ["b", "a"]})
