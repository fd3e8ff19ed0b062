"""Bindings of the review-analytics entities to the driver's tables.

| entity    | table(s)              | mapping                                              |
|-----------|-----------------------|------------------------------------------------------|
| review    | lineitem (+ orders)   | rating = ceil(l_quantity / 10) in 1..5; business =   |
|           |                       | l_partkey; useful/funny/cool = discount%, tax%, line |
| business  | part                  | id = p_partkey, rating = p_size / 10, state = brand  |
| user      | customer ⋈ reviews    | average rating of the user's reviews; elite flag =   |
|           |                       | c_mktsegment with sentinel 'BUILDING'                |
| text      | documents ⋈ labels    | text with a 0/1 quality label                        |

Every binding selects only the columns it needs right after the read,
so scans are pruned.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starlens.sources.tables import read_table, spread

# States left out of the state x bucket chart, and the
# "not elite" sentinel of the user table.
EXCLUDED_STATES = ["Brand#1", "Brand#2"]
NON_ELITE = "BUILDING"


def review_rating(quantity="l_quantity"):
    return F.ceil(F.col(quantity) / F.lit(10.0)).cast("double")


def reviews(spark: SparkSession, d: str) -> DataFrame:
    li = read_table(spark, d, "lineitem", "l_orderkey", "l_partkey", "l_linenumber",
                    "l_quantity", "l_discount", "l_tax")
    return li.select(
        F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("review_id"),
        F.col("l_orderkey").alias("order_id"),
        F.col("l_partkey").alias("business_id"),
        review_rating().alias("stars"),
        F.round(F.col("l_discount") * 100).cast("int").alias("useful"),
        F.round(F.col("l_tax") * 100).cast("int").alias("funny"),
        F.col("l_linenumber").alias("cool"),
    )


def businesses(spark: SparkSession, d: str) -> DataFrame:
    p = read_table(spark, d, "part", "p_partkey", "p_size", "p_brand")
    return p.select(F.col("p_partkey").alias("business_id"),
                    (F.col("p_size").cast("double") / F.lit(10.0)).alias("stars"),
                    F.col("p_brand").alias("state"))


def user_average_stars(spark: SparkSession, d: str) -> DataFrame:
    """Average review rating per user.

    Ratings are pre-aggregated per order (sum, count) before the join to
    orders, so the join sees one row per order; the orderkey partitioning
    of that aggregate is reused by the join.  The final per-user average
    is partially aggregated, so a user with a third of all orders costs
    one row per task in the shuffle.
    """
    li = read_table(spark, d, "lineitem", "l_orderkey", "l_quantity")
    per_order = li.groupBy("l_orderkey").agg(F.sum(review_rating()).alias("s"), F.count(F.lit(1)).alias("n"))
    orders = read_table(spark, d, "orders", "o_orderkey", "o_custkey")
    joined = per_order.join(orders, per_order.l_orderkey == orders.o_orderkey, "inner")
    return (joined.groupBy(F.col("o_custkey").alias("user_id"))
            .agg((F.sum("s") / F.sum("n")).alias("average_stars")))


def users(spark: SparkSession, d: str) -> DataFrame:
    c = read_table(spark, d, "customer", "c_custkey", "c_mktsegment")
    avg = user_average_stars(spark, d)
    return (c.select(F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("elite"))
            .join(avg, "user_id", "left"))


def texts(spark: SparkSession, d: str) -> DataFrame:
    """All documents (whole texts), spread over the cores for text work."""
    return spread(read_table(spark, d, "documents", "doc_id", "text", "lang"), "doc_id")


def texts_by_id(spark: SparkSession, d: str) -> DataFrame:
    """All documents, hash-partitioned by id: what is grouped by id and more later moves no further.

    Whole texts are the smallest form to move; their terms are several times larger.
    """
    return read_table(spark, d, "documents", "doc_id", "text", "lang").repartition("doc_id")


def labelled_texts(spark: SparkSession, d: str) -> DataFrame:
    """Documents with a 0/1 quality label (double, as MLlib expects)."""
    docs = spread(read_table(spark, d, "documents", "doc_id", "text"), "doc_id")
    lab = read_table(spark, d, "labels", "doc_id", "quality")
    return docs.join(lab, "doc_id", "inner").select("doc_id", "text", F.col("quality").cast("double").alias("label"))
