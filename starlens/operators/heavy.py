"""The most frequent terms without shuffling every term.

Terms are hashed into a fixed number of buckets and only the buckets'
counts are shuffled.  They add up over any parts of the input, and a bucket's
count is an upper bound of each of its terms'.  Exact counts are then taken
for the terms of buckets that reach a threshold, no others.  If the last of
the wanted terms reaches the threshold too, no term that was left out can be
among them: each has fewer occurrences than its bucket, which has fewer than
the threshold.  If it does not, its exact count is itself a lower bound of
the true last count, so a second count with it as threshold settles the
matter; where too few terms were found, all are counted.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from starlens.operators.terms import explode_array, term_document_stats
from starlens.session import shared_path

BUCKETS = 1 << 20


def _written(df: DataFrame, name: str) -> DataFrame:
    path = shared_path(df.sparkSession, "heavy", f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucket_of(term: Column | str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def frequency_sketch(df: DataFrame, terms_col: str, buckets: int = BUCKETS) -> DataFrame:
    """``(bucket, n)``: occurrences of all terms of a bucket; at most ``buckets`` rows."""
    terms = df.select(explode_array(terms_col).alias("term"))
    return terms.groupBy(bucket_of("term", buckets).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def merge_sketches(*sketches: DataFrame) -> DataFrame:
    """The sketch of all inputs together; all must have the same number of buckets."""
    whole = sketches[0]
    for s in sketches[1:]:
        whole = whole.unionByName(s)
    return whole.groupBy("bucket").agg(F.sum("n").alias("n"))


def heavy_pairs(pairs: DataFrame, sketch: DataFrame, threshold: int, buckets: int = BUCKETS, term: str = "term") -> DataFrame:
    """Rows of ``pairs`` whose term's bucket reaches the threshold."""
    heavy = sketch.where(F.col("n") >= threshold).select("bucket")
    # at most ``buckets`` integers
    return pairs.withColumn("bucket", bucket_of(term, buckets)).join(F.broadcast(heavy), "bucket", "left_semi").drop("bucket")


def _counted(df: DataFrame, id_col: str, terms_col: str, sketch: DataFrame, threshold: int, buckets: int) -> DataFrame:
    """Exact ``(term, count, df)`` of all terms whose bucket reaches the threshold."""
    inside = heavy_pairs(df.select(id_col, explode_array(terms_col).alias("term")), sketch, threshold, buckets)
    tf = inside.groupBy(id_col, "term").agg(F.count(F.lit(1)).alias("tf"))
    return term_document_stats(tf)


def sure_threshold(df: DataFrame, terms_col: str, wanted: int, buckets: int = BUCKETS) -> tuple[DataFrame, int]:
    """A sketch of ``df`` and a count that its ``wanted`` most frequent terms reach.

    The exact count of the last of ``wanted`` terms, whichever they are, is
    such a count; they are looked for in the heaviest buckets.
    """
    sketch = _written(frequency_sketch(df, terms_col, buckets), "sketch")
    guess = sketch.orderBy(F.col("n").desc()).limit(2 * wanted).agg(F.min("n")).first()[0] or 1
    some = heavy_pairs(df.select(explode_array(terms_col).alias("term")), sketch, guess, buckets)
    counts = some.groupBy("term").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc()).limit(wanted)
    found, last = counts.agg(F.count(F.lit(1)), F.min("n")).first()
    return sketch, last if found == wanted else 1


def heavy_vocabulary(df: DataFrame, id_col: str, terms_col: str, vocab_size: int, min_df: int = 1,
                     buckets: int = BUCKETS, sketch: DataFrame | None = None) -> DataFrame:
    """The rows of ``terms.vocabulary``: top terms by count, ties by term, with count, df and rank.

    ``sketch`` is a :func:`frequency_sketch` of ``df``, if there is one
    already. Terms held by fewer than ``min_df`` documents do not count.
    """
    sketch = _written(frequency_sketch(df, terms_col, buckets) if sketch is None else sketch, "sketch")
    order = [F.col("count").desc(), F.col("term")]
    # a bucket may hold a few of the terms, or none: look at twice as many buckets as terms
    guess = sketch.orderBy(F.col("n").desc()).limit(2 * vocab_size).agg(F.min("n")).first()[0] or 1

    def top(threshold: int) -> DataFrame:
        exact = _counted(df, id_col, terms_col, sketch, threshold, buckets).where(F.col("df") >= min_df)
        return _written(exact.orderBy(*order).limit(vocab_size), "top")

    found = top(guess)
    n, last = found.agg(F.count(F.lit(1)), F.min("count")).first()
    sure = guess <= 1 or (n == vocab_size and last >= guess)
    if not sure:
        found = top(last if n == vocab_size else 1)
    # at most vocab_size rows
    return found.withColumn("vocab_index", (F.row_number().over(Window.orderBy(*order)) - 1).cast("int"))
