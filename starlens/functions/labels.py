"""Rating buckets, sentiment classes and binary labels (Column -> Column).

Ratings are compared as doubles (see ``clean.try_double``), never as
strings, so "4.5" is 4.5 and not a failed or truncated cast.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from starlens.functions._col import as_col

# Bucket names, lowest first.  A rating r falls in the
# half-open interval (k-1, k]; anything at or below 1, or null, is the
# lowest bucket.
STAR_BUCKETS = ["1 star", "2 star", "3 star", "4 star", "5 star"]
# Sentiment thresholds.
POSITIVE_AT = 4.0
NEGATIVE_AT = 2.0


def star_bucket(rating, buckets=STAR_BUCKETS) -> Column:
    """Bucket a numeric rating: (4,inf) -> last, (3,4] -> ..., else first."""
    r = as_col(rating)
    expr = None
    top = len(buckets) - 1
    for i in range(top, 0, -1):
        cond = r > float(i)
        expr = F.when(cond, F.lit(buckets[i])) if expr is None else expr.when(cond, F.lit(buckets[i]))
    return expr.otherwise(F.lit(buckets[0]))


def sentiment(rating, positive_at: float = POSITIVE_AT, negative_at: float = NEGATIVE_AT) -> Column:
    """positive (>= 4), negative (<= 2), neutral otherwise; null rating -> null."""
    r = as_col(rating)
    return (F.when(r >= positive_at, F.lit("positive"))
            .when(r <= negative_at, F.lit("negative"))
            .when(r.isNotNull(), F.lit("neutral")))


def binary_label(rating, positive_at: float = POSITIVE_AT, dtype: str = "int") -> Column:
    """1 when rating >= 4, 0 for any other parsed rating, null when unparsed."""
    r = as_col(rating)
    return F.when(r >= positive_at, F.lit(1)).when(r.isNotNull(), F.lit(0)).cast(dtype)


def rating_as_int(raw) -> Column:
    """Parse a rating string as a number and truncate it to int ("5.0" -> 5)."""
    return as_col(raw).try_cast("double").try_cast("int")
