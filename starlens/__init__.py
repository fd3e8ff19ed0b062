"""starlens: review-style analytics on Spark.

Cleaning, labelling, profiling, grouped shares, text features and
sentiment / clustering models, each written as DataFrame -> DataFrame
functions over Spark SQL built-ins and MLlib.
"""

__version__ = "0.1.0"
