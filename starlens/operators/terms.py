"""Term statistics: frequencies, vocabulary, IDF, TF-IDF, label index.

Relational twins of MLlib's CountVectorizer / IDF / StringIndexer that
keep the term (not a hashed index) and scale as joins and aggregations:

* every per-term aggregate is first reduced per (document, term), then
  per term with map-side partial aggregation, so a term present in a
  third of all documents costs one row per task in the shuffle;
* the TF-IDF join on term salts the hot terms (``joins.salted_join``);
* top-k results are ordered limits (``TakeOrderedAndProject``) or
  per-document ``row_number`` limits, never a global sort into one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from starlens.operators.joins import ROWS_PER_SALT, hot_keys, salted_join


def explode_array(arr) -> F.Column:
    """``explode`` that evaluates its array once per row.

    Under whole-stage codegen, exploding the result of a UDF or of an
    interpreted higher-order function directly re-evaluates it for every
    element (quadratic in the document length).  Passing it through
    ``slice`` first materialises the array once.
    """
    a = F.col(arr) if isinstance(arr, str) else arr
    return F.explode(F.slice(a, 1, F.size(a)))


def term_pairs(df: DataFrame, id_col: str, terms_col, term: str = "term",
               exclude=None) -> DataFrame:
    """(id, term) for every token; ``exclude`` drops listed terms after the
    explode (a hash-set ``InSet`` filter, compiled code)."""
    pairs = df.select(id_col, explode_array(terms_col).alias(term))
    return pairs.filter(~F.col(term).isin(list(exclude))) if exclude else pairs


def term_frequencies(df: DataFrame, id_col: str, terms_col, term: str = "term",
                     exclude=None) -> DataFrame:
    """(id, term, tf): occurrences of each term in each document.

    When ``df`` is hash-partitioned by ``id_col`` (see ``tables.spread``)
    this aggregation needs no shuffle.
    """
    return _counted(term_pairs(df, id_col, terms_col, term, exclude), id_col, term)


def _counted(pairs: DataFrame, id_col: str, term: str) -> DataFrame:
    return pairs.groupBy(id_col, term).agg(F.count(F.lit(1)).alias("tf"))


def term_document_stats(tf: DataFrame, term: str = "term") -> DataFrame:
    """(term, count, df): total occurrences and number of documents per term."""
    return tf.groupBy(term).agg(F.sum("tf").alias("count"), F.count(F.lit(1)).alias("df"))


def vocabulary(df: DataFrame, id_col: str, terms_col: str, vocab_size: int = 1 << 18,
               min_df: float = 1.0, term: str = "term", keep=None) -> DataFrame:
    """Top ``vocab_size`` terms by total count (ties by term), with their index.

    CountVectorizer's vocabulary has the same counts in the same order but
    leaves ties in RDD order; breaking them by term makes the vocabulary
    (and the feature indices) reproducible.

    ``min_df`` >= 1 is a document count, below 1 a fraction of documents
    (CountVectorizer's rule).  The index is the rank in the vocabulary.
    ``keep`` takes (id, term) pairs and leaves out terms that are known not
    to be in the vocabulary (see ``heavy``), all pairs of a term or none.
    """
    pairs = term_pairs(df, id_col, terms_col, term)
    stats = term_document_stats(_counted(keep(pairs) if keep else pairs, id_col, term), term)
    if min_df < 1.0:
        least = F.lit(min_df) * df.agg(F.count_distinct(id_col)).scalar()
    else:
        least = F.lit(min_df)
    kept = stats.filter(F.col("df") >= least)
    top = kept.orderBy(F.col("count").desc(), F.col(term)).limit(vocab_size)
    # At most vocab_size rows: the ranking window runs on the bounded top list.
    w = Window.orderBy(F.col("count").desc(), F.col(term))
    return top.withColumn("vocab_index", (F.row_number().over(w) - 1).cast("int"))


def idf_table(tf: DataFrame, n_docs, term: str = "term") -> DataFrame:
    """(term, df, idf) with idf = ln((n_docs + 1) / (df + 1)), MLlib's smoothing.

    ``n_docs`` is a Column (e.g. a scalar subquery) or a number.
    """
    n = n_docs if isinstance(n_docs, F.Column) else F.lit(n_docs)
    stats = tf.groupBy(term).agg(F.count(F.lit(1)).alias("df"))
    return stats.withColumn("idf", F.ln((n + F.lit(1.0)) / (F.col("df") + F.lit(1.0))))


def tfidf(tf: DataFrame, idf: DataFrame, id_col: str, term: str = "term",
          max_hot: int = 1000, rows_per_salt: int = ROWS_PER_SALT) -> DataFrame:
    """(id, term, tf, idf, tfidf).

    The join key ``term`` is skewed by nature; terms whose document
    frequency is at least 1/max_hot of all (document, term) pairs are
    salted by their counts.  ``idf.df`` is exactly the number of
    big-side rows per term, so no extra pass is needed to find them.
    """
    hot = hot_keys(idf.select(term, "df"), term, "df", max_hot)
    joined = salted_join(tf, idf.select(term, "idf"), term, hot, rows_per_salt, spread_cols=[id_col])
    return joined.withColumn("tfidf", F.col("tf") * F.col("idf"))


def top_terms_per_doc(weights: DataFrame, id_col: str, weight_col: str, k: int,
                      term: str = "term") -> DataFrame:
    """The k highest-weighted terms of each document (ties by term).

    Spark plans ``row_number() <= k`` as a per-task group limit before the
    shuffle, so each document ships at most k rows per task.
    """
    w = Window.partitionBy(id_col).orderBy(F.col(weight_col).desc(), F.col(term))
    return weights.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def label_index(df: DataFrame, label_col: str, out: str = "label_index") -> DataFrame:
    """StringIndexer's mapping: most frequent label first, ties alphabetical.

    Labels are compared as strings, as StringIndexer does.  The window
    runs on one row per distinct label (a small, bounded set of classes).
    """
    counts = df.groupBy(F.col(label_col).cast("string").alias("label")).agg(F.count(F.lit(1)).alias("count"))
    counts = counts.filter(F.col("label").isNotNull())
    w = Window.orderBy(F.col("count").desc(), F.col("label"))
    return counts.withColumn(out, (F.row_number().over(w) - 1).cast("double"))
