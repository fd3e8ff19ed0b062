"""Relational term statistics against MLlib on the same rows."""

import math

from pyspark.ml.feature import IDF, CountVectorizer, CountVectorizerModel, StringIndexer
from pyspark.sql import functions as F

from starlens.functions import text
from starlens.operators import terms


def trigram_frame(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet").select("doc_id", "text")
    tok = docs.select("doc_id", text.tokenize("text").alias("w"))
    return text.with_ngrams(tok, "w", "g").select("doc_id", "g")


def test_vocabulary_matches_countvectorizer(spark, sf_small):
    """Same counts in the same order; MLlib leaves ties in RDD order, we
    break them by term, so only the full vocabulary is compared as a set."""
    g = trigram_frame(spark, sf_small)
    stats = {r.term: r["count"] for r in terms.term_document_stats(terms.term_frequencies(g, "doc_id", "g")).collect()}
    for size in (50, 1 << 18):
        ours = terms.vocabulary(g, "doc_id", "g", vocab_size=size).orderBy("vocab_index").collect()
        cv = list(CountVectorizer(inputCol="g", outputCol="tf", vocabSize=size).fit(g).vocabulary)
        assert [r["count"] for r in ours] == [stats[t] for t in cv]
        assert [r.term for r in ours] == sorted([r.term for r in ours], key=lambda t: (-stats[t], t))
    assert {r.term for r in ours} == set(cv)


def test_vocabulary_min_df(spark):
    df = spark.createDataFrame([(1, ["a", "a", "b"]), (2, ["b", "c"]), (3, ["b"])], "id int, g array<string>")
    v = terms.vocabulary(df, "id", "g", min_df=2)
    assert [(r.term, r["count"], r.df) for r in v.orderBy("vocab_index").collect()] == [("b", 3, 3)]
    frac = terms.vocabulary(df, "id", "g", min_df=0.5)
    assert [r.term for r in frac.collect()] == ["b"]


def test_idf_matches_mllib(spark):
    df = spark.createDataFrame([(1, ["a", "a", "b"]), (2, ["b", "c"]), (3, ["b"]), (4, [])],
                               "id int, g array<string>")
    tf = terms.term_frequencies(df, "id", "g")
    ours = {r.term: r.idf for r in terms.idf_table(tf, df.count()).collect()}
    cvm = CountVectorizer(inputCol="g", outputCol="tf").fit(df)
    idf = IDF(inputCol="tf", outputCol="x").fit(cvm.transform(df)).idf.toArray()
    for i, t in enumerate(cvm.vocabulary):
        assert math.isclose(ours[t], idf[i], rel_tol=1e-12)


def test_tfidf_salted_equals_plain(spark):
    rows = [(i, ["the"] * 3 + [f"w{i % 7}"]) for i in range(200)]
    df = spark.createDataFrame(rows, "id int, g array<string>")
    tf = terms.term_frequencies(df, "id", "g")
    idf = terms.idf_table(tf, 200)
    salted = terms.tfidf(tf, idf, "id", max_hot=10, rows_per_salt=50)
    plain = tf.join(idf.select("term", "idf"), "term").withColumn("tfidf", F.col("tf") * F.col("idf"))
    cols = ["id", "term", "tf", "tfidf"]
    assert salted.select(cols).exceptAll(plain.select(cols)).count() == 0
    assert salted.count() == plain.count()


def test_label_index_ties_and_mllib(spark):
    tie = spark.createDataFrame([(0,), (1,), (1,), (0,)], "y int")
    got = {r.label: r.label_index for r in terms.label_index(tie, "y").collect()}
    assert got == {"0": 0.0, "1": 1.0}
    skew = spark.createDataFrame([(0.0,), (1.0,), (1.0,)], "y double")
    ours = {r.label: r.label_index for r in terms.label_index(skew, "y").collect()}
    model = StringIndexer(inputCol="y", outputCol="i").fit(skew)
    assert ours == {lab: float(i) for i, lab in enumerate(model.labels)}


def test_top_terms_per_doc(spark):
    df = spark.createDataFrame([(1, "a", 3.0), (1, "b", 3.0), (1, "c", 1.0), (2, "z", 0.5)],
                               "id int, term string, w double")
    top = terms.top_terms_per_doc(df, "id", "w", 2)
    assert sorted((r.id, r.term, r["rank"]) for r in top.collect()) == [(1, "a", 1), (1, "b", 2), (2, "z", 1)]


def test_countvectorizer_model_vocab_is_list():
    assert hasattr(CountVectorizerModel, "vocabulary")
