"""Hand-made rows for every cleaning / labelling / text decision."""

from pyspark.ml.feature import NGram, StopWordsRemover, Tokenizer
from pyspark.sql import functions as F

from starlens.functions import clean, labels, text


def col_values(df, c):
    return [r[c] for r in df.collect()]


def test_star_bucket_fractional(spark):
    df = spark.createDataFrame([("5",), ("4.5",), ("4",), ("3.5",), ("1",), ("",), (None,)], "stars string")
    out = df.select(labels.star_bucket(clean.try_double("stars")).alias("b"))
    assert col_values(out, "b") == ["5 star", "5 star", "4 star", "4 star", "1 star", "1 star", "1 star"]


def test_scrubs(spark):
    df = spark.createDataFrame([("4.5 stars",), ("abc",), ('{"k": 69}',), (None,)], "s string")
    out = df.select(clean.scrub_decimal("s").alias("d"), clean.decimal_value("s").alias("v"),
                    clean.integer_value("s").alias("i"))
    rows = out.collect()
    assert [r.d for r in rows] == ["4.5", "", "69", None]
    assert [r.v for r in rows] == [4.5, None, 69.0, None]
    assert [r.i for r in rows] == [45, None, 69, None]


def test_sentiment_and_binary_label(spark):
    df = spark.createDataFrame([(4.0,), (2.0,), (2.5,), (3.0,), (None,)], "r double")
    assert col_values(df.select(labels.sentiment("r").alias("s")), "s") == \
        ["positive", "negative", "neutral", "neutral", None]
    raw = spark.createDataFrame([("5.0",), ("3",), ("x",), (None,)], "r string")
    out = raw.select(labels.binary_label(clean.try_double("r")).alias("l"), labels.rating_as_int("r").alias("i"))
    assert [(r.l, r.i) for r in out.collect()] == [(1, 5), (0, 3), (None, None), (None, None)]


def test_strip_punct_unicode(spark):
    df = spark.createDataFrame([("L'été, déjà!",), ("a_b-c 1.5",), (None,)], "t string")
    assert col_values(df.select(clean.strip_punct("t").alias("t")), "t") == ["Lété déjà", "a_bc 15", None]


def test_letters_only(spark):
    df = spark.createDataFrame([("Héllo, W0rld!",)], "t string")
    assert col_values(df.select(clean.letters_only("t").alias("t")), "t") == ["Hllo Wrld"]


def test_tokenize_edge_cases(spark):
    df = spark.createDataFrame([("A  b the ",), (" a",), ("",), ("   ",)], "t string")
    got = col_values(df.select(text.tokenize("t").alias("w")), "w")
    assert got == [["a", "", "b", "the"], ["", "a"], [""], []]


def test_tokenize_equals_mllib(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet").select("doc_id", "text")
    ours = docs.select("doc_id", text.tokenize("text").alias("ours"))
    ml = Tokenizer(inputCol="text", outputCol="ml").transform(docs).select("doc_id", "ml")
    diff = ours.join(ml, "doc_id").filter(F.col("ours") != F.col("ml")).count()
    assert diff == 0


def test_stop_words_equal_mllib(spark, sf_small):
    assert text.STOP_WORDS_EN == StopWordsRemover.loadDefaultStopWords("english")
    docs = spark.read.parquet(f"{sf_small}/documents.parquet").select("doc_id", "text")
    tok = docs.select("doc_id", text.tokenize("text").alias("w"))
    ours = tok.select("doc_id", text.remove_stop_words("w").alias("ours"))
    ml = StopWordsRemover(inputCol="w", outputCol="ml").transform(tok).select("doc_id", "ml")
    assert ours.join(ml, "doc_id").filter(F.col("ours") != F.col("ml")).count() == 0


def test_ngrams_short_and_equal_mllib(spark, sf_small):
    df = spark.createDataFrame([(["a", "b"],), (["a", "", "b", "c"],), ([],)], "w array<string>")
    assert col_values(df.select(text.ngrams("w", 3).alias("g")), "g") == [[], ["a  b", " b c"], []]
    docs = spark.read.parquet(f"{sf_small}/documents.parquet").select("doc_id", "text")
    tok = docs.select("doc_id", text.tokenize("text").alias("w"))
    ours = tok.select("doc_id", text.ngrams("w", 3).alias("ours"))
    ml = NGram(n=3, inputCol="w", outputCol="ml").transform(tok).select("doc_id", "ml")
    assert ours.join(ml, "doc_id").filter(F.col("ours") != F.col("ml")).count() == 0
    fast = text.with_ngrams(tok, "w", "fast").select("doc_id", "fast")
    assert ours.join(fast, "doc_id").filter(F.col("ours") != F.col("fast")).count() == 0
