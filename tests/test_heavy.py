"""Top terms through a sketch equal a full count, also where the sketch rules out nothing."""

import random

import pytest
from pyspark.sql import functions as F

from starlens.operators import heavy, terms


@pytest.fixture(scope="module")
def docs(spark):
    g = random.Random(5)
    words = [f"w{i}" for i in range(3000)]
    rows = [(d, [words[min(2999, int(g.paretovariate(0.7)) - 1)] for _ in range(60)] + ["same"] * (d % 3)) for d in range(400)]
    rows += [(9001, []), (9002, None), (9003, ["tie1", "tie2"] * 5)]
    return spark.createDataFrame(rows, "doc_id long, t array<string>").repartition(6).persist()


def rows(df):
    return [tuple(r) for r in df.orderBy("vocab_index").collect()]


@pytest.mark.parametrize("size", [1, 20, 200, 100_000])
@pytest.mark.parametrize("buckets", [1, 50, 4096, heavy.BUCKETS])
def test_same_rows_as_the_full_count(docs, size, buckets):
    assert rows(heavy.heavy_vocabulary(docs, "doc_id", "t", size, buckets=buckets)) == rows(terms.vocabulary(docs, "doc_id", "t", size))


def test_min_df_and_empty(docs):
    want = rows(terms.vocabulary(docs, "doc_id", "t", 30, min_df=40))
    assert rows(heavy.heavy_vocabulary(docs, "doc_id", "t", 30, min_df=40, buckets=512)) == want
    assert rows(heavy.heavy_vocabulary(docs.limit(0), "doc_id", "t", 30)) == []


def test_sketches_merge_and_bound_every_term(docs):
    parts = [heavy.frequency_sketch(docs.where(F.col("doc_id") % 2 == k), "t", 128) for k in (0, 1)]
    whole = {r.bucket: r.n for r in heavy.frequency_sketch(docs, "t", 128).collect()}
    assert {r.bucket: r.n for r in heavy.merge_sketches(*parts).collect()} == whole
    exact = terms.vocabulary(docs, "doc_id", "t", 1 << 18).withColumn("b", heavy.bucket_of("term", 128)).collect()
    assert all(r["count"] <= whole[r.b] for r in exact)


def test_second_count_when_the_guess_was_too_high(spark):
    # two heavy buckets would do for one term, but the heaviest hold many rare terms
    rare = [f"r{i}" for i in range(4000)]
    df = spark.createDataFrame([(i, rare[i * 40:(i + 1) * 40]) for i in range(100)] + [(200 + i, ["top"]) for i in range(30)],
                               "doc_id long, t array<string>")
    got = heavy.heavy_vocabulary(df, "doc_id", "t", 1, buckets=40).collect()
    assert [(r.term, r["count"], r.df) for r in got] == [("top", 30, 30)]
