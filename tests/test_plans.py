"""Physical-plan properties that matter at scale."""

import __spark_entry__ as entry


def plan(df, mode="formatted"):
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), mode)


def test_flagship_pushes_filter_and_prunes_scan(spark, sf_small):
    p = plan(entry.queries()["share_by_group"](spark, sf_small))
    assert "PushedFilters: [Not(In(p_brand, [Brand#1,Brand#2]))]" in p
    assert "ReadSchema: struct<p_brand:string,p_size:int>" in p
    # partial aggregation before the only data shuffle
    assert p.count("HashAggregate") >= 2


def test_no_nested_loop_or_cartesian_joins(spark, sf_small):
    for name in ("join_inner_prefixed", "bucket_user", "tfidf_top_per_doc", "rating_histogram", "auc_rank"):
        p = plan(entry.queries()[name](spark, sf_small))
        assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p, name


def test_term_frequencies_reuse_document_partitioning(spark, sf_small):
    p = plan(entry.queries()["vocabulary_top"](spark, sf_small))
    # one exchange spreading the documents by doc_id (tiny test file) and one by term
    assert p.count("Exchange hashpartitioning") <= 2
    assert "hashpartitioning(term" in p


def test_distinct_by_key_is_aggregate_not_window(spark, sf_small):
    p = plan(entry.queries()["distinct_by_key"](spark, sf_small))
    assert "Window" not in p
    assert "partial_min" in p


def test_text_queries_use_no_python_udf(spark, sf_small):
    for name in ("tokenize", "stopwords", "trigram_counts", "idf_terms", "strip_punct"):
        p = plan(entry.queries()[name](spark, sf_small), "extended")
        assert "BatchEvalPython" not in p and "ArrowEvalPython" not in p and "PythonUDF" not in p, name


def test_stop_word_filter_is_hash_set(spark, sf_small):
    p = plan(entry.queries()["idf_terms"](spark, sf_small), "extended")
    assert "INSET" in p.upper()


def test_skew_safe_join_equals_plain_join(spark):
    from pyspark.sql import functions as F

    from starlens.operators.joins import prefixed_inner_join

    big = spark.range(5000).select((F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 50)).alias("k"),
                                   F.col("id").alias("v"))
    small = spark.range(50).select(F.col("id").alias("k"), (F.col("id") * 10).alias("w"))
    a = prefixed_inner_join(big, small, "k", "l_", "r_", skew_safe=True, max_hot=10, rows_per_salt=200)
    b = prefixed_inner_join(big, small, "k", "l_", "r_")
    assert a.count() == b.count() == 5000
    assert a.exceptAll(b).count() == 0


def test_hot_key_list_is_bounded(spark):
    from pyspark.sql import functions as F

    from starlens.operators.joins import hot_keys

    # 2000 keys with a heavy-tailed count: whatever the data, at most max_hot keys qualify.
    counts = spark.range(2000).select(F.col("id").alias("k"), (F.lit(100000) / (F.col("id") + 1)).cast("long").alias("n"))
    for max_hot in (1, 10, 100):
        assert hot_keys(counts, "k", "n", max_hot).count() <= max_hot


def test_spread_only_when_scan_is_narrow(spark, sf_small):
    from starlens.sources.tables import read_table, spread

    docs = read_table(spark, sf_small, "documents", "doc_id", "text")
    wide = docs.repartition(spark.sparkContext.defaultParallelism * 2)
    assert spread(wide, "doc_id") is wide
    narrow = docs.coalesce(1)
    assert spread(narrow, "doc_id").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def many_files(spark, scratch):
    """Documents in more files than there are cores, some ids twice or null."""
    rows = [(i % 55 if i % 20 else None, " ".join(f"w{(i * k) % 17}" for k in range(1, 30)) + f" only{i} of it", "en") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(9)
    df.write.parquet(f"{scratch}/documents.parquet")
    return rows


def test_trigrams_of_large_tables_are_counted_where_their_document_lies(spark, scratch, monkeypatch):
    from pyspark.sql import functions as F

    from starlens.operators import terms
    from starlens.plans import text

    many_files(spark, scratch)
    monkeypatch.setattr(text, "VOCAB_TOP", 40)
    before = spark.conf.get("spark.sql.files.openCostInBytes"), spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    try:
        got = entry.queries()["vocabulary_top"](spark, scratch)
        p = plan(got)
        assert "hashpartitioning(doc_id#" in p and "hashpartitioning(term#" in p
        assert not [x for x in p.splitlines() if "hashpartitioning(doc_id#" in x and "term#" in x.split("hashpartitioning", 1)[1]]
        assert "bucket" in p  # trigrams too rare for the list are not counted
        want = terms.vocabulary(text.trigrams(spark, scratch), "doc_id", "g", vocab_size=40)
        assert got.orderBy("vocab_index").collect() == want.orderBy("vocab_index").collect()
        top = entry.queries()["tfidf_top_per_doc"](spark, scratch)
        assert "ExistingRDD" not in plan(top)  # terms are written as columns, not as a checkpoint of rows
        tf, idf = text._tf_idf(spark, scratch)
        again = terms.top_terms_per_doc(terms.tfidf(tf, idf, "doc_id"), "doc_id", "tfidf", 5)
        again = again.select("doc_id", "term", "tf", F.round("tfidf", 6).alias("tfidf"), "rank")
        assert sorted(map(str, top.collect())) == sorted(map(str, again.collect()))
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", before[0])
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[1])


def test_sure_threshold_is_reached_by_the_wanted_terms(spark):
    from starlens.operators import heavy

    df = spark.createDataFrame([(i, [f"t{k}" for k in range(i % 30)]) for i in range(120)], "id long, g array<string>")
    for buckets in (1, 7, heavy.BUCKETS):
        for wanted in (1, 5, 29, 30):
            _, least = heavy.sure_threshold(df, "g", wanted, buckets)
            counts = sorted((4 * (29 - k) for k in range(29)), reverse=True)
            assert least <= (counts[wanted - 1] if wanted <= 29 else 1)
            assert wanted > 29 or least >= 1
