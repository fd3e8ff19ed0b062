"""Row index, prefix sums, keyed split and AUC: exact and partition-invariant."""

import random
from collections import Counter

from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import Window
from pyspark.sql import functions as F

from starlens.operators import evaluate, ordering, split


def test_row_index_partition_invariant(spark):
    keys = list(range(0, 3000, 3))
    random.Random(7).shuffle(keys)
    df = spark.createDataFrame([(k, f"v{k}") for k in keys], "k int, v string")
    expected = {k: i + 1 for i, k in enumerate(sorted(keys))}
    for parts in (1, 8):
        got = ordering.with_row_index(df.repartition(parts), ["k"], partitions=parts)
        assert {r.k: r.row_index for r in got.collect()} == expected
    sl = ordering.row_slice(df, ["k"], 100, 105)
    assert sorted(r.row_index for r in sl.collect()) == [101, 102, 103, 104, 105]


def test_row_slice_of_ties_and_null_keys(spark):
    hot = [(7, "a", f"h{i}") for i in range(300)]
    rows = hot + [(i, None if i % 3 else "b", f"v{i}") for i in range(300)] * 2 + [(None, None, f"n{i}") for i in range(5)]
    random.Random(3).shuffle(rows)
    df = spark.createDataFrame(rows, "k int, l string, v string").repartition(5)
    for cols in (["k"], ["l"], ["k", "l"]):
        ranked = df.withColumn("row_index", F.row_number().over(Window.orderBy(*cols)))
        for lo, hi in ((0, 3), (2, 30), (100, 200), (890, 2000), (905, 910)):
            got = ordering.row_slice(df, cols, lo, hi).collect()
            want = ranked.where((F.col("row_index") > lo) & (F.col("row_index") <= hi)).collect()
            at = [(r.row_index, *[r[c] for c in cols]) for r in want]
            assert sorted(((r.row_index, *[r[c] for c in cols]) for r in got), key=lambda x: x[0]) == sorted(at, key=lambda x: x[0])
            assert not Counter((r.k, r.l, r.v) for r in got) - Counter(rows)  # no row twice


def test_prefix_sums(spark):
    rows = [(float(i), i % 3, 1) for i in range(500)]
    df = spark.createDataFrame(rows, "s double, a int, b int")
    got = ordering.prefix_sums(df, "s", ["a", "b"], partitions=7)
    w = Window.orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    ref = df.select("s", F.coalesce(F.sum("a").over(w), F.lit(0)).alias("a_before"),
                    F.coalesce(F.sum("b").over(w), F.lit(0)).alias("b_before"))
    assert got.select("s", "a_before", "b_before").exceptAll(ref).count() == 0
    assert got.count() == 500


def test_keyed_split_partition_invariant(spark):
    df = spark.range(2000).withColumnRenamed("id", "k")
    a = split.keyed_split(df.repartition(1), "k", 42, 0.7)[0]
    b = split.keyed_split(df.repartition(8), "k", 42, 0.7)[0]
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
    share = a.count() / 2000
    assert 0.65 < share < 0.75


def test_auc_matches_evaluator_and_ties(spark):
    rnd = random.Random(3)
    rows = [(float(rnd.random() < 0.4), round(rnd.random(), 2)) for _ in range(400)]
    df = spark.createDataFrame(rows, "label double, score double")
    ours = evaluate.auc(df).collect()[0].auc
    ev = BinaryClassificationEvaluator(rawPredictionCol="score", labelCol="label").evaluate(df)
    assert abs(ours - ev) < 1e-9
    tied = spark.createDataFrame([(1.0, 0.3), (0.0, 0.3), (1.0, 0.3), (0.0, 0.3)], "label double, score double")
    assert evaluate.auc(tied).collect()[0].auc == 0.5


def test_metrics_without_positive_predictions(spark):
    df = spark.createDataFrame([(1.0, 0.0), (0.0, 0.0)], "label double, prediction double")
    m = evaluate.binary_metrics(df).collect()[0]
    assert (m.tp, m.fp, m.tn, m.fn) == (0, 0, 1, 1)
    assert m.precision is None and m.recall == 0.0 and m.accuracy == 0.5


def test_confusion_matrix_zero_cells(spark):
    df = spark.createDataFrame([(1.0, 1.0), (1.0, 1.0), (0.0, 1.0)], "label double, prediction double")
    got = {r.label: (r.pred_0, r.pred_1) for r in evaluate.confusion_matrix(df).collect()}
    assert got == {1.0: (0, 2), 0.0: (0, 1)}


def test_slice_checkpoints_keys_only(spark):
    df = spark.range(300).selectExpr("id as k", "repeat('x', 1000) as wide")
    plan = ordering.row_slice(df, ["k"], 10, 20)._jdf.queryExecution().optimizedPlan().toString()
    checkpointed = [line for line in plan.splitlines() if "LogicalRDD" in line]
    assert checkpointed and all("wide" not in line for line in checkpointed)


def test_partition_count_follows_the_data(spark, sf_small):
    from starlens.session import size_partitions, source_bytes

    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    labels = spark.read.parquet(f"{sf_small}/labels.parquet")
    joined = docs.join(labels, "doc_id")
    assert 0 < source_bytes(joined) <= source_bytes(docs) + source_bytes(labels)
    assert size_partitions(docs) == 1
    assert size_partitions(docs, target_bytes=1000) > size_partitions(docs, target_bytes=100_000) > 1
    assert size_partitions(spark.createDataFrame([(1,)], "a int")) == 1


def test_duplicate_count_of_empty_table(spark):
    from starlens.operators import profile

    row = profile.duplicate_count(spark.createDataFrame([], "k int"), "k").collect()[0]
    assert (row.n_rows, row.n_distinct, row.n_duplicates) == (0, 0, 0)


def test_partition_count_behind_a_checkpoint_is_that_of_its_files(spark, sf_small):
    from starlens.session import size_partitions, source_bytes

    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    labels = spark.read.parquet(f"{sf_small}/labels.parquet")
    joined = docs.join(labels, "doc_id")
    kept = joined.checkpoint()
    whole = source_bytes(docs) + source_bytes(labels)
    assert 0 < source_bytes(kept) < 4 * whole
    assert 0 < source_bytes(docs.join(kept.select("doc_id"), "doc_id", "left_semi").checkpoint()) < 4 * whole
    again = kept.join(kept.select("doc_id").distinct(), "doc_id").checkpoint()
    assert size_partitions(again) <= 2 * size_partitions(joined)
