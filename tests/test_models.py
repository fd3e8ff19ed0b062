"""MLlib model operators: fit on train only, consistent metrics, valid outputs."""

import math

import pytest
from pyspark.sql import functions as F

from starlens.operators import evaluate, models, split
from starlens.plans import entities as E

FEATURES = 1 << 10


@pytest.fixture(scope="module")
def labelled(spark, sf_small):
    return E.labelled_texts(spark, sf_small).persist()


def test_lr_train_test_and_probabilities(spark, labelled):
    train, test = split.keyed_split(labelled, "doc_id", 100, 0.7)
    assert train.join(test, "doc_id").count() == 0
    model = models.fit(models.lr_pipeline(num_features=FEATURES), train, "doc_id")
    pred = models.with_probabilities(model.transform(test))
    bad = pred.filter(F.abs(F.col("positive_prob") + F.col("negative_prob") - 1.0) > 1e-9).count()
    assert bad == 0
    rep = models.classifier_report(pred).collect()[0]
    acc = evaluate.accuracy(pred).collect()[0].accuracy
    assert math.isclose(rep.accuracy, acc)
    assert rep.tp + rep.fp + rep.tn + rep.fn == test.count()
    assert 0.0 <= rep.auc <= 1.0


def test_lr_fit_is_reproducible(spark, labelled):
    train, _ = split.keyed_split(labelled, "doc_id", 100, 0.7)
    a = models.fit(models.lr_pipeline(num_features=FEATURES), train, "doc_id").stages[-1].coefficients
    b = models.fit(models.lr_pipeline(num_features=FEATURES), train.repartition(3), "doc_id").stages[-1].coefficients
    assert a.toArray().tolist() == b.toArray().tolist()


def test_svm_trigram_and_term_weights(spark, labelled):
    data = labelled.withColumnRenamed("label", "label_raw")
    train, test = split.keyed_split(data, "doc_id", 12345, 0.7)
    model = models.fit(models.svm_trigram_pipeline(vocab_size=FEATURES, max_iter=5), train, "doc_id")
    pred = model.transform(test)
    assert pred.select("prediction").distinct().count() <= 2
    tw = models.term_weights(spark, model)
    assert tw.frame.count() == len(model.stages[2].vocabulary)
    top = models.top_weighted_terms(tw, 5).collect()
    assert len(top) == 10
    assert {r.for_class for r in top} == {tw.positive_class, tw.negative_class}


def test_kmeans_relabel_and_profile(spark, labelled):
    model = models.fit(models.kmeans_pipeline(k=2, num_features=FEATURES), labelled, "doc_id")
    clustered = models.assign_clusters(model, labelled, "doc_id")
    sizes = {r.prediction: r["count"] for r in clustered.groupBy("prediction").count().collect()}
    assert sum(sizes.values()) == labelled.count()
    assert sizes[0] >= sizes.get(1, 0)
    prof = models.cluster_profile(clustered).collect()
    assert sum(r["count"] for r in prof) == labelled.count()
    again = models.recluster(clustered, labelled, keep=0, k=2, key="doc_id", num_features=FEATURES)
    assert again.count() == sizes[0]


def test_fit_drops_null_text_and_label(spark):
    rows = [(i, f"good day {i % 7} x", float(i % 2)) for i in range(60)] + [(90, None, 1.0), (91, "some text", None), (92, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, label double")
    for pipeline in (models.lr_pipeline(num_features=64), models.svm_unigram_pipeline(num_features=64)):
        assert models.fit_inputs(pipeline, df).count() == 60
        models.fit(pipeline, df, "doc_id")
    raw = df.withColumnRenamed("label", "label_raw")
    assert models.fit_inputs(models.svm_trigram_pipeline(vocab_size=64), raw).count() == 60
    models.fit(models.svm_trigram_pipeline(vocab_size=64, max_iter=2), raw, "doc_id")
    model = models.fit(models.kmeans_pipeline(k=2, num_features=64), df.drop("label").withColumn("label", F.lit(1.0)), "doc_id")
    assert models.assign_clusters(model, df, "doc_id").count() == 61


def test_solver_sends_two_gradients_to_the_driver_whatever_the_size(spark, monkeypatch):
    """MLlib's tree sums n partitions in levels of ceil(n ** (1 / depth)) until a level saves nothing."""
    df, before = spark.range(1), 0
    for gb in (0, 0.005, 0.1, 1, 6, 60, 600):
        monkeypatch.setattr(models, "size_partitions", lambda _, target: max(1, math.ceil(gb * 4e9 / target)))
        n, depth = models.solver_layout(df)
        assert before <= n <= 2 + 3 * gb * 4e9 / models.SOLVER_BYTES  # no faster than the input
        before = left = n
        scale = max(2, math.ceil(n ** (1 / depth)))
        while left > scale + math.ceil(left / scale):
            left //= scale
        assert left == min(2, n) and (n > 1 or gb < 0.01)


def test_fit_runs_the_solver_on_its_own_partitions(spark, monkeypatch):
    rows = [(i, f"good day {i % 7} x", float(i % 2)) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, label double")
    want = models.fit(models.lr_pipeline(num_features=64), df, "doc_id").stages[-1].coefficients.toArray()
    seen = []
    fit = models.LogisticRegression._fit
    monkeypatch.setattr(models.LogisticRegression, "_fit", lambda self, x: seen.append((x.rdd.getNumPartitions(), self.getAggregationDepth())) or fit(self, x))
    monkeypatch.setattr(models, "size_partitions", lambda _, target: 13 if target == models.FIT_BYTES else 5)
    got = models.fit(models.lr_pipeline(num_features=64), df, "doc_id").stages[-1].coefficients.toArray()
    assert seen == [(6, 2)]
    assert got.tolist() == pytest.approx(want.tolist(), abs=1e-9)


def test_vocabulary_of_a_fit_breaks_ties_by_term(spark):
    rows = [(i, ["often"] + [f"t{(i * 7 + k) % 50:02d}" for k in range(5)]) for i in range(50)]
    df = spark.createDataFrame(rows, "id long, g array<string>").repartition(8, "id")
    fitted = models.fit_vocabulary(models.CountVectorizer(inputCol="g", outputCol="n", vocabSize=11), df)
    assert sorted(fitted.vocabulary) == ["often"] + [f"t{k:02d}" for k in range(10)]
    counts = fitted.transform(df).select("n").first().n
    assert counts.size == 11
