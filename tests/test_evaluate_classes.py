"""Cross tables and metrics over classes found in the data."""

import pytest
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.sql import functions as F

from starlens.operators import evaluate

ROWS = [("a", "a")] * 5 + [("a", "b")] * 2 + [("b", "b")] * 3 + [("b", None)] + [(None, "a")] * 2 + [("c", "a"), ("a", "z"), (None, None)]


@pytest.fixture
def pred(spark):
    return spark.createDataFrame(ROWS, "label string, prediction string")


def test_cells_add_up_to_all_rows(pred):
    cells = {(r.label, r.prediction): r["count"] for r in evaluate.cross_tab(pred).collect()}
    assert sum(cells.values()) == len(ROWS)
    assert cells == {p: ROWS.count(p) for p in set(ROWS)}


def test_wide_table_finds_its_columns(pred, spark):
    wide = evaluate.cross_tab_wide(pred)
    assert wide.columns == ["label", "(null)", "a", "b", "z"]
    got = {r.label: tuple(r)[1:] for r in wide.collect()}
    assert got == {"a": (0, 5, 2, 1), "b": (1, 0, 3, 0), "c": (0, 1, 0, 0), None: (1, 2, 0, 0)}
    with pytest.raises(ValueError, match="more than 2"):
        evaluate.cross_tab_wide(pred, max_classes=2)
    assert evaluate.cross_tab_wide(pred.limit(0)).collect() == []
    halves = spark.createDataFrame([(1.0, 1.5), (1.0, 1.0)], "label double, prediction double")
    assert evaluate.cross_tab_wide(halves).columns == ["label", "1.0", "1.5"]


def test_given_classes_lose_no_row_silently(spark):
    df = spark.createDataFrame([(1.0, 2.0), (0.0, 0.0)], "label double, prediction double")
    with pytest.raises(Exception, match="none of the given classes"):
        evaluate.confusion_matrix(df).collect()
    with pytest.raises(Exception, match="none of the given classes"):
        evaluate.confusion_matrix(df.withColumn("prediction", F.lit(None).cast("double"))).collect()
    assert evaluate.confusion_matrix(df, classes=(0.0, 1.0, 2.0)).columns == ["label", "pred_0", "pred_1", "pred_2"]
    assert evaluate.confusion_matrix(df, classes=(0.0, 1.5, 2.0)).columns == ["label", "pred_0", "pred_1.5", "pred_2"]


def test_class_metrics(pred):
    m = {r["class"]: r for r in evaluate.class_metrics(pred).collect()}
    assert (m["a"].actual, m["a"].predicted, m["a"].hits) == (8, 6, 5)
    assert m["b"].precision == pytest.approx(3 / 5) and m["b"].recall == pytest.approx(3 / 4)
    assert m["c"].precision is None and m["c"].recall == 0.0 and m["z"].recall is None
    assert evaluate.class_metrics(pred.limit(0)).collect() == []


def test_weighted_averages_equal_mllib(spark):
    rows = [(float(i % 4), float((i * i) % 5 % 4)) for i in range(200)]
    df = spark.createDataFrame(rows, "label double, prediction double")
    got = evaluate.averaged_metrics(df).collect()[0]
    for ours, theirs in (("accuracy", "accuracy"), ("weighted_precision", "weightedPrecision"), ("weighted_recall", "weightedRecall"),
                         ("weighted_f1", "f1")):
        assert got[ours] == pytest.approx(MulticlassClassificationEvaluator(metricName=theirs).evaluate(df))
