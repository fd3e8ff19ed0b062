"""Classifier evaluation: confusion matrix, binary metrics, AUC, accuracy.

Each metric table is one aggregation job over the predictions (the
reference ran one filter+count job per cell).  Divisions are
``try_divide``: a metric with a zero denominator is null, not an error.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starlens.operators.ordering import prefix_sums
from starlens.session import ensure_checkpoint_dir


def confusion_matrix(pred: DataFrame, label_col: str = "label", prediction_col: str = "prediction",
                     classes: Sequence[float] = (0.0, 1.0)) -> DataFrame:
    """One row per true label, one column per predicted class (counts, 0 when absent).

    For classes known beforehand. A prediction that is null or none of them
    fails the query; ``cross_tab`` counts whatever classes there are.
    """
    names = [f"pred_{int(c)}" if c == int(c) else f"pred_{c}" for c in classes]
    p = F.col(prediction_col)
    cells = pred.groupBy(F.col(label_col).alias("label")).agg(
        F.count(F.lit(1)).alias("__n"), *[F.count_if(p == F.lit(c)).alias(n) for c, n in zip(classes, names)])
    inside = F.assert_true(F.col("__n") == sum(F.col(f"`{n}`") for n in names), "a prediction is none of the given classes")
    return cells.withColumn("__ok", inside).where(F.col("__ok").isNull()).select("label", *[F.col(f"`{n}`") for n in names])


NULL_CLASS = "(null)"
MAX_CLASSES = 1000


def cross_tab(pred: DataFrame, label_col: str = "label", prediction_col: str = "prediction") -> DataFrame:
    """``(label, prediction, count)`` for every pair of classes in the data, nulls included.

    One partially aggregated pass whatever the classes; the counts add up to
    all rows.
    """
    return (pred.groupBy(F.col(label_col).alias("label"), F.col(prediction_col).alias("prediction"))
            .agg(F.count(F.lit(1)).alias("count")))


def cross_tab_wide(pred: DataFrame, label_col: str = "label", prediction_col: str = "prediction",
                   max_classes: int = MAX_CLASSES) -> DataFrame:
    """The cross table with a column per predicted class, found in the data and sorted; null is ``(null)``.

    Columns must be known before the query runs, so the long counts are
    materialised and their classes, at most ``max_classes``, come to the
    driver; more raise a ``ValueError``.
    """
    ensure_checkpoint_dir(pred.sparkSession)
    name = F.coalesce(F.col("prediction").cast("string"), F.lit(NULL_CLASS))
    cells = cross_tab(pred, label_col, prediction_col).withColumn("prediction", name).checkpoint()
    found = [r[0] for r in cells.select("prediction").distinct().orderBy("prediction").limit(max_classes + 1).collect()]
    if len(found) > max_classes:
        raise ValueError(f"more than {max_classes} predicted classes; use cross_tab")
    wide = [F.coalesce(F.sum(F.when(F.col("prediction") == F.lit(c), F.col("count"))), F.lit(0)).cast("bigint").alias(c) for c in found]
    return cells.groupBy("label").agg(*wide) if wide else cells.select("label")


def class_metrics(pred: DataFrame, label_col: str = "label", prediction_col: str = "prediction") -> DataFrame:
    """Per class found as label or prediction: actual, predicted and hit rows, precision, recall, F1.

    Rows with a null label are not judged; a null prediction is a miss of
    its label and no class. A metric with a zero denominator is null.
    """
    cells = cross_tab(pred, label_col, prediction_col).where(F.col("label").isNotNull())
    sides = F.array(F.struct(F.col("label").alias("class"), F.col("count").alias("actual"), F.lit(0).cast("bigint").alias("predicted"),
                             F.when(F.col("label") == F.col("prediction"), F.col("count")).otherwise(0).alias("hits")),
                    F.struct(F.col("prediction").alias("class"), F.lit(0).cast("bigint").alias("actual"),
                             F.col("count").alias("predicted"), F.lit(0).cast("bigint").alias("hits")))
    per = (cells.select(F.explode(sides).alias("s")).select("s.*").where(F.col("class").isNotNull())
           .groupBy("class").agg(F.sum("actual").alias("actual"), F.sum("predicted").alias("predicted"), F.sum("hits").alias("hits")))
    hits, actual, predicted = (F.col(c).cast("double") for c in ("hits", "actual", "predicted"))
    return (per.withColumn("precision", F.try_divide(hits, predicted)).withColumn("recall", F.try_divide(hits, actual))
            .withColumn("f1", F.try_divide(2 * hits, actual + predicted)))


def averaged_metrics(pred: DataFrame, label_col: str = "label", prediction_col: str = "prediction") -> DataFrame:
    """Accuracy, and precision, recall and F1 averaged over the classes that occur as labels.

    ``weighted_`` averages weigh a class by its rows, as MLlib's evaluator
    does; ``macro_`` averages count classes alike. A null metric counts as 0.
    """
    per = class_metrics(pred, label_col, prediction_col).where(F.col("actual") > 0)
    total = F.sum("actual")
    value = {m: F.coalesce(F.col(m), F.lit(0.0)) for m in ("precision", "recall", "f1")}
    return per.agg(
        total.alias("n"), F.count(F.lit(1)).alias("n_classes"), F.try_divide(F.sum("hits").cast("double"), total).alias("accuracy"),
        *[F.try_divide(F.sum(v * F.col("actual")), total).alias(f"weighted_{m}") for m, v in value.items()],
        *[F.avg(v).alias(f"macro_{m}") for m, v in value.items()])


def binary_metrics(pred: DataFrame, label_col: str = "label", prediction_col: str = "prediction") -> DataFrame:
    y, p = F.col(label_col), F.col(prediction_col)
    m = pred.agg(
        F.count_if((y == 1.0) & (p == 1.0)).alias("tp"),
        F.count_if((y == 0.0) & (p == 1.0)).alias("fp"),
        F.count_if((y == 0.0) & (p == 0.0)).alias("tn"),
        F.count_if((y == 1.0) & (p == 0.0)).alias("fn"),
        F.count(F.lit(1)).alias("n"),
    )
    tp, fp, tn, fn = (F.col(c).cast("double") for c in ("tp", "fp", "tn", "fn"))
    m = (m.withColumn("accuracy", F.try_divide(tp + tn, F.col("n").cast("double")))
         .withColumn("precision", F.try_divide(tp, tp + fp))
         .withColumn("recall", F.try_divide(tp, tp + fn)))
    return m.withColumn("f1", F.try_divide(F.lit(2.0) * F.col("precision") * F.col("recall"),
                                           F.col("precision") + F.col("recall")))


def accuracy(pred: DataFrame, label_col: str = "label", prediction_col: str = "prediction") -> DataFrame:
    return pred.agg(F.avg((F.col(label_col) == F.col(prediction_col)).cast("double")).alias("accuracy"),
                    F.count(F.lit(1)).alias("n"))


def auc(pred: DataFrame, label_col: str = "label", score_col: str = "score") -> DataFrame:
    """Exact area under the ROC curve by the rank-sum rule, ties counted half.

    AUC = sum over positives of (#negatives scored lower + #tied / 2) / (P * N).
    Predictions are first reduced to one row per distinct score; the
    "negatives scored lower" count is a distributed prefix sum.
    """
    y = F.col(label_col)
    per_score = pred.groupBy(F.col(score_col).alias("_score")).agg(
        F.count_if(y == 1.0).alias("npos"), F.count_if(y == 0.0).alias("nneg"))
    ranked = prefix_sums(per_score, "_score", ["nneg"])
    return ranked.agg(
        F.try_divide(F.sum(F.col("npos") * (F.col("nneg_before") + F.col("nneg") * F.lit(0.5))),
                     F.sum("npos").cast("double") * F.sum("nneg").cast("double")).alias("auc"),
        F.sum("npos").alias("n_pos"), F.sum("nneg").alias("n_neg"))
