"""Split, row index, label index and classifier-metric queries.

The metric queries score a transparent rule (long documents predicted
high quality) so the metric operators can be checked against SQL; the
model queries (``plans.models``) run the same operators on real fits.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import functions as F

from starlens.operators import evaluate, ordering, split, terms
from starlens.plans import entities as E
from starlens.plans.registry import register
from starlens.sources.tables import read_table

R6 = 6
SPLIT_SEED = 42
SLICE_LO, SLICE_HI = 100, 200

SQL_LABELLED = "(SELECT d.doc_id, d.text, CAST(l.quality AS DOUBLE) AS label FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"
SQL_RULE = """(SELECT d.doc_id, CAST(l.quality AS DOUBLE) AS label, d.n_chars / (d.n_chars + 2000.0) AS score,
        CASE WHEN d.n_chars / (d.n_chars + 2000.0) >= 0.5 THEN 1.0 ELSE 0.0 END AS prediction
   FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""


def rule_predictions(spark, d):
    docs = read_table(spark, d, "documents", "doc_id", "n_chars")
    lab = read_table(spark, d, "labels", "doc_id", "quality")
    score = F.col("n_chars") / (F.col("n_chars") + F.lit(2000.0))
    return (docs.join(lab, "doc_id").select(
        "doc_id", F.col("quality").cast("double").alias("label"), score.alias("score"),
        F.when(score >= 0.5, F.lit(1.0)).otherwise(F.lit(0.0)).alias("prediction")))


@register("keyed_split", f"""
SELECT doc_id, CASE WHEN ('0x' || substr(md5('{SPLIT_SEED}:' || CAST(doc_id AS VARCHAR)), 1, 8))::BIGINT % 1000 < 700
                    THEN 'train' ELSE 'test' END AS side FROM {SQL_LABELLED}
""")
def keyed_split(spark, d):
    return E.labelled_texts(spark, d).select("doc_id", split.split_side("doc_id", SPLIT_SEED, 0.7).alias("side"))


@register("exact_split", f"""
SELECT doc_id, label, CASE WHEN row_number() OVER (PARTITION BY label ORDER BY ('0x' || substr(md5('{SPLIT_SEED}:' || CAST(doc_id AS VARCHAR)), 1, 15))::BIGINT)
                                <= (count(*) OVER (PARTITION BY label) * 700 + 500) // 1000 THEN 'train' ELSE 'test' END AS side FROM {SQL_LABELLED}
""")
def exact_split(spark, d):
    return split.exact_split_side(E.labelled_texts(spark, d).select("doc_id", "label"), "doc_id", "label", SPLIT_SEED, 0.7)


@register("row_slice", f"""
SELECT doc_id, label, row_index FROM (
  SELECT doc_id, label, row_number() OVER (ORDER BY doc_id) AS row_index FROM {SQL_LABELLED})
 WHERE row_index > {SLICE_LO} AND row_index <= {SLICE_HI}
""")
def row_slice(spark, d):
    lt = E.labelled_texts(spark, d).select("doc_id", "label")
    return ordering.row_slice(lt, ["doc_id"], SLICE_LO, SLICE_HI)


@register("label_index", f"""
SELECT label, count, CAST(row_number() OVER (ORDER BY count DESC, label) - 1 AS DOUBLE) AS label_index
  FROM (SELECT CAST(quality AS VARCHAR) AS label, count(*) AS count FROM labels GROUP BY 1)
""")
def label_index(spark, d):
    return terms.label_index(read_table(spark, d, "labels", "quality"), "quality")


@register("confusion_matrix", f"""
SELECT label, CAST(count_if(prediction = 0.0) AS BIGINT) AS pred_0, CAST(count_if(prediction = 1.0) AS BIGINT) AS pred_1
  FROM {SQL_RULE} GROUP BY label
""")
def confusion_matrix(spark, d):
    return evaluate.confusion_matrix(rule_predictions(spark, d))


# --- A9 / A12 with open classes: the language by its letters -----------------------------
SQL_LETTERS = """(SELECT lang AS label, CASE WHEN n_chars % 50 = 7 THEN NULL WHEN text LIKE '%ß%' OR text LIKE '%ü%' THEN 'de'
        WHEN text LIKE '%ç%' OR text LIKE '%ê%' THEN 'fr' WHEN text LIKE '%ñ%' OR text LIKE '%ción%' THEN 'es'
        WHEN text LIKE '%0%' THEN 'digits' WHEN text IS NOT NULL THEN 'en' END AS prediction FROM documents)"""


def letter_predictions(spark, d):
    """A rule of several classes, one of them no label, with rows it leaves undecided."""
    has = lambda *marks: reduce(or_, [F.col("text").contains(m) for m in marks])
    rule = (F.when(F.col("n_chars") % 50 == 7, None).when(has("ß", "ü"), "de").when(has("ç", "ê"), "fr").when(has("ñ", "ción"), "es")
            .when(has("0"), "digits").when(F.col("text").isNotNull(), "en"))
    return read_table(spark, d, "documents", "text", "lang", "n_chars").select(F.col("lang").alias("label"), rule.alias("prediction"))


@register("cross_tab", f"SELECT label, prediction, count(*) AS count FROM {SQL_LETTERS} GROUP BY label, prediction")
def cross_tab(spark, d):
    return evaluate.cross_tab(letter_predictions(spark, d))


@register("cross_tab_wide", f"""
SELECT label, {", ".join(f"CAST(count_if(prediction = '{c}') AS BIGINT) AS {c}" for c in ("de", "en", "es", "fr"))},
       CAST(count_if(prediction IS NULL) AS BIGINT) AS "{evaluate.NULL_CLASS}" FROM {SQL_LETTERS} WHERE prediction IS DISTINCT FROM 'digits' GROUP BY label
""")
def cross_tab_wide(spark, d):
    """The columns are the classes that the data hold; the twin names those of the given tables."""
    rows = letter_predictions(spark, d)
    return evaluate.cross_tab_wide(rows.where(F.col("prediction").isNull() | (F.col("prediction") != "digits")))


SQL_CLASSES = f"""(SELECT class, CAST(sum(a) AS BIGINT) AS actual, CAST(sum(p) AS BIGINT) AS predicted, CAST(sum(h) AS BIGINT) AS hits FROM (
   SELECT label AS class, 1 AS a, 0 AS p, CASE WHEN label = prediction THEN 1 ELSE 0 END AS h FROM {SQL_LETTERS} WHERE label IS NOT NULL
   UNION ALL SELECT prediction, 0, 1, 0 FROM {SQL_LETTERS} WHERE label IS NOT NULL AND prediction IS NOT NULL) GROUP BY class)"""


@register("class_metrics", f"""
SELECT class, actual, predicted, hits, round(hits / nullif(predicted, 0), {R6}) AS precision,
       round(hits / nullif(actual, 0), {R6}) AS recall, round(2 * hits / nullif(actual + predicted, 0), {R6}) AS f1 FROM {SQL_CLASSES}
""")
def class_metrics(spark, d):
    m = evaluate.class_metrics(letter_predictions(spark, d))
    return m.select("class", "actual", "predicted", "hits", *[F.round(c, R6).alias(c) for c in ("precision", "recall", "f1")])


@register("averaged_metrics", f"""
WITH m AS (SELECT actual, hits, coalesce(hits / nullif(predicted, 0), 0) AS precision, hits / actual AS recall,
                  2 * hits / (actual + predicted) AS f1 FROM {SQL_CLASSES} WHERE actual > 0)
SELECT CAST(sum(actual) AS BIGINT) AS n, count(*) AS n_classes, round(sum(hits) / sum(actual), {R6}) AS accuracy,
       {", ".join(f"round(sum({m} * actual) / sum(actual), {R6}) AS weighted_{m}, round(avg({m}), {R6}) AS macro_{m}" for m in ("precision", "recall", "f1"))} FROM m
""")
def averaged_metrics(spark, d):
    m = evaluate.averaged_metrics(letter_predictions(spark, d))
    return m.select("n", "n_classes", *[F.round(c, R6).alias(c) for c in m.columns if c not in ("n", "n_classes")])


@register("binary_metrics", f"""
WITH c AS (SELECT count_if(label = 1.0 AND prediction = 1.0) AS tp, count_if(label = 0.0 AND prediction = 1.0) AS fp,
                  count_if(label = 0.0 AND prediction = 0.0) AS tn, count_if(label = 1.0 AND prediction = 0.0) AS fn,
                  count(*) AS n FROM {SQL_RULE}),
     m AS (SELECT *, (tp + tn)::DOUBLE / n AS accuracy, tp::DOUBLE / nullif(tp + fp, 0) AS precision,
                  tp::DOUBLE / nullif(tp + fn, 0) AS recall FROM c)
SELECT CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(tn AS BIGINT) AS tn, CAST(fn AS BIGINT) AS fn, n, round(accuracy, {R6}) AS accuracy, round(precision, {R6}) AS precision,
       round(recall, {R6}) AS recall, round(2 * precision * recall / nullif(precision + recall, 0), {R6}) AS f1 FROM m
""")
def binary_metrics(spark, d):
    m = evaluate.binary_metrics(rule_predictions(spark, d))
    return m.select("tp", "fp", "tn", "fn", "n", *[F.round(c, R6).alias(c) for c in ("accuracy", "precision", "recall", "f1")])


@register("auc_rank", f"""
WITH s AS (SELECT score, count_if(label = 1.0) AS npos, count_if(label = 0.0) AS nneg FROM {SQL_RULE} GROUP BY score),
     r AS (SELECT *, coalesce(sum(nneg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS nneg_before FROM s)
SELECT round(sum(npos * (nneg_before + nneg * 0.5)) / (sum(npos)::DOUBLE * sum(nneg)::DOUBLE), {R6}) AS auc,
       CAST(sum(npos) AS BIGINT) AS n_pos, CAST(sum(nneg) AS BIGINT) AS n_neg FROM r
""")
def auc_rank(spark, d):
    a = evaluate.auc(rule_predictions(spark, d))
    return a.select(F.round("auc", R6).alias("auc"), "n_pos", "n_neg")


@register("accuracy", f"""
SELECT round(avg(CASE WHEN label = prediction THEN 1.0 ELSE 0.0 END), {R6}) AS accuracy, count(*) AS n FROM {SQL_RULE}
""")
def q_accuracy(spark, d):
    a = evaluate.accuracy(rule_predictions(spark, d))
    return a.select(F.round("accuracy", R6).alias("accuracy"), "n")
