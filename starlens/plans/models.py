"""Model queries: logistic regression, SVMs, term weights, k-means.

MLlib fits are iterative numeric solvers with no SQL equivalent, so the
fitted values have no oracle string; ``tests/test_models.py`` checks them
(fit on train only, metrics equal their recomputation, probabilities sum to
one, clusters cover every row). What SQL can compute of them (counts of fit
inputs, hashed counts, test-set margins, slices, cluster totals) is
registered as a query of its own, with an oracle.

Each query fits its own model: nothing is kept between queries.
"""

from __future__ import annotations

from pyspark.ml.feature import HashingTF, Tokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from starlens.functions import clean
from starlens.functions.text import tokenize, with_ngrams
from starlens.operators import hinge, models, ordering, refine, split
from starlens.plans import entities as E
from starlens.plans.evaluation import SQL_LABELLED
from starlens.plans.registry import register
from starlens.plans.text import SQL_TRIGRAMS, sql_tokens
from starlens.sources.tables import read_table

LR_SEED, SVM_SEED, TRIGRAM_SEED = 100, 42, 12345
SLICE_LO, SLICE_HI = 100, 200


def _split(spark, d, seed):
    return split.keyed_split(E.labelled_texts(spark, d), "doc_id", seed, 0.7)


def _sql_margins(seed: int) -> str:
    return f"""
SELECT count(*) AS n_test, count(*) FILTER (label = 1) AS n_positive, count(*) FILTER (label = 0) AS n_negative
  FROM (SELECT doc_id, label FROM {SQL_LABELLED})
 WHERE ('0x' || substr(md5('{seed}:' || CAST(doc_id AS VARCHAR)), 1, 8))::BIGINT % 1000 >= 700"""


def _margins(report):
    return report.select((F.col("tp") + F.col("fn") + F.col("tn") + F.col("fp")).alias("n_test"),
                         (F.col("tp") + F.col("fn")).alias("n_positive"), (F.col("tn") + F.col("fp")).alias("n_negative"))


# --- inputs and features ----------------------------------------------------------------
@register("fit_input_counts", """
SELECT count(*) AS n_rows, count(*) FILTER (text IS NULL OR quality IS NULL) AS n_dropped,
       count(*) FILTER (text IS NOT NULL AND quality IS NOT NULL) AS n_kept
  FROM documents LEFT JOIN labels USING (doc_id)
""")
def fit_input_counts(spark, d):
    """What a fit drops when every document is offered, labelled or not."""
    docs = read_table(spark, d, "documents", "doc_id", "text")
    labels = read_table(spark, d, "labels", "doc_id", F.col("quality").alias("label"))
    rows = docs.join(labels, "doc_id", "left")
    kept = models.fit_inputs(models.lr_pipeline(), rows).agg(F.count(F.lit(1)).alias("n_kept"))
    return (rows.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("n_kept", kept.scalar())
            .select("n_rows", (F.col("n_rows") - F.col("n_kept")).alias("n_dropped"), "n_kept"))


@register("hashed_counts", f"SELECT doc_id, CAST(len({sql_tokens('text')}) AS DOUBLE) AS n_counted FROM documents")
def hashed_counts(spark, d):
    """Hashed term counts of a document add up to its tokens."""
    docs = E.texts(spark, d).select("doc_id", "text")
    tokens = Tokenizer(inputCol="text", outputCol="tokens").transform(docs)
    hashed = HashingTF(inputCol="tokens", outputCol="counts", numFeatures=1 << 10).transform(tokens)
    total = F.aggregate(vector_to_array("counts"), F.lit(0.0), lambda a, x: a + x)
    return hashed.select("doc_id", total.alias("n_counted"))


# --- logistic regression -------------------------------------------------------------------
def _lr(spark, d):
    train, test = _split(spark, d, LR_SEED)
    return models.fit(models.lr_pipeline(), train, "doc_id"), test


@register("lr_metrics")
def lr_metrics(spark, d):
    model, test = _lr(spark, d)
    return models.classifier_report(model.transform(test))


@register("lr_test_margins", _sql_margins(LR_SEED))
def lr_test_margins(spark, d):
    """The report's margins are the test set's classes."""
    return _margins(lr_metrics(spark, d))


def _scored_slice(spark, d):
    model, _ = _lr(spark, d)
    rows = ordering.row_slice(E.labelled_texts(spark, d), ["doc_id"], SLICE_LO, SLICE_HI)
    return models.with_probabilities(model.transform(rows))


@register("lr_scored_slice")
def lr_scored_slice(spark, d):
    return _scored_slice(spark, d).select("doc_id", "row_index", "text", "prediction", "positive_prob", "negative_prob")


@register("lr_slice_probabilities", f"""
SELECT doc_id, row_index, 1.0::DOUBLE AS total FROM (
  SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS row_index FROM {SQL_LABELLED})
 WHERE row_index > {SLICE_LO} AND row_index <= {SLICE_HI}
""")
def lr_slice_probabilities(spark, d):
    """The slice's rows, their two probabilities added up."""
    p = _scored_slice(spark, d)
    return p.select("doc_id", "row_index", F.round(F.col("positive_prob") + F.col("negative_prob"), 6).alias("total"))


# --- SVMs and term weights -------------------------------------------------------------------
def _unigram_report(spark, d):
    train, test = _split(spark, d, SVM_SEED)
    model = models.fit(models.svm_unigram_pipeline(), train, "doc_id")
    return models.classifier_report(model.transform(test), with_auc=False)


@register("svm_unigram")
def svm_unigram(spark, d):
    return _unigram_report(spark, d)


@register("svm_unigram_margins", _sql_margins(SVM_SEED))
def svm_unigram_margins(spark, d):
    return _margins(_unigram_report(spark, d))


def _trigram(spark, d):
    """Trigram model on text without punctuation, and its test set."""
    sides = [s.withColumn("text", clean.strip_punct("text")).withColumnRenamed("label", "label_raw")
             for s in _split(spark, d, TRIGRAM_SEED)]
    return models.fit(models.svm_trigram_pipeline(), sides[0], "doc_id"), sides[1]


@register("svm_trigram")
def svm_trigram(spark, d):
    model, test = _trigram(spark, d)
    return models.classifier_report(model.transform(test), with_auc=False)


@register("term_weights_top")
def term_weights_top(spark, d):
    model, _ = _trigram(spark, d)
    return models.top_weighted_terms(models.term_weights(spark, model), 20)


CHECKED_FEATURES = 1 << 9  # where a check holds whole feature arrays


def _agreement(both):
    """Rows in all, with equal margins, and with the prediction on their margin's side."""
    near = F.abs(F.col("raw") - F.col("margin")) <= 1e-6 * (1 + F.abs(F.col("raw")))
    return both.agg(F.count(F.lit(1)).alias("n_test"), F.count_if(near).alias("n_equal"),
                    F.count_if((F.col("margin") > 0) == (F.col("prediction") == 1.0)).alias("n_same_side"))


@register("svm_unigram_recomputed", f"SELECT n_test, n_test AS n_equal, n_test AS n_same_side FROM ({_sql_margins(SVM_SEED)})")
def svm_unigram_recomputed(spark, d):
    """Test rows whose margin is their feature array times the weights, added up in SQL."""
    train, test = _split(spark, d, SVM_SEED)
    model = models.fit(models.svm_unigram_pipeline(num_features=CHECKED_FEATURES), train, "doc_id")
    weights, start = model.stages[-1].coefficients.toArray().tolist(), float(model.stages[-1].intercept)
    products = F.zip_with(vector_to_array("features"), F.array(*map(F.lit, weights)), lambda a, b: a * b)
    return _agreement(model.transform(test.where(F.col("text").isNotNull())).select(
        vector_to_array("rawPrediction")[1].alias("raw"), "prediction", F.aggregate(products, F.lit(start), lambda s, v: s + v).alias("margin")))


@register("svm_trigram_recomputed", f"""
SELECT n_test, n_test AS n_equal, n_test AS n_same_side FROM ({_sql_margins(TRIGRAM_SEED)})
""")
def svm_trigram_recomputed(spark, d):
    """Test rows whose margin is that of their terms joined to the weight table, and whose prediction is its side."""
    model, test = _trigram(spark, d)
    test = test.where(F.col("text").isNotNull())
    scored = model.transform(test).select("doc_id", vector_to_array("rawPrediction")[1].alias("raw"), "prediction")
    return _agreement(scored.join(models.term_margins(spark, model, test, "doc_id"), "doc_id"))


# --- a linear SVM with a table of weights ------------------------------------------------------
HINGE_STEPS, HINGE_SIZE, HINGE_REG = 3, 0.005, 0.3


def _sql_hinge(steps: int) -> str:
    """Full-batch subgradient steps, chained; ``x`` has the tf-idf of the training trigrams."""
    parts = [f"""t AS MATERIALIZED (SELECT doc_id, CASE WHEN label = 1 THEN 1.0 ELSE -1.0 END::DOUBLE AS y FROM {SQL_LABELLED}
  WHERE text IS NOT NULL AND label IS NOT NULL AND ('0x' || substr(md5('{TRIGRAM_SEED}:' || CAST(doc_id AS VARCHAR)), 1, 8))::BIGINT % 1000 < 700),
g AS (SELECT doc_id, y, g AS term FROM {SQL_TRIGRAMS} JOIN t USING (doc_id)),
f AS MATERIALIZED (SELECT doc_id, y, term, count(*) AS tf FROM g GROUP BY ALL),
i AS MATERIALIZED (SELECT term, ln(((SELECT count(*) FROM t) + 1.0) / (count(*) + 1.0)) AS idf FROM f GROUP BY term),
x AS MATERIALIZED (SELECT doc_id, y, term, tf * idf AS v FROM f JOIN i USING (term)),
w0 AS (SELECT term, 0.0::DOUBLE AS w FROM i)"""]
    for k in range(steps + 1):
        parts.append(f"""m{k} AS MATERIALIZED (SELECT t.doc_id, any_value(t.y) AS y, coalesce(sum(v * w), 0) AS m
  FROM t LEFT JOIN (SELECT doc_id, v, w FROM x JOIN w{k} USING (term)) USING (doc_id) GROUP BY t.doc_id)""")
        if k < steps:
            eta = HINGE_SIZE / (k + 1) ** 0.5
            parts.append(f"""w{k + 1} AS MATERIALIZED (SELECT w.term, any_value(w.w) * {1 - eta * HINGE_REG!r} + {eta!r} * coalesce(sum(x.y * x.v), 0) / (SELECT count(*) FROM t) AS w
  FROM w{k} w LEFT JOIN (SELECT x.* FROM x JOIN m{k} m USING (doc_id) WHERE m.y * m.m < 1) x ON x.term = w.term GROUP BY w.term)""")
    return "WITH " + ",\n".join(parts)


def _hinge(spark, d):
    # by document before the texts grow into trigrams: counting them within a document moves nothing
    train = _split(spark, d, TRIGRAM_SEED)[0].repartition("doc_id").withColumn("t", tokenize(clean.strip_punct("text")))
    grams = with_ngrams(train, "t", "g", 3)
    return hinge.WeightTable(grams.select("doc_id", "g", "label"), "doc_id", "g", "label")


@register("hinge_steps", _sql_hinge(HINGE_STEPS) + "\n" + "\nUNION ALL ".join(f"""
SELECT {k} AS step, count(*) AS n, count_if(1 - y * m > 0)::BIGINT AS inside, round(avg(greatest(0, 1 - y * m)), 6) AS hinge,
       round(avg(greatest(0, 1 - y * m)) + {HINGE_REG / 2} * (SELECT sum(w * w) FROM w{k}), 6) AS loss FROM m{k}""" for k in range(HINGE_STEPS + 1)))
def hinge_steps(spark, d):
    """Loss of the weights before and after every step."""
    table, rows = _hinge(spark, d), None
    for k in range(HINGE_STEPS + 1):
        if k:
            table.step(HINGE_SIZE, HINGE_REG)
        now = table.report(HINGE_REG)
        rows = now if rows is None else rows.unionByName(now)
    return rows.select("step", "n", "inside", F.round("hinge", 6).alias("hinge"), F.round("loss", 6).alias("loss"))


@register("hinge_terms_top", _sql_hinge(HINGE_STEPS) + f""",
r AS (SELECT term, round(w, 9) AS weight FROM w{HINGE_STEPS})
SELECT * FROM (SELECT 'positive' AS side, term, weight FROM r WHERE weight > 0 ORDER BY weight DESC, term LIMIT 20)
UNION ALL SELECT * FROM (SELECT 'negative', term, weight FROM r WHERE weight < 0 ORDER BY weight, term LIMIT 20)
""")
def hinge_terms_top(spark, d):
    """Trigrams that speak most for either class."""
    return _hinge(spark, d).fit(HINGE_STEPS, HINGE_SIZE, HINGE_REG).top_terms(20)


# --- k-means -------------------------------------------------------------------------------
def _clusters(spark, d, k=2):
    data = E.labelled_texts(spark, d)
    model = models.fit(models.kmeans_pipeline(k=k, seed=1234), data, "doc_id")
    return models.assign_clusters(model, data, "doc_id"), data


@register("kmeans_sizes")
def kmeans_sizes(spark, d):
    return _clusters(spark, d)[0].groupBy("prediction").agg(F.count(F.lit(1)).alias("count"))


@register("cluster_profile")
def cluster_profile(spark, d):
    return models.cluster_profile(_clusters(spark, d)[0])


@register("kmeans_nearest", """
SELECT count(*) AS n, count(*) AS n_nearest, TRUE AS costs_less FROM documents JOIN labels USING (doc_id)
 WHERE text IS NOT NULL AND quality IS NOT NULL
""")
def kmeans_nearest(spark, d):
    """Rows whose cluster is that of the nearest centre, and whether two centres cost less than the mean alone."""
    data = E.labelled_texts(spark, d).where(F.col("text").isNotNull())
    model = models.fit(models.kmeans_pipeline(num_features=CHECKED_FEATURES), data, "doc_id")
    rows = models.center_distances(model, data, "doc_id")
    own, best = F.get("distances", F.col("prediction")), F.array_min("distances")
    each = model.transform(data).select(F.posexplode(vector_to_array("features")).alias("d", "v"))
    about_mean = each.groupBy("d").agg((F.sum(F.col("v") * F.col("v")) - F.sum("v") * F.avg("v")).alias("c")).agg(F.sum("c")).scalar()
    return rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(own <= best * (1 + 1e-9) + 1e-9).alias("n_nearest"),
                    (F.sum(own) < about_mean).alias("costs_less"))


@register("cluster_totals", f"""
SELECT count(*) AS n, round(avg(label), 6) AS avglabel, round(avg(len({sql_tokens('text')})), 6) AS avgtoken
  FROM (SELECT text, CAST(quality AS DOUBLE) AS label FROM documents JOIN labels USING (doc_id)
         WHERE text IS NOT NULL AND quality IS NOT NULL)
""")
def cluster_totals(spark, d):
    """The profile's sizes and weighted averages are the whole table's."""
    p, n = models.cluster_profile(_clusters(spark, d)[0]), F.col("count")
    return p.agg(F.sum(n).alias("n"), F.round(F.sum(F.col("avglabel") * n) / F.sum(n), 6).alias("avglabel"),
                 F.round(F.sum(F.col("avgtoken") * n) / F.sum(n), 6).alias("avgtoken"))


def _tree(spark, d, splits):
    return refine.refinement_tree(refine.feature_table(E.labelled_texts(spark, d), "doc_id"), "doc_id", splits)


def _leaves(tree, prefix):
    """Profile of one level's clusters by their last number."""
    p = refine.path_profile(tree.where(F.col("path").startswith(prefix)))
    return p.select(F.element_at(F.split("path", "/"), -1).cast("int").alias("prediction"), "count", "avgtoken")


@register("recluster")
def recluster(spark, d):
    return _leaves(_tree(spark, d, (2, 2)), "0/")


@register("recluster_second")
def recluster_second(spark, d):
    """The larger half of the larger cluster, in five."""
    return _leaves(_tree(spark, d, (2, 2, 5)), "0/0/")


@register("refinement_tree")
def refinement_tree(spark, d):
    """Every leaf of both refinements."""
    return refine.path_profile(_tree(spark, d, (2, 2, 5)))


@register("refinement_totals", f"""
SELECT count(*) AS n, round(avg(label), 6) AS avglabel, round(avg(len({sql_tokens('text')})), 6) AS avgtoken, 7 AS n_leaves, TRUE AS nested
  FROM (SELECT text, CAST(quality AS DOUBLE) AS label FROM documents JOIN labels USING (doc_id)
         WHERE text IS NOT NULL AND quality IS NOT NULL)
""")
def refinement_totals(spark, d):
    """The leaves hold every row once, in as many clusters as were asked for, numbered from the largest."""
    leaves, n = refine.path_profile(_tree(spark, d, (2, 2, 5))), F.col("count")
    size = F.map_from_entries(F.collect_list(F.struct("path", n)))  # seven leaves
    inner = sum((size[f"0/0/{i}"] for i in range(1, 5)), size["0/0/0"])
    nested = (size["1"] <= inner + size["0/1"]) & (size["0/1"] <= inner) & (size["0/0/4"] <= size["0/0/0"])
    return leaves.agg(F.sum(n).alias("n"), F.round(F.sum(F.col("avglabel") * n) / F.sum(n), 6).alias("avglabel"),
                      F.round(F.sum(F.col("avgtoken") * n) / F.sum(n), 6).alias("avgtoken"),
                      F.count(F.lit(1)).cast("int").alias("n_leaves"), nested.alias("nested"))
