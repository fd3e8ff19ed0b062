"""Sentiment classifiers, term weights and k-means on text (MLlib).

Fits are MLlib's distributed solvers (tree-aggregated gradients; the
driver only holds the coefficient vector).  Feature steps use the JVM
transformers (Tokenizer, StopWordsRemover, NGram, HashingTF,
CountVectorizer, IDF): no Python UDF anywhere.

Determinism: the training frame is hash-partitioned by its key and
sorted within partitions before a fit, so floating-point sums run in the
same order on every run; k-means cluster ids are renumbered by size.
The frame is persisted around the iterative fit and released after.  Rows
with a null text or label are dropped before a fit.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LinearSVC, LogisticRegression
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import (IDF, CountVectorizer, CountVectorizerModel, HashingTF, NGram, StopWordsRemover,
                                StringIndexer, Tokenizer, VectorAssembler)
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from starlens.operators import evaluate, terms
from starlens.session import ensure_checkpoint_dir, size_partitions, written

DEFAULT_FEATURES = 1 << 18
FIT_BYTES = 32 << 20  # of expanded input a partition, for the feature stages
SOLVER_BYTES = 2 << 30  # the same for the solver: an iteration sends a whole gradient (2 MB for 2^18 features) a partition


def feature_stages(text_col: str = "text", stop_words: bool = False, ngram: int | None = None,
                   num_features: int | None = DEFAULT_FEATURES, vocab_size: int | None = None,
                   out: str = "features") -> list:
    """Tokens, optionally without stop words or as n-grams, counted and weighted by IDF.

    ``vocab_size`` counts over a learned vocabulary, else terms are hashed
    into ``num_features`` slots.
    """
    stages, col = [Tokenizer(inputCol=text_col, outputCol="tokens")], "tokens"
    if stop_words:
        stages.append(StopWordsRemover(inputCol=col, outputCol="kept_tokens"))
        col = "kept_tokens"
    if ngram:
        stages.append(NGram(n=ngram, inputCol=col, outputCol="terms"))
        col = "terms"
    if vocab_size:
        stages.append(CountVectorizer(inputCol=col, outputCol="counts", vocabSize=vocab_size))
    else:
        stages.append(HashingTF(inputCol=col, outputCol="counts", numFeatures=num_features))
    return [*stages, IDF(inputCol="counts", outputCol=out)]


# The models' hyperparameters are the defaults below.
def lr_pipeline(text_col: str = "text", label_col: str = "label", num_features: int = DEFAULT_FEATURES,
                max_iter: int = 10, reg_param: float = 0.001) -> Pipeline:
    return Pipeline(stages=[*feature_stages(text_col, num_features=num_features),
                            LogisticRegression(labelCol=label_col, maxIter=max_iter, regParam=reg_param)])


def svm_unigram_pipeline(text_col: str = "text", label_col: str = "label",
                         num_features: int = DEFAULT_FEATURES) -> Pipeline:
    return Pipeline(stages=[*feature_stages(text_col, stop_words=True, num_features=num_features),
                            LinearSVC(labelCol=label_col)])


def svm_trigram_pipeline(text_col: str = "text", label_col: str = "label_raw",
                         vocab_size: int = DEFAULT_FEATURES, max_iter: int = 50,
                         reg_param: float = 0.3) -> Pipeline:
    """Trigrams over a vocabulary, an indexed label and an assembled vector."""
    return Pipeline(stages=[*feature_stages(text_col, ngram=3, vocab_size=vocab_size, out="weighted"),
                            StringIndexer(inputCol=label_col, outputCol="label"),
                            VectorAssembler(inputCols=["weighted"], outputCol="features"),
                            LinearSVC(maxIter=max_iter, regParam=reg_param, labelCol="label")])


def kmeans_pipeline(text_col: str = "text", k: int = 2, seed: int = 1234,
                    num_features: int = DEFAULT_FEATURES) -> Pipeline:
    return Pipeline(stages=[*feature_stages(text_col, stop_words=True, num_features=num_features),
                            KMeans(k=k, seed=seed)])


def stable_input(df: DataFrame, key: str, partitions: int | None = None) -> DataFrame:
    """Fixed partitioning and row order for a reproducible fit; the count follows the data alone."""
    n = partitions or size_partitions(df, FIT_BYTES)
    return df.repartition(n, key).sortWithinPartitions(key)


def solver_layout(df: DataFrame) -> tuple[int, int]:
    """Partitions for an iterative solver and the depth of its sums; both follow the data alone.

    One partition where the features have one, else twice a power of three:
    every level of the sum merges three, so that two gradients an iteration
    reach the driver whatever the input's size.
    """
    if size_partitions(df, FIT_BYTES) == 1:
        return 1, 2
    wanted, power = size_partitions(df, SOLVER_BYTES), 0
    while 2 * 3 ** power < wanted:
        power += 1
    return 2 * 3 ** power, max(2, power + 1)


def fit_vocabulary(stage: CountVectorizer, df: DataFrame) -> CountVectorizerModel:
    """The fitted ``stage`` (without limits on documents); its terms are ranked on the executors.

    MLlib's fit collects ``vocabSize`` candidates of every partition on the
    driver. Here it gets the chosen terms alone, in one partition; their
    order among themselves is its own. Ties at the end of the vocabulary are
    broken by term, so it holds the same terms on any cluster.
    """
    counts = df.select(terms.explode_array(stage.getInputCol()).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    top = written(counts.orderBy(F.col("n").desc(), "term").limit(stage.getVocabSize()).select("term"), "vocabulary")
    return stage.fit(top.select(F.array("term").alias(stage.getInputCol())).coalesce(1))


def fit_inputs(pipeline: Pipeline, df: DataFrame) -> DataFrame:
    """Rows of ``df`` whose text and (raw) label are not null."""
    needed = {s.getInputCol() for s in pipeline.getStages() if s.hasParam("inputCol") and s.getInputCol() in df.columns}
    estimator = pipeline.getStages()[-1]
    if estimator.hasParam("labelCol") and estimator.getLabelCol() in df.columns:
        needed.add(estimator.getLabelCol())
    return df.dropna(how="any", subset=sorted(needed))


def _fit_features(stages: list, data: DataFrame) -> list:
    """The fitted feature stages, as ``Pipeline.fit`` makes them."""
    fitted = []
    for stage in stages:
        if isinstance(stage, CountVectorizer):
            stage = fit_vocabulary(stage, data)
        elif hasattr(stage, "fit"):
            stage = stage.fit(data)
        fitted.append(stage)
        data = stage.transform(data)
    return fitted


def fit(pipeline: Pipeline, train: DataFrame, key: str) -> PipelineModel:
    """Fit feature stages, cut lineage, then fit the final estimator.

    Rows with a null text or label are dropped first. The iterative solver
    runs one job per iteration, and every task carries the lineage and the
    column metadata of its input. A reliable ``checkpoint`` of just the
    features and label (to the shared ``spark.checkpoint.dir``) cuts the
    one; the metadata, an attribute for each vocabulary term, is taken off
    before it. The solver gets fewer, larger partitions than the feature
    stages, see :func:`solver_layout`.
    """
    ensure_checkpoint_dir(train.sparkSession)
    stages = pipeline.getStages()
    estimator = stages[-1]
    inputs = fit_inputs(pipeline, train)
    data = stable_input(inputs, key).persist()
    n, depth = solver_layout(inputs)
    try:
        features = _fit_features(stages[:-1], data)
        vector = estimator.getFeaturesCol()
        cols = [F.col(vector).alias(vector, metadata={})]
        if estimator.hasParam("labelCol"):
            cols.append(F.col(estimator.getLabelCol()))
        x = PipelineModel(stages=features).transform(data)
        if n < data.rdd.getNumPartitions():
            x = x.select(F.col(key).alias("_key"), *cols).repartition(n, "_key").sortWithinPartitions("_key").drop("_key")
        else:
            x = x.select(*cols)
        x = x.checkpoint(eager=True)
    finally:
        data.unpersist()
    settings = {estimator.aggregationDepth: depth} if estimator.hasParam("aggregationDepth") else {}
    return PipelineModel(stages=features + [estimator.fit(x, settings)])


def with_probabilities(pred: DataFrame) -> DataFrame:
    """positive_prob / negative_prob from the probability vector (no UDF)."""
    p = vector_to_array("probability")
    return pred.withColumn("positive_prob", p[1]).withColumn("negative_prob", p[0])


def classifier_report(pred: DataFrame, label_col: str = "label", with_auc: bool = True) -> DataFrame:
    """Confusion counts, accuracy, precision, recall, F1 (+ exact AUC).

    The test set is scored once, into a checkpointed frame of label,
    prediction and score, which both the counts and the AUC read. The AUC
    ranks the positive-class probability with the exact rank-sum rule
    (``evaluate.auc``; MLlib's evaluator bins scores into 1000 bins).
    """
    if not with_auc:
        return evaluate.binary_metrics(pred, label_col, "prediction")
    ensure_checkpoint_dir(pred.sparkSession)
    narrow = pred.select(F.col(label_col).alias("label"), "prediction",
                         vector_to_array("probability")[1].alias("score")).checkpoint()
    m = evaluate.binary_metrics(narrow, "label", "prediction")
    return m.withColumn("auc", evaluate.auc(narrow).select("auc").scalar())


# --- M5: term weights -------------------------------------------------------------------------
@dataclass
class TermWeights:
    frame: DataFrame         # (term, weight)
    positive_class: str      # class that a positive weight speaks for
    negative_class: str


def term_weights(spark: SparkSession, model: PipelineModel) -> TermWeights:
    """Vocabulary x SVM coefficients of a fitted trigram pipeline.

    The vocabulary and the coefficients already live on the driver inside
    the fitted model (both bounded by ``vocabSize``); they are zipped into
    a DataFrame so ranking runs in Spark.  StringIndexer gives index 0 to
    the more frequent label, and the SVM scores index 1 as positive.
    """
    cv = next(s for s in model.stages if hasattr(s, "vocabulary"))
    svm = model.stages[-1]
    indexer = next(s for s in model.stages if hasattr(s, "labels") and not hasattr(s, "vocabulary"))
    coeffs = svm.coefficients.toArray().tolist()
    labels = list(indexer.labels)
    rows = list(zip(cv.vocabulary, coeffs))
    frame = spark.createDataFrame(rows, "term string, weight double")
    return TermWeights(frame, positive_class=labels[1] if len(labels) > 1 else labels[0], negative_class=labels[0])


def top_weighted_terms(weights: TermWeights, k: int = 20) -> DataFrame:
    """Top-k terms for each class: most negative and most positive weights."""
    f = weights.frame
    neg = f.orderBy(F.col("weight").asc(), F.col("term")).limit(k).withColumn("for_class", F.lit(weights.negative_class))
    pos = f.orderBy(F.col("weight").desc(), F.col("term")).limit(k).withColumn("for_class", F.lit(weights.positive_class))
    w = Window.partitionBy("for_class").orderBy(F.abs(F.col("weight")).desc(), F.col("term"))
    return neg.unionByName(pos).withColumn("rank", F.row_number().over(w))


def term_margins(spark: SparkSession, model: PipelineModel, docs: DataFrame, key: str) -> DataFrame:
    """``(key, margin)`` of a trigram pipeline's documents, by joining their terms to its written weights.

    The relational twin of the assembled vector and the SVM's dot product:
    counts of vocabulary terms times IDF times weight, plus the intercept.
    ``docs`` has the pipeline's text column.
    """
    cv = next(s for s in model.stages if hasattr(s, "vocabulary"))
    idf = next(s for s in model.stages if hasattr(s, "idf")).idf.toArray().tolist()
    svm = model.stages[-1]
    # bounded by vocabSize, like the model itself
    weights = spark.createDataFrame(list(zip(cv.vocabulary, (a * b for a, b in zip(idf, svm.coefficients.toArray().tolist())))),
                                    "term string, weight double")
    prefix = PipelineModel(stages=list(model.stages[:list(model.stages).index(cv)]))
    rows = prefix.transform(docs).select(key, F.col(cv.getInputCol()).alias("terms"))
    tf = terms.term_frequencies(rows, key, "terms")
    sums = tf.join(weights, "term").groupBy(key).agg(F.sum(F.col("tf") * F.col("weight")).alias("margin"))
    return (rows.select(key).join(sums, key, "left")
            .withColumn("margin", F.coalesce("margin", F.lit(0.0)) + F.lit(float(svm.intercept))))


# --- M7 / M8 / M9: k-means ---------------------------------------------------------------------
def assign_clusters(model: PipelineModel, df: DataFrame, key: str, label_col: str = "label") -> DataFrame:
    """``(key, label, n_tokens, prediction)``, clusters numbered 0..k-1 from the largest.

    Texts are tokenized and scored once; the narrow result is checkpointed
    and both the sizes and the rows come from it.
    """
    ensure_checkpoint_dir(df.sparkSession)
    text_col = model.stages[0].getInputCol()
    scored = model.transform(df.filter(F.col(text_col).isNotNull()))
    narrow = scored.select(key, label_col, F.size("tokens").alias("n_tokens"), "prediction").checkpoint()
    return relabel_by_size(narrow)


def relabel_by_size(clustered: DataFrame, col: str = "prediction") -> DataFrame:
    """Renumber clusters 0..k-1 from largest to smallest (ties by old id).

    The size table has one row per cluster (k rows).
    """
    sizes = clustered.groupBy(col).agg(F.count(F.lit(1)).alias("_size"))
    w = Window.orderBy(F.col("_size").desc(), F.col(col))
    mapping = sizes.withColumn("_new", (F.row_number().over(w) - 1).cast("int")).select(col, "_new")
    return (clustered.join(F.broadcast(mapping), col)
            .drop(col).withColumnRenamed("_new", col))


def center_distances(model: PipelineModel, df: DataFrame, key: str) -> DataFrame:
    """``(key, prediction, distances)``: squared distance of every row to every centre, from the feature arrays.

    For models whose ``k`` centres fit the plan as literals.
    """
    x = vector_to_array(model.stages[-1].getFeaturesCol())
    rows = model.transform(df).select(key, "prediction", x.alias("x"))
    square = lambda c: F.aggregate(F.zip_with("x", F.array(*[F.lit(float(v)) for v in c]), lambda a, b: (a - b) * (a - b)),
                                   F.lit(0.0), lambda s, v: s + v)
    return rows.select(key, "prediction", F.array(*[square(c) for c in model.stages[-1].clusterCenters()]).alias("distances"))


def cluster_profile(clustered: DataFrame, label_col: str = "label", tokens_col: str = "n_tokens") -> DataFrame:
    """Per cluster: size, average label and average token count."""
    return clustered.groupBy("prediction").agg(
        F.count(F.lit(1)).alias("count"),
        F.avg(label_col).alias("avglabel"),
        F.avg(tokens_col).alias("avgtoken"))


def recluster(clustered: DataFrame, df: DataFrame, keep: int, k: int, key: str,
              seed: int = 1234, num_features: int = DEFAULT_FEATURES) -> DataFrame:
    """Keep one cluster of ``df``'s rows and split it again into ``k`` clusters."""
    base = df.join(clustered.filter(F.col("prediction") == keep).select(key), key, "left_semi")
    model = fit(kmeans_pipeline(k=k, seed=seed, num_features=num_features), base, key)
    return assign_clusters(model, base, key)
