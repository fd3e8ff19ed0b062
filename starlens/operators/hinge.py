"""A linear SVM whose weights are a table.

MLlib's solvers keep the coefficient vector on the driver.  Here weights are
rows ``(term, weight)``, so a vocabulary of any size can be learned: a step
joins the terms of its documents to the weights, adds up margins by
document, and adds up the hinge gradient of the documents inside the margin
by term.  Both sums are partially aggregated; a term in a large share of the
documents is salted in the join.  Each step's weights are written, which
cuts the lineage and lets a lost executor's work be redone.

Most terms of a corpus are held by one document only.  Such a term's weight
moves with its document alone, so it is always the document's ``factor``
times the term's tf-idf.  A document keeps that factor and its own terms' sum
of squares; only terms of several documents are joined and shuffled in a
step.  Margins are kept until the weights move.

The objective is mean(max(0, 1 - y * w.x)) + reg / 2 * |w|^2 with y = 1 for
the positive label and -1 for others; step t moves by ``step / sqrt(t)``
along the subgradient of its batch.  A document's batch follows from its id,
so a fit is the same on any cluster.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from starlens.operators import terms
from starlens.operators.joins import ROWS_PER_SALT, hot_keys, salted_join
from starlens.session import shared_path


class WeightTable:
    """Documents and the weights learned from them, all as tables under one shared folder.

    ``rows`` has a document's id, label and array of terms. Documents with a
    null id, label or array are left out; one without terms has margin 0 and
    moves no weight. A repeated id counts as one document with all its rows'
    terms.
    """

    def __init__(self, rows: DataFrame, id_col: str, terms_col: str, label_col: str, positive=1.0, batches: int = 1,
                 min_df: int = 1, rows_per_salt: int = ROWS_PER_SALT):
        self.spark = rows.sparkSession
        self.root = shared_path(self.spark, "hinge", uuid.uuid4().hex)
        self.batches, self.rows_per_salt = batches, rows_per_salt
        rows = rows.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(terms_col).alias("terms")).dropna()
        labels = self._save(rows.groupBy("id").agg(F.max(F.when(F.col("label") == F.lit(positive), 1.0).otherwise(-1.0)).alias("y")), "labels")
        self.n = labels.count()
        tf = terms.term_frequencies(rows, "id", "terms")
        tf = tf.withColumn("df", F.count(F.lit(1)).over(Window.partitionBy("term"))).where(F.col("df") >= min_df)
        idf = F.ln((F.lit(self.n) + F.lit(1.0)) / (F.col("df") + F.lit(1.0)))
        tf.select("id", "term", "df", (F.col("tf") * idf).alias("value"), (F.col("df") == 1).alias("own")).write.partitionBy("own").parquet(f"{self.root}/pairs")
        pairs = self.spark.read.schema("id " + rows.schema["id"].dataType.simpleString() + ", term string, df bigint, value double, own boolean").parquet(f"{self.root}/pairs")
        self.own, shared = pairs.where("own").select("id", "term", "value"), pairs.where(~F.col("own"))
        counts = self._save(shared.groupBy("term").agg(F.first("df").alias("df")), "shared")
        self.idf = counts.unionByName(self.own.select("term", F.lit(1).cast("long").alias("df"))).select("term", idf.alias("idf"))
        self.hot = self._save(hot_keys(counts, "term", "df"), "hot")
        vectors = shared.groupBy("id").agg(F.collect_list(F.struct("term", "value")).alias("x"))
        squares = self.own.groupBy("id").agg(F.sum(F.col("value") * F.col("value")).alias("square"))
        batch = F.pmod(F.xxhash64("id"), F.lit(batches)).cast("int")
        docs = labels.join(vectors, "id", "left").join(squares, "id", "left").withColumn("square", F.coalesce("square", F.lit(0.0)))
        docs = docs.withColumn("batch", batch)
        docs.write.partitionBy("batch").parquet(f"{self.root}/docs")
        self.docs = self.spark.read.schema(docs.schema).parquet(f"{self.root}/docs")
        self.shared = self.spark.createDataFrame([], "term string, weight double")
        self.factors = None  # (id, square, factor) after a step that moved any
        self.steps, self._kept = 0, None

    def _save(self, df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{self.root}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    @property
    def weights(self) -> DataFrame:
        """``(term, weight)`` of all terms that a step moved."""
        if self.factors is None:
            return self.shared
        own = self.own.join(self.factors.where(F.col("factor") != 0), "id").select("term", (F.col("value") * F.col("factor")).alias("weight"))
        return self.shared.unionByName(own)

    def margins(self, docs: DataFrame) -> DataFrame:
        """``(id, y, margin)`` of documents under the present weights."""
        if self.factors is None:
            return docs.select("id", "y", F.lit(0.0).alias("margin"))
        pairs = docs.select("id", terms.explode_array("x").alias("p")).select("id", "p.term", "p.value")
        hits = salted_join(pairs, self.shared, "term", self.hot, self.rows_per_salt, spread_cols=["id"])
        sums = hits.groupBy("id").agg(F.sum(F.col("value") * F.col("weight")).alias("margin"))
        own = self.factors.select("id", (F.col("factor") * F.col("square")).alias("own"))
        return docs.select("id", "y").join(sums, "id", "left").join(own, "id", "left").select(
            "id", "y", (F.coalesce("margin", F.lit(0.0)) + F.coalesce("own", F.lit(0.0))).alias("margin"))

    def _margins(self) -> DataFrame:
        """The margins of all documents, written once for the present weights."""
        if self._kept is None:
            self._kept = self._save(self.margins(self.docs), f"margins-{uuid.uuid4().hex}")
        return self._kept

    def step(self, size: float, reg: float) -> None:
        """One subgradient step on the next batch."""
        self.steps += 1
        eta = size / self.steps ** 0.5
        batch = self.docs.where(F.col("batch") == (self.steps - 1) % self.batches)
        n = self.n if self.batches == 1 else batch.count()
        if not n:
            return
        margins = self._margins() if self.batches == 1 or self._kept is not None else self.margins(batch)
        inside = margins.where(F.col("y") * F.col("margin") < 1).select("id")
        pulled = self._save(batch.join(inside, "id", "left_semi").select("id", "y"), f"pulled-{self.steps}")
        pairs = batch.select("id", "y", "x").join(pulled.select("id"), "id", "left_semi").select("y", terms.explode_array("x").alias("p"))
        gradient = pairs.groupBy("p.term").agg((F.sum(F.col("y") * F.col("p.value")) / n).alias("pull"))
        moved = self.shared.join(gradient, "term", "full").select(
            "term", (F.coalesce("weight", F.lit(0.0)) * (1 - eta * reg) + F.coalesce("pull", F.lit(0.0)) * eta).alias("weight"))
        before = self.docs.select("id", "square", F.lit(0.0).alias("factor")) if self.factors is None else self.factors
        turned = before.join(pulled, "id", "left").select(
            "id", "square", (F.col("factor") * (1 - eta * reg) + F.coalesce("y", F.lit(0.0)) * (eta / n)).alias("factor"))
        self.shared, self.factors, self._kept = self._save(moved, f"weights-{self.steps}"), self._save(turned, f"factors-{self.steps}"), None

    def report(self, reg: float) -> DataFrame:
        """``(step, n, inside, hinge, loss)`` of the present weights over all documents."""
        norm = self.shared.agg(F.coalesce(F.sum(F.col("weight") * F.col("weight")), F.lit(0.0))).scalar()
        if self.factors is not None:
            norm = norm + self.factors.agg(F.coalesce(F.sum(F.col("factor") * F.col("factor") * F.col("square")), F.lit(0.0))).scalar()
        lack = F.greatest(F.lit(0.0), 1 - F.col("y") * F.col("margin"))
        out = self._margins().agg(F.count(F.lit(1)).alias("n"), F.count_if(lack > 0).alias("inside"), F.avg(lack).alias("hinge"))
        return out.select(F.lit(self.steps).alias("step"), "n", "inside", "hinge", (F.col("hinge") + norm * (reg / 2)).alias("loss"))

    def fit(self, steps: int, size: float = 1.0, reg: float = 0.3) -> WeightTable:
        for _ in range(steps):
            self.step(size, reg)
        return self

    def predict(self, rows: DataFrame, id_col: str, terms_col: str) -> DataFrame:
        """``(id, margin, prediction)`` of other documents, weighted by the idf learned."""
        tf = terms.term_frequencies(rows.select(F.col(id_col).alias("id"), F.col(terms_col).alias("terms")), "id", "terms")
        known = self.weights.join(self.idf, "term")
        hits = salted_join(tf, known, "term", self.hot, self.rows_per_salt, spread_cols=["id"])
        sums = hits.groupBy("id").agg(F.sum(F.col("tf") * F.col("idf") * F.col("weight")).alias("margin"))
        ids = rows.select(F.col(id_col).alias("id")).distinct()
        out = ids.join(sums, "id", "left").withColumn("margin", F.coalesce("margin", F.lit(0.0)))
        return out.withColumn("prediction", (F.col("margin") > 0).cast("double"))

    def top_terms(self, k: int, decimals: int = 9) -> DataFrame:
        """The ``k`` strongest terms of either side: ``(side, term, weight)``; ties by term."""
        w = self.weights.select("term", F.round("weight", decimals).alias("weight"))
        most = w.where(F.col("weight") > 0).orderBy(F.col("weight").desc(), "term").limit(k)
        least = w.where(F.col("weight") < 0).orderBy(F.col("weight"), "term").limit(k)
        return most.select(F.lit("positive").alias("side"), "*").unionByName(least.select(F.lit("negative").alias("side"), "*"))
