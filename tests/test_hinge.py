"""Weights as a table: against plain loops, MLlib's top terms, batches and odd rows."""

import math
import random

import pytest

from starlens.operators import hinge, models

SCHEMA = "id long, g array<string>, label double"


def small(n=60, seed=2):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        good = i % 3 > 0
        words = [r.choice(["fine", "great", "nice"] if good else ["poor", "awful", "bad"]) for _ in range(2)]
        rows.append((i, words + [r.choice("abcdefgh") for _ in range(6)] + ["the"], float(good)))
    return rows


def brute(rows, steps, size, reg):
    """Full batches, one term at a time."""
    n, df = len(rows), {}
    for _, g, _ in rows:
        for t in set(g):
            df[t] = df.get(t, 0) + 1
    x = {i: {t: g.count(t) * math.log((n + 1) / (df[t] + 1)) for t in set(g)} for i, g, _ in rows}
    y = {i: 1 if label == 1 else -1 for i, _, label in rows}
    w = dict.fromkeys(df, 0.0)
    losses = []
    for k in range(steps + 1):
        m = {i: y[i] * sum(v * w[t] for t, v in x[i].items()) for i in x}
        losses.append(sum(max(0, 1 - v) for v in m.values()) / n + reg / 2 * sum(v * v for v in w.values()))
        eta = size / math.sqrt(k + 1)
        g = dict.fromkeys(w, 0.0)
        for i in x:
            if m[i] < 1:
                for t, v in x[i].items():
                    g[t] += y[i] * v / n
        if k < steps:
            w = {t: (1 - eta * reg) * v + eta * g[t] for t, v in w.items()}
    return w, losses


def test_steps_equal_plain_loops_and_the_loss_falls(spark):
    rows = small()
    table = hinge.WeightTable(spark.createDataFrame(rows, SCHEMA), "id", "g", "label")
    w, losses = brute(rows, 3, 0.5, 0.1)
    got = [table.report(0.1).first().loss]
    for _ in range(3):
        table.step(0.5, 0.1)
        got.append(table.report(0.1).first().loss)
    assert got == pytest.approx(losses) and losses[-1] < losses[0]
    assert {r.term: r.weight for r in table.weights.collect()} == pytest.approx(w)
    top = {r.term: r.side for r in table.top_terms(3).collect()}
    assert top == {"fine": "positive", "great": "positive", "nice": "positive", "poor": "negative", "awful": "negative", "bad": "negative"}
    out = {r.id: r.prediction for r in table.predict(spark.createDataFrame(rows + [(900, ["new"], 1.0)], SCHEMA), "id", "g").collect()}
    assert sum(out[i] == label for i, _, label in rows) >= 0.95 * len(rows) and out[900] == 0.0


def test_top_terms_agree_with_mllib(spark):
    rows = [(i, " ".join(g), label) for i, g, label in small(90)]
    df = spark.createDataFrame(rows, "doc_id long, text string, label_raw double")
    pipeline = models.svm_trigram_pipeline(vocab_size=1000, max_iter=20, reg_param=0.01)
    fitted = models.fit(pipeline, df, "doc_id")
    theirs = models.top_weighted_terms(models.term_weights(spark, fitted), 15).collect()
    grams = fitted.transform(df).select("doc_id", "terms", "label_raw")
    ours = hinge.WeightTable(grams, "doc_id", "terms", "label_raw").fit(4, 0.05, 0.01).top_terms(40).collect()
    # class 1.0 is the more frequent one, index 0 of MLlib's labels
    sides = {r.term: {"1.0": "positive", "0.0": "negative"}[r.for_class] for r in theirs}
    shared = [r for r in ours if r.term in sides]
    assert len(shared) >= 10 and all(sides[r.term] == r.side for r in shared)


def test_batches_empty_batches_and_salted_terms(spark):
    rows = small(40)
    odd = [(900, None, 1.0), (901, [], 1.0), (None, ["x"], 1.0), (902, ["y"], None)]
    df = spark.createDataFrame(rows + odd, SCHEMA)
    table = hinge.WeightTable(df, "id", "g", "label", batches=3, rows_per_salt=5)
    assert table.n == len(rows) + 1  # the one without terms is a document
    before = table.report(0.01).first()
    after = table.fit(6, 0.3, 0.01).report(0.01).first()
    assert before.loss == 1.0 and after.loss < 0.8 and after.n == before.n
    assert "y" not in {r.term for r in table.weights.collect()}
    plain = hinge.WeightTable(df, "id", "g", "label", batches=3).fit(6, 0.3, 0.01)
    assert {r.term: r.weight for r in plain.weights.collect()} == pytest.approx({r.term: r.weight for r in table.weights.collect()})
    none = hinge.WeightTable(df.limit(0), "id", "g", "label").fit(2)
    assert none.weights.count() == 0 and none.top_terms(3).count() == 0


def test_terms_of_one_document_stay_out_of_the_joins(spark):
    """Their weights follow from their document's factor; all weights and losses are the plain loops'."""
    rows = [(i, g + [f"only{i}", f"only{i}", f"lone{i}"], label) for i, g, label in small(30)] + [(70, ["just", "these"], 0.0), (71, [], 1.0)]
    table = hinge.WeightTable(spark.createDataFrame(rows, SCHEMA), "id", "g", "label").fit(3, 0.5, 0.1)
    w, losses = brute(rows, 3, 0.5, 0.1)
    shared = {r.term for r in table.shared.collect()}
    assert shared == {t for t in w if sum(t in g for _, g, _ in rows) > 1}
    assert {r.term: r.weight for r in table.weights.collect()} == pytest.approx(w)
    assert table.report(0.1).first().loss == pytest.approx(losses[-1])
    out = {r.id: r.margin for r in table.predict(spark.createDataFrame([(1, ["only3", "just"], 1.0)], SCHEMA), "id", "g").collect()}
    idf = math.log((len(rows) + 1) / 2)
    assert out[1] == pytest.approx(idf * (w["only3"] + w["just"]))
    assert table.report(0.1).first() == table.report(0.1).first() and table._kept is not None
