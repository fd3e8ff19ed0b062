"""Operators 11 to 13 against brute force, and their defined cases."""

import hashlib
import math
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from starlens.llm import centroids, plans, quality, whiten
from starlens.llm.scratch import Scratch

VECS = "vec_id long, embedding array<float>, component int"


@pytest.fixture
def scratch_tables(spark):
    return Scratch(spark, "test")


def random_vectors(n, dims, seed=1, scale=0.3):
    return (np.random.default_rng(seed).standard_normal((n, dims)) * scale).astype(np.float32)


# --- 11 whitening -------------------------------------------------------------------------
def brute_whitening(vectors, components):
    """Whole numbers and fractions throughout; only the eigenvectors are floating point."""
    x = {i: tuple(math.floor(64 * float(c)) + 1000000 for c in v) for i, v in vectors.items()}
    fit = sorted(set(x.values()))
    n, dims = len(fit), len(fit[0])
    total = [sum(v[d] for v in fit) for d in range(dims)]
    cov = np.array([[float(Fraction(sum((n * v[a] - total[a]) * (n * v[b] - total[b]) for v in fit), n ** 3))
                     for b in range(dims)] for a in range(dims)])
    e, u = np.linalg.eigh(cov)
    order = np.argsort(-e)[:components]
    out = {}
    for i, v in x.items():
        off = [n * c - t for c, t in zip(v, total)]
        out[i] = (n, sum(o * o for o in off), (np.array([float(Fraction(o, n)) for o in off]) @ u[:, order]) / np.sqrt(e[order]))
    return out, e[order] / np.trace(cov)


def test_whitening_equals_exact_fractions(spark, scratch_tables):
    base = random_vectors(90, 6)
    vectors = {i: v for i, v in enumerate(base)}
    vectors.update({1000 + i: base[3] for i in range(40)})  # copies count once in the fit
    rows = [(i, [float(c) for c in v], 7) for i, v in vectors.items()]
    rows += [(2000, None, 7), (2001, [float("nan")] * 6, 7), (2002, [1.0] * 5 + [None], 7), (2003, [float("inf")] * 6, 7), (2004, [], 7)]
    df = spark.createDataFrame(rows, VECS).repartition(5)
    model = whiten.fit(df, scratch_tables, components=4)
    got = whiten.transform(df, model).collect()
    want, explained = brute_whitening(vectors, 4)
    assert len(got) == 4 * len(vectors)
    by = {(r.vec_id, r.component): r for r in got}
    sign = [np.sign(by[0, c + 1].whitened * want[0][2][c]) for c in range(4)]
    for i, (n, deviation, white) in want.items():
        for c in range(4):
            r = by[i, c + 1]
            assert (r.n, int(r.deviation)) == (n, deviation)
            assert r.whitened * sign[c] == pytest.approx(white[c], abs=1e-9)
            assert r.explained == pytest.approx(explained[c], rel=1e-9)
    assert max(r.identity_error for r in got) < 1e-9
    fit = {tuple(math.floor(64 * float(c)) for c in v): i for i, v in vectors.items()}
    white = np.array([[by[i, c + 1].whitened for c in range(4)] for i in fit.values()])
    assert np.abs(np.cov(white.T, bias=True) - np.eye(4)).max() < 1e-9  # measured over the fit list


def test_whitening_of_few_repeated_and_no_vectors(spark, scratch_tables):
    rows = [(None, [1.0, 2.0, 3.0], 0), (1, [1.0, 2.0, 3.0], 0), (1, [1.0, 2.0, 3.0], 0), (2, [2.0, 2.0, 3.0], 0), (3, [0.0, 2.0, 3.5], 0),
            (4, [9.0, 9.0], 0)]
    df = spark.createDataFrame(rows, VECS)
    out = whiten.transform(df, whiten.fit(df, scratch_tables)).collect()
    assert {r.component for r in out} == {1, 2} and len(out) == 5 * 2  # rank 2; the short vector has no place
    assert sum(r.vec_id is None for r in out) == 2 and sum(r.vec_id == 1 for r in out) == 4
    for few in (df.limit(0), df.where("vec_id = 1"), df.where("vec_id = 99")):
        model = whiten.fit(few, Scratch(spark, "few"))
        empty = whiten.transform(few, model)
        assert empty.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
        assert empty.count() == 0


def test_whitening_is_exact_beyond_longs(spark, scratch_tables):
    rows = [(1, [2e15, 1.0], 0), (2, [-3e15, 2.0], 0), (3, [1e14, 2.5], 0)]
    df = spark.createDataFrame(rows, VECS)
    got = {r.vec_id: r for r in whiten.transform(df, whiten.fit(df, scratch_tables)).where("component = 1").collect()}
    x = {i: [math.floor(float(np.float32(c)) * 64) + 10**6 for c in v] for i, v, _ in rows}
    total = [sum(v[d] for v in x.values()) for d in range(2)]
    want = {i: sum((3 * c - t) ** 2 for c, t in zip(v, total)) for i, v in x.items()}
    assert {i: int(r.deviation) for i, r in got.items()} == want and min(want.values()) > 2**63
    far = spark.createDataFrame([(1, [3e38, 1.0], 0), (2, [-3e38, 2.0], 0), (3, [0.0, 0.0], 0)], VECS)
    out = whiten.transform(far, whiten.fit(far, Scratch(spark, "far"))).collect()
    assert out and all(math.isfinite(r.whitened) for r in out)


def test_bit_planes_count_products():
    x = np.random.default_rng(3).integers(-50, 60, (133, 3))
    low = x.min(axis=0)
    bits = [int(b).bit_length() for b in x.max(axis=0) - low]
    dim, bit = np.repeat(np.arange(3), bits), np.concatenate([np.arange(b) for b in bits])
    p = whiten.planes(x, low, dim, bit)
    for a in range(3):
        for b in range(3):
            total = sum(int(np.bitwise_count(p[q] & p[r]).sum()) << int(bit[q] + bit[r])
                        for q in np.flatnonzero(dim == a) for r in np.flatnonzero(dim == b))
            assert total == int(((x[:, a] - low[a]) * (x[:, b] - low[b])).sum())


# --- 12 centroid clustering ------------------------------------------------------------------
def brute_clusters(rows, k, rounds, scale):
    x = [(i, [math.floor(scale * float(np.float32(c))) for c in v]) for i, v in rows]
    start = sorted(x, key=lambda r: (i_hash(r[0]), r[1]))[:k]
    cents = [v for _, v in start]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(cents))

    for _ in range(rounds):
        of = [near(v)[1] for _, v in x]
        cents = [[sum(col) // len(col) for col in zip(*(v for (_, v), o in zip(x, of) if o == j))] if j in of else c
                 for j, c in enumerate(cents)]
    return [(i, *near(v)) for i, v in x], cents


def i_hash(i):
    return "~" if i is None else hashlib.sha256(f"2:{i}".encode()).hexdigest()


def test_clusters_equal_brute_force(spark, scratch_tables):
    v = random_vectors(120, 5, seed=4)
    rows = [(i, [float(c) for c in x]) for i, x in enumerate(v)]
    rows += [(500 + i, rows[0][1]) for i in range(60)] + [(7, rows[7][1])] * 3 + [(None, rows[9][1])]  # copies, repeats, no id
    extra = [(900, None), (901, [1.0] * 4), (902, [1.0] * 4 + [None]), (903, [float("nan")] * 5), (904, [float("-inf")] * 5), (905, [])]
    df = spark.createDataFrame([(i, x, 1) for i, x in rows + extra], "vec_id long, embedding array<float>, cluster int").repartition(4)
    got = centroids.cluster(df, scratch_tables, k=8, rounds=3, dims=5).collect()
    want, cents = brute_clusters(rows, 8, 3, 256)
    assert sorted((str(r.vec_id), r.distance, r.cluster) for r in got) == sorted((str(i), d, c) for i, d, c in want)
    inertia = {c: sum(d for _, d, o in want if o == c) for c in range(8)}
    for r in got:
        assert int(r.cluster_inertia) == inertia[r.cluster] and int(r.inertia) == sum(inertia.values())
        assert list(r.centroid) == cents[r.cluster]


def test_clusters_ties_few_none_and_great_values(spark, scratch_tables):
    same = [(i, [0.5, 0.25]) for i in range(4)]
    schema = "vec_id long, embedding array<double>"
    got = centroids.cluster(spark.createDataFrame(same, schema), scratch_tables, k=3, rounds=2, dims=2).collect()
    assert {(r.cluster, r.distance) for r in got} == {(0, 0)}  # the smallest number of equal centroids; the empty ones stay
    few = centroids.cluster(spark.createDataFrame(same[:1] + [(9, [1e30, -1e30])], schema), Scratch(spark, "few"), k=40, rounds=1, dims=2).collect()
    assert sorted(r.vec_id for r in few) == [0, 9] and all(r.distance == 0 for r in few)
    none = centroids.cluster(spark.createDataFrame([], schema), Scratch(spark, "none"), dims=2)
    assert none.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid"] and none.count() == 0


def test_cluster_plan_has_no_python(spark, sf_small):
    plan = plans.QUERIES["op12_centroids"](spark, sf_small)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


# --- 13 quality ------------------------------------------------------------------------------
def brute_features(text):
    """Counted one byte and one word at a time."""
    raw = (text or "").encode("utf-8", "replace")
    kinds = [int(quality.CLASSES[b]) for b in raw]
    n = len(kinds) + quality.PRIOR
    k = quality.KINDS
    out = [kinds.count(i) / n for i in range(k)]
    out += [sum((a, b) == (i, j) for a, b in zip(kinds, kinds[1:])) / n for i in range(k) for j in range(k)]
    words, lines = (text or "").split(), text.split("\n") if text else []
    w = len(words) + quality.PRIOR
    windows = [words[i:i + quality.WORD_WINDOW] for i in range(0, len(words), quality.WORD_WINDOW)]
    out += [sum(a == b for a, b in zip(words, words[1:])) / w, sum(len(x) - len(set(x)) for x in windows) / w,
            sum(a == b != "" for a, b in zip(lines, lines[1:])) / (len(lines) + quality.PRIOR), sum(map(len, words)) / w / 10]
    return out


@pytest.mark.parametrize("text", [None, "", " ", "a", "Été | of of the THE!! 12\n\nx x\nx x\n", "w " * 300 + "\n" + "$$$ é"])
def test_features_equal_a_plain_count(text):
    assert quality.features(text) == pytest.approx(brute_features(text))


def test_features_of_a_very_long_text_are_whole():
    text = "some words here\nsome more!! of of " * 400_000  # several folds
    end = quality.features(text + "|" * 3_000_000)
    assert end[7] > 0.15 and end[:quality.KINDS].sum() == pytest.approx(1, abs=1e-4)
    assert quality.features(text)[:quality.KINDS + quality.KINDS ** 2] == pytest.approx(
        quality.features(text[:34 * 1000])[:quality.KINDS + quality.KINDS ** 2], abs=3e-3)


def test_fit_lowers_pairwise_loss_and_ranks():
    g = np.random.default_rng(0)
    x = g.standard_normal((600, 5))
    y = (x @ [2, -1, 0, 0, 0.5] + g.standard_normal(600) * 0.3 > 0).astype(float)
    w = quality.fit(x, y, pairs=5000)
    r = x @ w
    assert (r[y == 1][:, None] > r[y == 0]).mean() > 0.97
    assert quality.fit(x, np.ones(600)) is None


def test_quantile_is_the_order_statistic(spark):
    v = [float(x) for x in np.random.default_rng(2).standard_normal(2000)] + [0.25] * 1000
    df = spark.createDataFrame([(x,) for x in v], "r double")
    for share in (0.0, 0.1, 0.5, 0.9, 1.0):
        t = quality.quantile(df, "r", share)
        assert abs(sum(x < t for x in v) - share * len(v)) <= 1000 + 1  # ties move together
        s = sorted(v)
        assert s[max(0, math.ceil(share * len(v)) - 1)] == pytest.approx(t, abs=1e-6)
    assert quality.quantile(df.limit(0), "r", 0.5) is None


def sigmoid(z):
    return 1 / (1 + math.exp(-z))


def test_query_equals_a_local_model_and_holds_out(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in plans.QUERIES["op13_quality"](spark, sf).collect()}
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    out = {i: zlib.crc32(str(i).encode()) % 5 == 0 for i in docs}
    assert set(got) == set(docs) and all(got[i].held_out == out[i] for i in docs)
    ids = sorted((i for i in labels if not out[i]), key=lambda i: hashlib.md5(str(i).encode()).hexdigest())
    x, y = np.array([quality.features(docs[i]) for i in ids]), np.array([float(labels[i]) for i in ids])
    w = quality.fit(x, y)
    raw = np.sort(x @ w)
    t = raw[math.ceil((y == 0).mean() * len(raw) - 1e-9) - 1]
    steep = 1 / max(1, np.abs(x @ w - t).max() / quality.REACH)
    for i in list(docs)[::7]:
        want = sigmoid((quality.features(docs[i]) @ w - t) * steep + math.log(0.3 / 0.7))
        assert got[i].score == pytest.approx(want, abs=1e-4) and got[i].predicted == int(got[i].score >= 0.3)
    held = [(got[i].predicted, labels[i]) for i in labels if out[i]]
    assert sum(p == q for p, q in held) / len(held) > 0.95


def test_quality_defined_cases(spark, scratch_tables):
    good, bad = "Plain words of some length, as one writes them. ", "$$$ a||b!! $$$ "
    rows = [(i, good * (i % 4 + 1) + str(i), 0.0) for i in range(40)] + [(100 + i, bad * (i % 5 + 2), 0.0) for i in range(20)]
    rows += [(None, good, 0.0), (200, None, 0.0), (201, "", 0.0), (3, bad * 3, 0.0), (3, good, 0.0), (202, good * 20_000, 0.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, 1) for i in range(40)] + [(100 + i, 0) for i in range(20)]
                                   + [(5, 0), (6, None), (6, 2), (None, 1), (999, 1), (1, 1)], "doc_id long, quality int")
    all_rows = F.lit(True)
    got = quality.score_documents(docs, labels, all_rows, scratch_tables)
    assert got.columns == ["doc_id", "score", "predicted"]
    out = got.collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out)
    of = {r.doc_id: r for r in out}
    assert of[202].predicted == 1 and of[10].predicted == 1 and of[105].predicted == 0 and of[200].score == of[201].score
    assert quality.score_documents(docs.limit(0), labels, all_rows, Scratch(spark, "e")).count() == 0
    for some, share in ((labels.limit(0), 0.5), (labels.where("quality = 1"), 1.0), (labels.where("quality = 0 and doc_id > 50"), 0.0)):
        flat = quality.score_documents(docs, some, all_rows, Scratch(spark, "flat")).collect()
        assert {(r.score, r.predicted) for r in flat} == {(share, int(share >= 0.3))}
