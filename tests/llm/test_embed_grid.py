"""Links of vectors without an id, and how much of the grid is skipped."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from starlens.llm import embed_dup
from starlens.llm.scratch import Scratch

VECS = "vec_id long, embedding array<double>, label int"


@pytest.fixture
def scratch_tables(spark):
    return Scratch(spark, "grid")


def test_vectors_without_an_id_are_links_and_bridges(spark, scratch_tables):
    def at(angle):
        return [float(np.cos(angle)), float(np.sin(angle)), 0.0]

    rows = [(1, at(0.0), 0), (None, at(0.15), 0), (3, at(0.3), 0), (None, at(2.0), 0), (None, at(2.0), 0), (9, at(2.1), 0), (None, at(0.15), 1),
            (20, [1.0, 0.0], 0), (21, [1.0, 0.001], 0), (30, [1e300, 0.0, 1e290], 2), (31, [5e-324, 0.0, 0.0], 2)]
    got = embed_dup.near_vectors(spark.createDataFrame(rows, VECS), scratch_tables).collect()
    of = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got if r.vec_id is not None}
    assert of[1] == (1, 1, True) and of[3] == (1, 1, False)  # joined by the vector between them
    assert of[9] == (2, 9, True)  # two copies without an id
    assert of[20] == (1, 20, True) and of[21] == (1, 20, False)  # lengths are compared with their like
    assert of[30] == (1, 30, True) and of[31] == (1, 30, False)
    none = sorted((r.n_links, r.component_id, r.kept) for r in got if r.vec_id is None)
    assert none == [(0, None, False), (2, None, False), (2, None, False), (2, None, False)]


def blocks_of(x, axes, eps, sizes):
    """Sides as the operator makes them: grid order, cut in runs."""
    mean = x.mean(axis=0)
    basis = np.ascontiguousarray(np.linalg.eigh(x.T @ x / len(x) - np.outer(mean, mean))[1][:, ::-1][:, :axes])
    y = x @ basis
    y = np.concatenate([y, np.sqrt(np.maximum(0, 1 - (y * y).sum(axis=1)))[:, None]], axis=1)
    order = np.lexsort(np.floor(y[:, :axes] / eps).T[::-1])
    out = []
    for n, at in enumerate(range(0, len(x), sizes)):
        rows = order[at:at + sizes]
        out.append(embed_dup._Side({"block": n, "reps": rows.astype(np.int64).tobytes(), "copies": np.ones(len(rows), np.int64).tobytes(),
                                    "data": x[rows].tobytes(), "dim": x.shape[1], "y": y[rows].tobytes()}))
    return out


@pytest.mark.parametrize("spread", [0.02, 0.2])
def test_blocks_link_what_brute_force_links(spread):
    g = np.random.default_rng(3)
    centres = g.standard_normal((40, 24))
    x = embed_dup.unit_rows(np.repeat(centres, 10, axis=0) + g.standard_normal((400, 24)) * spread)
    eps = np.sqrt(0.04)
    sides = blocks_of(x, 6, eps, 128)
    want = x @ x.T >= 0.98
    for p in sides:
        for q in sides:
            found = embed_dup.join_blocks(p, q, 0.98, eps * eps + embed_dup.SLACK)
            assert (found == want[np.ix_(p.reps, q.reps)]).all()


def test_most_pairs_of_the_given_vectors_are_skipped(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").where(F.col("label") == 3).collect()
    x = embed_dup.unit_rows(np.array([r.embedding for r in rows], float))
    sides = blocks_of(x, embed_dup.AXES, np.sqrt(0.04), embed_dup.BLOCK)
    near = sum(len(embed_dup.near_pairs(p.y, q.y, 0.04)[0]) for p in sides for q in sides)
    assert near < 0.1 * len(x) ** 2
