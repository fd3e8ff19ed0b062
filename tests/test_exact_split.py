"""Exact split sizes, distinct sketches and bucketed joins."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from starlens.operators import joins, sketches, split


def brute(rows, seed, permille):
    side = {}
    for c in {c for _, c in rows}:
        keys = sorted((int(hashlib.md5(f"{seed}:{k}".encode()).hexdigest()[:15], 16), k) for k, d in rows if d == c)
        for i, (_, k) in enumerate(keys):
            side[k] = "train" if i < (len(keys) * permille + 500) // 1000 else "test"
    return side


def test_sizes_are_exact_and_partitioning_does_not_matter(spark):
    rows = [(i, random.Random(i).choice("aaaab") if i % 11 else None) for i in range(700)] + [(5000, "lonely")]
    df = spark.createDataFrame(rows, "k long, c string")
    want = brute(rows, 42, 700)
    for n in (1, 8):
        got = {r.k: r.side for r in split.exact_split_side(df.repartition(n), "k", "c", 42).collect()}
        assert got == want
    assert {r.k: r.side for r in split.exact_split_side(df, "k", "c", 7, 0.25).collect()} == brute(rows, 7, 250)


@pytest.mark.parametrize("share, side", [(0.0, "test"), (1.0, "train")])
def test_all_or_none(spark, share, side):
    df = spark.createDataFrame([(i, i % 3) for i in range(30)], "k long, c int")
    assert {r.side for r in split.exact_split_side(df, "k", "c", 1, share).collect()} == {side}
    assert split.exact_split_side(df.limit(0), "k", "c", 1, share).count() == 0


def test_rows_without_a_key_are_test_rows(spark):
    df = spark.createDataFrame([(None, "a"), (1, "a"), (2, "a")], "k long, c string")
    got = split.exact_split_side(df, "k", "c", 3, 1.0).collect()
    assert sorted(str(r.k) + r.side for r in got) == ["1train", "2train", "Nonetest"]


def test_sketches_of_days_merge_to_the_whole(spark):
    df = spark.range(60_000).select((F.col("id") % 7).alias("day"), F.when(F.col("id") % 1000 > 0, F.col("id") * 31 % 20_011).alias("user"))
    parts = sketches.distinct_sketches(df, "user", ["day"])
    assert parts.count() == 7
    merged, whole = (sketches.merged_duplicates(p).collect()[0] for p in (parts, sketches.distinct_sketches(df, "user", [F.lit(1).alias("one")])))
    assert merged == whole and merged.n_rows == 60_000
    exact = df.agg(F.count_distinct("user")).first()[0] + 1
    assert abs(merged.n_distinct - exact) <= 4 * sketches.standard_error() * exact
    assert merged.n_duplicates == 60_000 - merged.n_distinct
    by_day = {r.day: r for r in sketches.merged_duplicates(parts, ["day"]).collect()}
    assert sum(r.n_rows for r in by_day.values()) == 60_000
    empty = sketches.merged_duplicates(sketches.distinct_sketches(df.limit(0), "user", ["day"])).collect()[0]
    assert (empty.n_rows, empty.n_distinct, empty.n_duplicates) == (0, 0, 0)


def test_bucketed_join_shuffles_nothing(spark):
    left = spark.range(1000).select((F.col("id") % 97).alias("k"), F.col("id").alias("v"))
    right = spark.range(90).select(F.col("id").alias("k"), (F.col("id") * 2).alias("w"))
    names = [joins.write_bucketed(t, "k", 4) for t in (left, right)]
    joined = joins.bucketed_join(spark.table(names[0]), spark.table(names[1]), "k", "l_", "r_")
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    want = joins.prefixed_inner_join(left, right, "k", "l_", "r_")
    assert sorted(map(tuple, joined.collect())) == sorted(map(tuple, want.collect()))
    for n in names:
        spark.sql(f"DROP TABLE {n}")
