"""Defined cases that the other tests leave out: null and repeated ids, very long rows, empty tables, clashing names."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from starlens.llm import embed_dup, html_extract, lang_id, line_dedup, lm_score, packing, plans, url_rules, warc
from starlens.llm.scratch import Scratch

DOCS = "doc_id long, text string"
BPE, PIECES = f"{plans.TOKENIZERS}/byte_bpe_50k.json", f"{plans.TOKENIZERS}/piece_bpe_32k.model"


def test_warc_null_and_repeated_ids_and_small_payloads(spark):
    pages = spark.createDataFrame(
        [(None, "u", "same"), (4, "u", "same"), (4, "v", "same"), (9, "u", "same"), (None, "u", "alone"), (None, "u", "alone"), (7, "u", None)],
        "page_id long, url string, html string")
    out = [(r.page_id, r.url, r.record_type, r.refers_to) for r in warc.archive_round_trip(pages, Scratch(spark, "ids")).collect()]
    assert sorted(out, key=str) == sorted([
        (None, "u", "revisit", 4), (4, "u", "response", None), (4, "v", "response", None), (9, "u", "revisit", 4),
        (None, "u", "response", None), (None, "u", "response", None), (7, "u", "response", None)], key=str)
    few = warc.archive_round_trip(pages, Scratch(spark, "min"), min_bytes=5).collect()
    assert {r.record_type for r in few} == {"response"} and len(few) == 7


def test_packing_null_ids_clashing_names_and_an_empty_table(spark):
    rows = [(None, "a b"), (None, "a b"), (3, "a b"), (3, "a b")]
    table = spark.createDataFrame(rows, DOCS).withColumn("start", F.lit("x")).withColumn("ids", F.lit("x"))
    out = packing.pack(table, BPE).collect()
    assert sorted(str(r.doc_id) for r in out if r.start == 0) == ["3", "3", "None", "None"]
    assert len({(r.sequence_id, r.offset) for r in out}) == len(out)
    assert packing.pack(table.limit(0), BPE).count() == 0


def test_language_of_very_long_texts_clashing_names_and_an_empty_table(spark):
    g = np.random.default_rng(2)
    make = {"aa": "abcde ", "zz": "vwxyz "}
    rows = [(i, "".join(g.choice(list(make[k]), 300)), k) for i, k in enumerate(["aa", "zz"] * 40)]
    model = lang_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    long = "".join(g.choice(list(make["zz"]), 2_000)) * 9_000  # 18 MB
    texts = [(1, long), (1, long), (2, None), (3, "12 34"), (None, rows[0][1])]
    table = spark.createDataFrame(texts, DOCS).withColumn("lang_pred", F.lit("x")).withColumn("Score", F.lit("x"))
    out = lang_id.predict(table, model, keep_text=False)
    assert [c.lower() for c in out.columns] == ["doc_id", "lang_pred", "score"]
    got = sorted(((str(r.doc_id), r.lang_pred) for r in out.select("doc_id", "lang_pred", "score").collect()))
    assert got == [("1", "zz"), ("1", "zz"), ("2", "und"), ("3", "und"), ("None", "aa")]
    assert lang_id.predict(table.limit(0), model).count() == 0
    assert lang_id.train(spark.createDataFrame([], "doc_id long, text string, lang string")) is None


def test_scores_of_repeated_rows_and_very_long_texts(spark):
    long = "one two three " * 100_000
    rows = [(1, "one two"), (1, "one two"), (2, long), (None, "one two"), (3, "q" * 50_000)]
    table = spark.createDataFrame(rows, DOCS).withColumn("score", F.lit("x")).withColumn("chunk", F.lit("x"))
    out = lm_score.score_texts(table, F.col("doc_id") == 3, PIECES, Scratch(spark, "long"), chunk_bytes=1000).collect()
    assert sorted((str(r.doc_id), r.n_tokens) for r in out) == [("1", 3), ("1", 3), ("2", 300_001), ("3", 2), ("None", 3)]
    assert {r.train_tokens for r in out} == {3 * 3 + 300_001}
    assert all(math.isfinite(r.score) and r.score < 0 for r in out)
    assert len({r.score for r in out if r.n_tokens == 3}) == 1


def test_lines_of_very_long_texts_clashing_names_and_an_empty_table(spark):
    shared = "a line that three documents hold in common"
    rows = [(k, "\n".join(f"line number {i} of the document {k}" for i in range(60_000)) + f"\n{shared}") for k in (1, 2, 3)]
    table = spark.createDataFrame(rows, DOCS)
    for name in ("N_Lines", "row", "id", "th", "key", "pos", "line", "lines"):
        table = table.withColumn(name, F.lit("x"))
    out = line_dedup.dedup_lines(table, Scratch(spark, "lines"))
    got = {r.doc_id: (r.n_lines, r.n_dropped, len(r.text)) for r in out.select("doc_id", "n_lines", "n_dropped", "text").collect()}
    assert got == {k: (60_001, int(k < 3), len(t) - (k < 3) * (len(shared) + 1)) for k, t in rows}
    assert line_dedup.dedup_lines(table.limit(0), Scratch(spark, "none")).count() == 0


def test_urls_that_repeat_are_long_or_clash(spark):
    rules = spark.createDataFrame([("net", "/", "block"), ("a.net", "/x/", "allow")], "host string, path string, verdict string")
    deep = "http://" + "s." * 20_000 + "a.net/x/" + "p/" * 100_000
    urls = [(1, deep), (1, deep), (None, "http://a.net/x/"), (2, "http://net/"), (3, "http:///x"), (4, "")]
    pages = spark.createDataFrame(urls, "page_id long, url string")
    for name in ("Host", "row", "hkey", "rules", "verdict"):
        pages = pages.withColumn(name, F.lit("x"))
    out = url_rules.judge_urls(pages, rules, Scratch(spark, "urls")).select("page_id", "rule", "verdict", F.length("path").alias("n"))
    got = sorted((str(r.page_id), r.rule, r.verdict, r.n) for r in out.collect())
    assert got == [("1", "a.net/x/", "allow", 200_003), ("1", "a.net/x/", "allow", 200_003), ("2", "net/", "block", 1),
                   ("3", None, "allow", 2), ("4", None, "allow", 0), ("None", "a.net/x/", "allow", 3)]


def test_pages_very_long_very_deep_and_broken(spark):
    story = "A sentence of a real story, with some words in it. " * 4
    many = "".join(f"<p>{story}{i}</p>" for i in range(20_000))
    rows = [(1, f"<article>{many}</article>"), (2, "<div>" * 50_000 + f"<article><p>{story}</p></article>"), (3, "</div>" * 1000 + "<" * 5000),
            (4, "<p>" + "x" * 3_000_000 + "</p>"), (None, f"<article><p>{story}</p></article>"), (None, None)]
    pages = spark.createDataFrame(rows, "page_id long, html string").withColumn("Text", F.lit("x"))
    out = html_extract.extract(pages).select("page_id", "text").collect()
    got = {r.page_id: r.text for r in out if r.text or r.page_id}
    assert got[1].count("\n") == 19_999 and got[1].endswith("19999")
    assert got[2] == got[None] == story.strip()
    assert len(out) == 6 and html_extract.extract(pages.limit(0)).count() == 0


@pytest.mark.parametrize("huge", [1e200, 1e308, 1e-200, 5e-324])
def test_vectors_of_mixed_lengths_and_sizes(spark, huge):
    rows = [(1, [1.0, 0.0, 0.0], "a"), (2, [huge, 0.0, 0.0], "a"), (3, [1.0, 0.0], "a"), (4, [huge, 0.0], "a"), (5, [1.0], "a"),
            (6, [-1.0, 0.0, 0.0], "a"), (7, [1.0, 0.0, 0.0], "b"), (8, [float("inf"), 0.0, 0.0], "a"), (2, [huge, 0.0, 0.0], "a")]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string").withColumn("kept", F.lit("x"))
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in embed_dup.near_vectors(table, Scratch(spark, "mixed")).collect())
    assert got == [(1, 2, 1), (2, 2, 1), (2, 2, 1), (3, 1, 3), (4, 1, 3), (5, 0, 5), (6, 0, 6), (7, 0, 7), (8, 0, 8)]


def test_vectors_of_an_empty_table(spark):
    table = spark.createDataFrame([], "vec_id long, embedding array<double>, label string")
    assert embed_dup.near_vectors(table, Scratch(spark, "none")).count() == 0
