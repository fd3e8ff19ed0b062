"""The pipeline's stages and its rows against brute force, on documents with every planted case."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from starlens.llm import plans
from starlens.llm.scratch import Scratch

from test_operators import BPE, brute_components

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, kept string"
WHITE = " \t\n\x0b\f\r"


def planted():
    """Documents: prose, copies, near copies, a shared line, benchmark passages, and texts without a language."""
    g = np.random.default_rng(11)
    words = {"en": [f"the{a}ing" for a in "abcdefghijklmnopqrst"], "de": [f"ü{a}ung" for a in "abcdefghijklmnopqrst"]}
    shared = "All rights reserved by the publisher of this page"
    item = "which of these seven answers is the right one to choose now"
    rows = []
    for i in range(40):
        lang = ("en", "de")[i % 2]
        text = " ".join(g.choice(words[lang], 120))
        if i % 5 == 0:
            text = f"{shared}\n{text}\n  {shared.upper()}"
        if i % 7 == 0:
            text += f" {item}."
        rows.append((i, text, lang))
        if i % 4 == 0:
            rows.append((100 + i, text, lang))
        if i % 6 == 0:
            rows.append((200 + i, text.replace(text.split()[60], "changed", 1), None))
        if i % 6 == 1:  # two changed words in about 120: a similarity between 0.8 and 0.85
            w = text.split(" ")
            w[30], w[80] = "this", "that"
            rows.append((400 + i, " ".join(w), lang))
    rows += [(300, None, None), (301, "", "en"), (302, "12 !! ½", "en"), (303, "x", "en"), (304, shared, "en")]
    bench = [(1, item.upper()), (2, None), (3, "")]
    return [(i, t, lang, "web", None if t is None else len(t), "clash") for i, t, lang in rows], bench


def brute_lines(rows):
    keys = {}
    for i, text in rows:
        for line in text.split("\n"):
            key = line.strip(WHITE).lower()
            if len(key) >= 20:
                keys.setdefault(key, set()).add(i)
    drop = {k: max(v) for k, v in keys.items() if len(v) >= 3}
    return [(i, "\n".join(x for x in text.split("\n") if drop.get(x.strip(WHITE).lower(), i) == i)) for i, text in rows]


def brute_words(text):
    return "".join(c.lower() if c.isalnum() or ord(c) > 127 else " " for c in text).split()


def brute_clean(rows, bench):
    windows = set()
    for _, text in bench:
        w = brute_words(text or "")
        windows |= {tuple(w[s:s + 10]) for s in range(max(1, len(w) - 9)) if w}
    out = []
    for i, text in rows:
        w = brute_words(text)
        if not any(tuple(w[s:s + n]) in windows for n in {len(x) for x in windows} for s in range(len(w) - n + 1)):
            out.append((i, text))
    return out


@pytest.fixture
def tables(spark, tmp_path):
    rows, bench = planted()
    spark.createDataFrame(rows, COLUMNS).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path), rows, bench


def test_every_stage_and_the_rows(spark, tables):
    from tokenizers import Tokenizer

    folder, rows, bench = tables
    expected = [[(r[0], r[1]) for r in rows if any(map(str.isalpha, r[1] or ""))]]
    expected.append(brute_lines(expected[-1]))
    low = brute_components(expected[-1])
    expected.append([(i, t) for i, t in expected[-1] if low[i][1] == i])
    expected.append(brute_clean(expected[-1], bench))
    assert all(len(a) > len(b) for a, b in zip([rows, *expected[1:]], expected[2:]))  # each case is there

    docs, scratch = spark.read.parquet(f"{folder}/documents.parquet"), Scratch(spark, "stages")
    for (name, stage), want in zip(corpus_pipeline.STAGES, expected):
        columns = docs.columns
        docs = scratch.save(stage(spark, docs, folder), name)
        assert docs.columns == columns, name
        assert sorted((r.doc_id, r.text) for r in docs.collect()) == sorted(want), name
    assert all(r.n_chars == len(r.text) and r.kept == "clash" for r in docs.collect())

    tokens = Tokenizer.from_file(BPE)
    ids = {i: [*tokens.encode(t, add_special_tokens=False).ids, 1] for i, t in expected[-1]}
    seen, sequences = {i: 0 for i in ids}, {}
    for r in sorted(corpus_pipeline.run(spark, folder).collect(), key=lambda r: (r.doc_id, r.start)):
        part = ids[r.doc_id][r.start:r.start + r.length]
        assert r.start == seen[r.doc_id] and r.doc_tokens == len(ids[r.doc_id]) and len(part) == r.length > 0
        assert r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
        seen[r.doc_id] += r.length
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert seen == {i: len(x) for i, x in ids.items()}
    for parts in sequences.values():
        ends = np.cumsum([0] + [n for _, n in sorted(parts)])
        assert [o for o, _ in sorted(parts)] == ends[:-1].tolist() and ends[-1] <= 2048


def test_empty_and_wordless_tables(spark, tmp_path):
    blank = [(1, None, None, None, None), (2, "", "en", "a", 0), (None, " \t\n", None, "a", 3)]
    for name, rows in (("none", []), ("blank", blank)):
        folder = f"{tmp_path}/{name}"
        spark.createDataFrame(rows, COLUMNS.rsplit(", ", 1)[0]).write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
        assert corpus_pipeline.run(spark, folder).count() == 0


def test_stages_keep_columns_with_clashing_names(spark, tables):
    folder, _, _ = tables
    plain = spark.read.parquet(f"{folder}/documents.parquet").drop("kept")
    names = ["gone", "lang_pred", "SCORE", "n_lines", "N_words", "n_hit", "items", "contaminated", "row", "held", "id", "th", "odd.name x"]
    docs = plain.select("*", *[F.concat(F.lit(n), F.col("doc_id").cast("string")).alias(n) for n in names])
    scratch = Scratch(spark, "clash")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        plain = scratch.save(stage(spark, plain, folder), f"{name}-plain")
        docs = scratch.save(stage(spark, docs, folder), name)
        assert docs.columns == plain.columns + names, name
        key = ["doc_id", "text", "lang", "n_chars"]
        assert sorted(map(str, docs.select(key).collect())) == sorted(map(str, plain.select(key).collect())), name
        assert all(r[n] == f"{n}{r.doc_id}" for r in docs.collect() for n in names), name


def test_unlabelled_corpus_keeps_its_documents(spark, tmp_path):
    rows, bench = planted()
    spark.createDataFrame([(*r[:2], None, *r[3:]) for r in rows], COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = corpus_pipeline.language(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns
    expected = [(r[0], r[1]) for r in rows if any(map(str.isalpha, r[1] or ""))]
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == sorted(expected)
    expected = brute_lines(expected)
    low = brute_components(expected)
    expected = brute_clean([(i, t) for i, t in expected if low[i][1] == i], bench)
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == {i for i, _ in expected}


def test_language_stage_keeps_wanted_languages(spark, tables):
    folder, rows, _ = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    lettered = {r[0] for r in rows if any(map(str.isalpha, r[1] or ""))}
    de, en = ({r.doc_id for r in corpus_pipeline.language(spark, docs, folder, wanted=[x]).collect()} for x in ("de", "en"))
    assert not de & en and de | en == lettered
    assert {r[0] for r in rows if r[2] == "de"} <= de
    undetermined = docs.withColumn("lang", F.when(F.col("lang") == "de", "und").otherwise(F.col("lang")))
    assert {r.doc_id for r in corpus_pipeline.language(spark, undetermined, folder).collect()} == lettered


def test_registered_queries_are_the_fourteen():
    assert sorted(int(q[2:].split("_")[0]) for q in plans.QUERIES) == list(range(1, 14))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_dedup", "decontamination", "packing"]
