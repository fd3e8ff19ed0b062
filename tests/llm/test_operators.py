"""Each operator against brute force, and its edge cases: nulls, empty and long texts, ties, repeats, clashes."""

import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from starlens.llm import (decontam, embed_dup, html_extract, lang_id, line_dedup, lm_score, near_dup, packing, plans,
                          url_rules, warc)
from starlens.llm.components import components
from starlens.llm.scratch import Scratch

DOCS = "doc_id long, text string"
BPE, PIECES = f"{plans.TOKENIZERS}/byte_bpe_50k.json", f"{plans.TOKENIZERS}/piece_bpe_32k.model"


@pytest.fixture
def scratch_tables(spark):
    return Scratch(spark, "test")


def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS)


def test_components_of_a_chain_and_a_star(spark, scratch_tables):
    edges = [(i, i + 1) for i in range(10, 40)] + [(100, k) for k in range(101, 120)] + [(7, 7)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long"), "a", "b", scratch_tables).collect())
    assert got == {**{i: 10 for i in range(10, 41)}, **{k: 100 for k in range(100, 120)}}


# --- 1 WARC ---------------------------------------------------------------------------------
def test_warc_round_trip_and_revisits(spark, scratch_tables):
    rows = [(1, "http://a/é\r\nX: y", "<p>é</p>"), (2, None, "<p>é</p>"), (3, "u", None), (4, "u", ""), (5, "u", "z" * 3_000_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("status", F.lit("clash"))
    got = {r.page_id: r for r in warc.archive_round_trip(pages, scratch_tables, with_payload=True).collect()}
    assert {r.status for r in got.values()} == {"ok"}
    assert [(got[i].record_type, got[i].refers_to) for i in (1, 2, 3, 4, 5)] == [
        ("response", None), ("revisit", 1), ("response", None), ("revisit", 3), ("response", None)]
    for page_id, url, html in rows:
        body = (html or "").encode()
        assert got[page_id].payload_bytes == len(body) and got[page_id].payload_digest == warc.base32_sha1(body)
        assert got[page_id].url == url
    assert bytes(got[5].payload) == b"z" * 3_000_000
    assert warc.archive_round_trip(pages.limit(0), Scratch(spark, "none")).count() == 0


def test_warc_reader_reports_damage():
    good = warc.encode_record(1, "u", b"body", False, None, "d")
    raw = zlib.decompress(good, 31)

    def read(data):
        return [warc.decode_record(p) for p in warc.members([data[:7], data[7:]])]

    assert [r["status"] for r in read(good + good)] == ["ok", "ok"]
    assert read(_gz(raw.replace(b"body", b"b0dy")))[0]["status"] == "bad block digest"
    assert read(_gz(raw[:-6]))[0]["status"] == "short block"
    with pytest.raises(EOFError):
        read(good[:-12])


def _gz(data):
    c = zlib.compressobj(6, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


# --- 2 near duplicates ------------------------------------------------------------------------
def brute_components(rows, percent=80):
    sets = {i: {bytes(x) for x in _shingles(t)} for i, t in rows}
    low = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                both = len(sets[a] & sets[b])
                if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both) and low[a] > low[b]:
                    low[a], changed = low[b], True
    return {i: (len(sets[i]), low[i]) for i in sets}


def _shingles(text):
    w = (text or "").encode().lower().split()
    return [b" ".join(w[i:i + 5]) for i in range(len(w) - 4)] if len(w) >= 5 else [b" ".join(w)] * bool(w)


@pytest.mark.parametrize("percent", [80, 85])
def test_near_duplicates_equal_brute_force(spark, scratch_tables, percent):
    g = np.random.default_rng(3)
    base = [f"w{i}" for i in g.integers(0, 5000, 150)]
    rows = [(1000, " ".join(base)), (1, None), (2, ""), (3, " \t"), (4, "One two"), (5, "one TWO"), (6, "é É"), (7, "É é")]
    for k in range(60):
        w = list(base)
        for at in g.integers(0, 150, k % 5):
            w[at] = f"x{k}_{at}"
        rows.append((10 + k, " ".join(w)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.near_duplicates(
        docs(spark, rows), scratch_tables, percent=percent, block=8).collect()}
    assert got == brute_components(rows, percent)
    twice = near_dup.near_duplicates(docs(spark, [(1, "a b"), (1, "a b"), (None, "a b"), (2, "a b")]), Scratch(spark, "t"))
    assert sorted((r.doc_id or 0, r.component_id, r.kept) for r in twice.collect()) == [(0, None, False), (1, 1, True), (1, 1, True), (2, 1, False)]


def test_near_duplicates_of_long_texts_clashing_names_and_an_empty_table(spark):
    long = [f"w{i}" for i in range(5000)]
    rows = [(9, " ".join(long)), (4, " ".join(long[:4900])), (2, " ".join(long[2500:])), (7, "a b"), (7, "a b"), (None, "a b")]
    clash = docs(spark, rows).withColumn("kept", F.lit("x")).withColumn("n", F.lit("x"))
    got = near_dup.near_duplicates(clash, Scratch(spark, "long")).collect()
    assert sorted(((r.doc_id or 0, r.n_shingles, r.component_id, r.kept) for r in got), key=str) == sorted(
        [(9, 4996, 4, False), (4, 4896, 4, True), (2, 2496, 2, True), (7, 1, 7, True), (7, 1, 7, True), (0, 1, None, False)], key=str)
    assert near_dup.near_duplicates(clash.limit(0), Scratch(spark, "none")).count() == 0


def test_rows_that_repeat_are_one_node(spark):
    long = [f"w{i}" for i in range(60)]
    near = long[:58] + ["x", "y"]
    rows = [(3, " ".join(long))] * 400 + [(5, " ".join(long))] * 30 + [(2, " ".join(near))] * 300 + [(8, "other text")]
    table = docs(spark, rows).repartition(6)
    scratch = Scratch(spark, "repeats")
    got = near_dup.near_duplicates(table, scratch).groupBy("doc_id", "component_id", "kept").count().collect()
    assert sorted(tuple(r) for r in got) == [(2, 2, True, 300), (3, 2, False, 400), (5, 2, False, 30), (8, 8, True, 1)]
    assert spark.read.parquet(scratch.path("classes")).count() == 3
    one = spark.createDataFrame([(3, "a b c")] * 50 + [(3, "d e")] * 20 + [(4, "a b c")] * 9, "rep long, text string").coalesce(1)
    sets = one.mapInArrow(near_dup._full_sets, "rep long, n long, sig array<int>, shingles binary")
    assert sorted(r.rep for r in sets.select("rep").collect()) == [3, 3, 4]


# --- 3 packing -------------------------------------------------------------------------------
def test_packing_is_exact_and_full(spark):
    from tokenizers import Tokenizer

    rows = [(1, "Hello wörld, it's  fine.\n\n ok"), (2, None), (3, ""), (4, "ab cd " * 9000), (5, "日本語 " * 50), (5, "again")]
    out = packing.pack(docs(spark, rows).repartition(2), BPE).collect()
    tok = Tokenizer.from_file(BPE)
    whole = sorted([(i, *tok.encode(t or "", add_special_tokens=False).ids, 1) for i, t in rows])
    by = {}
    for r in out:
        assert r.length == len(r.ids) // 4
        by.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, np.frombuffer(r.ids, "<u4").tolist()))
    assert sorted((k[0], *sum((x for _, x in sorted(v)), [])) for k, v in by.items()) == whole
    seqs = {}
    for r in out:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in seqs.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end & (end - 1) == 0 and end <= 2048  # no padding at all
    assert packing.pack(docs(spark, []), BPE).count() == 0


@pytest.mark.parametrize("lengths", [
    [], [1], [2048], [2049] * 3, [1100] * 50, [683, 682] * 40, [1] * 5000, [2047] * 300, [100_000], [5, 2000] * 200,
    np.random.default_rng(1).integers(1, 2049, 3000).tolist(),
    (np.random.default_rng(2).pareto(1.2, 3000) * 150 + 1).astype(int).clip(1, 200_000).tolist()])
def test_bins_hold_every_id_once_without_padding(lengths):
    bins, out = packing.Bins(2048, 16, 7), []
    most = 0
    for i, n in enumerate(lengths):
        bins.add(i, np.arange(n, dtype=np.uint32) + i, out)
        most = max(most, bins.room)
    bins.close(out)
    assert most < (packing.OPEN_ROOM + 1) * 2048
    docs_, seqs = {}, {}
    for doc, start, ids, total, seq, offset in out:
        assert total == lengths[doc] and len(ids)
        docs_.setdefault(doc, []).append((start, ids))
        seqs.setdefault(seq, []).append((offset, len(ids)))
    for i, n in enumerate(lengths):
        whole = np.concatenate([x for _, x in sorted(docs_[i], key=lambda p: p[0])])
        assert whole.tolist() == list(range(i, n + i))
    sizes = []
    for parts in seqs.values():
        assert [o for o, _ in parts] == np.cumsum([0, *[n for _, n in parts]])[:-1].tolist()
        sizes.append(sum(n for _, n in parts))
    assert all(n == 2048 or n & (n - 1) == 0 for n in sizes) and sum(n < 2048 for n in sizes) <= 11
    assert sorted(seqs) == list(range(7, 7 + len(seqs)))
    assert len(out) <= len(lengths) + 2 * len(seqs) + 11


def test_bins_hold_a_fixed_count_of_whole_documents():
    bins, out = packing.Bins(2048, 16, 0), []
    lengths = np.random.default_rng(3).integers(130, 2049, 20_000)
    for i, n in enumerate(lengths):
        bins.add(i, np.zeros(n, dtype=np.uint32), out)
    bins.close(out)
    assert len(out) < len(lengths) + len({r[4] for r in out}) * 1.05
    first = {}
    for doc, _, ids, total, seq, _ in out:
        first.setdefault(seq, []).append((len(ids), total))
    fixed = 0
    for parts in first.values():
        n, total = parts[0]
        k = 2048 // total if total <= 2048 else 0
        fixed += n == total and len(parts) >= k and all(a == b and 2048 // b == k for a, b in parts[:k])
    assert fixed >= 0.95 * len(first)


def test_packing_finds_added_tokens():
    from tokenizers import Tokenizer

    tok, encoder, end = Tokenizer.from_file(BPE), packing.Encoder(BPE), "<|endoftext|>"
    assert encoder.ids(f"a {end} b").tolist() == [64, 220, 50256, 275]
    texts = [end, end * 3, f"{end}ab", f"ab{end}", f"ab  {end}  cd\n\n{end}\n", f"<|endof{end}text|>", "<|endoftext|", f"<{end}>",
             "ab cd " * 43690 + f"abc{end} ef" + " ab cd" * 50000, "x" * (packing.LONG_TEXT - 5) + end + " y" * 9]
    for text in texts:
        assert encoder.ids(text).tolist() == tok.encode(text, add_special_tokens=False).ids, text[:40]


@pytest.mark.parametrize("white", [" ", "\n", "\u3000", "\r\n\t "])
def test_packing_of_long_white_space(white):
    from tokenizers import Tokenizer

    tok, encoder = Tokenizer.from_file(BPE), packing.Encoder(BPE)
    run = white * (2_500_000 // len(white))
    near = white * (packing.LONG_RUN // len(white))
    for text in (f"a{run}b", run, f"{run}1{run}", f"ab  {run}<|endoftext|>{run}!", f"{'ab' * packing.LONG_TEXT}{near}c{near[1:]}d {near[:-1]}\n'e"):
        assert encoder.ids(text).tolist() == tok.encode(text, add_special_tokens=False).ids


# --- 4 language -----------------------------------------------------------------------------
def test_gradients_match_differences():
    g = np.random.default_rng(0)
    m = lang_id.new_model(["a", "b"], 3, 5, 1)
    for p in m.params():
        p[...] = g.standard_normal(p.shape).astype(np.float32) * 0.5
    x, y = g.integers(0, 256, (5, 4)), np.array([0, 1, 1, 0])
    _, grads = lang_id.gradients(m, x, y)
    for p, gr in zip(m.params(), grads):
        at = np.unravel_index(np.abs(gr).argmax(), p.shape)
        keep = p[at].copy()
        p[at] = keep + 1e-2
        up, _ = lang_id.gradients(m, x, y)
        p[at] = keep - 1e-2
        down, _ = lang_id.gradients(m, x, y)
        p[at] = keep
        assert abs((up - down) / 2e-2 - gr[at]) < 2e-3


def test_language_held_out_accuracy_and_edges(spark, sf_small):
    out = plans.QUERIES["op4_langid"](spark, sf_small).join(
        spark.read.parquet(f"{sf_small}/documents.parquet").select("doc_id", "lang"), "doc_id")
    held = out.where("held_out and lang is not null")
    assert held.where("lang = lang_pred").count() >= 0.9 * held.count()
    model = lang_id.new_model(["de", "en"], 4, 16, 1)
    odd = [None, "", "123 !! ½ ²", "a", "é" * 100]
    langs, score = lang_id.predict_texts(model, odd)
    assert langs[:3] == ["und"] * 3 and score[:3] == [0.0] * 3 and set(langs[3:]) <= {"de", "en"}
    assert lang_id.predict(docs(spark, [(1, "x")]), None).first().lang_pred == "und"


def test_training_sample_is_whole_with_repeats_and_empty_texts(spark):
    rows = [(i, f"aa {i}", "aa") for i in range(5)] * 2000
    rows += [(10_000 + i, (None, "")[i % 2] if i >= 20 else f"bb {i}", "bb") for i in range(4000)]
    rows += [(20_000 + i, f"cc {i}", "cc") for i in range(3000)] + [(0, "dd", None), (None, "dd", "dd")]
    labelled = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    x, y, langs = lang_id.training_windows(labelled, "doc_id", "text", "lang", 8, per_lang=10, per_doc=3)
    assert langs == ["aa", "bb", "cc"] and np.bincount(y).tolist() == [15, 30, 30]
    assert all(bytes(w).startswith(langs[k].encode()) for w, k in zip(x, y) if k < 2)


def test_every_position_counts_once():
    for n in (1, 15, 16, 17, 31, 32, 40):
        x, new, start = lang_id.cut(bytes(range(n)), 16)
        kept = [*x[:-1].ravel().tolist(), *x[-1][start:start + new].tolist()]
        assert kept == list(range(n))


# --- 5, 7, 8: edges (whole tables are held against SQL) ------------------------------------------
def test_decontamination_edges(spark, scratch_tables):
    items = spark.createDataFrame([(1, "Alpha beta"), (2, "a b c d e f g h i j k l"), (3, None), (4, "!!"), (5, "alpha BETA")],
                                  "item_id long, text string")
    rows = [(1, "x alpha, beta y"), (2, "a b c d e f g h i j k l"), (3, "b c d e f g h i j"), (4, None), (5, ""), (6, "alpha alpha beta")]
    clash = docs(spark, rows + rows[:1]).withColumn("n_hit", F.lit("clash"))
    got = [(r.doc_id, r.n_words, r.n_hit, ",".join(r["items"]), r.contaminated) for r in decontam.decontaminate(clash, items, scratch_tables).collect()]
    assert sorted(got) == [(1, 4, 2, "1,5", True), (1, 4, 2, "1,5", True), (2, 12, 12, "2", True), (3, 9, 0, "", False),
                           (4, 0, 0, "", False), (5, 0, 0, "", False), (6, 3, 2, "1,5", True)]
    assert decontam.decontaminate(clash, items.limit(0), Scratch(spark, "n")).where("contaminated").count() == 0


def test_decontamination_of_null_ids_long_texts_and_mixed_items(spark, scratch_tables):
    g = np.random.default_rng(5)
    item_texts = {"1": "q", "2": "r s", "3": " ".join(f"k{i}" for i in range(14)), "4": "r s t"}
    items = spark.createDataFrame([*item_texts.items(), (None, "u v"), ("3", item_texts["3"])], "item_id string, text string")
    vocabulary = np.array(["q", "r", "s", "t", "u", "v", *[f"k{i}" for i in range(14)], *[f"w{i}" for i in range(400)]])
    rows = [(i if i % 7 else None, " ".join(g.choice(vocabulary, int(g.integers(0, 40))))) for i in range(150)]
    long = " ".join(f"w{i % 400}" for i in range(200_000))
    rows += [(900, f"{long} {item_texts['3']} {long}"), (901, long), (902, " , ".join(f"K{i}" for i in range(2, 12)))] + rows[:5]
    got = decontam.decontaminate(docs(spark, rows), items, scratch_tables).collect()

    def brute(text):
        w = text.lower().replace(",", " ").split()
        hit, which = set(), set()
        for i, item in [*item_texts.items(), (None, "u v")]:
            it = item.split()
            n = min(10, len(it))
            wins = {tuple(it[k:k + n]) for k in range(max(1, len(it) - 9))}
            at = [k for k in range(len(w) - n + 1) if tuple(w[k:k + n]) in wins]
            hit |= {p for k in at for p in range(k, k + n)}
            which |= {i} if at and i else set()
        return len(w), len(hit), ",".join(sorted(which)), bool(hit)

    key = lambda r: (str(r[0]), *r[1:])
    want = sorted(((i, t, *brute(t)) for i, t in rows), key=key)
    assert sorted(((r.doc_id, r.text, r.n_words, r.n_hit, ",".join(r["items"]), r.contaminated) for r in got), key=key) == want


def test_line_dedup_edges(spark, scratch_tables):
    line = "This line is long enough to count"
    rows = [(1, f"{line}\nshort"), (2, f"  {line.upper()}\t\nshort\n"), (3, f"{line}\n{line}"), (4, None), (5, ""), (6, "x" * 19 + "\n")]
    got = {r.doc_id: (r.text, r.n_lines, r.n_dropped) for r in line_dedup.dedup_lines(
        docs(spark, rows).withColumn("n_lines", F.lit(9)), scratch_tables).collect()}
    assert got == {1: ("short", 2, 1), 2: ("short\n", 3, 1), 3: (f"{line}\n{line}", 2, 0), 4: ("", 1, 0), 5: ("", 1, 0),
                   6: ("x" * 19 + "\n", 2, 0)}
    pair = [(1, line), (1, line), (2, line), (None, line)]
    assert {r.n_dropped for r in line_dedup.dedup_lines(docs(spark, pair), Scratch(spark, "p")).collect()} == {0}


def test_url_rules_nest(spark, scratch_tables):
    rules = spark.createDataFrame([("a.net", "/", "block"), ("a.net", "/x/", "allow"), ("a.net", "/x/y", "block"), ("net", "/x/y/z", "allow"),
                                   ("B.net", "/", "block"), ("b.net", "/", "allow"), (None, "/", "block")], "host string, path string, verdict string")
    urls = {1: ("http://a.net/x/yy", "a.net/x/y", "block"), 2: ("https://W.A.net/x/?q", "a.net/x/", "allow"), 3: ("http://a.net", None, "allow"),
            4: ("http://aa.net/x/y/z1", "net/x/y/z", "allow"), 5: ("http://b.net/q#f", "b.net/", "block"), 6: (None, None, "allow"),
            7: ("nothing", None, "allow"), 8: ("http://a.net/x/y/z", "a.net/x/y", "block"), 9: ("http://a.net/w", "a.net/", "block")}
    pages = spark.createDataFrame([(k, v[0], "clash") for k, v in urls.items()], "page_id long, url string, rule string")
    got = {r.page_id: (r.rule, r.verdict) for r in url_rules.judge_urls(pages, rules, scratch_tables, rows_per_salt=1).collect()}
    assert got == {k: v[1:] for k, v in urls.items()}
    assert url_rules.judge_urls(pages.limit(0), rules, Scratch(spark, "u")).count() == 0
    assert {r.verdict for r in url_rules.judge_urls(pages, rules.limit(0), Scratch(spark, "r")).collect()} == {"allow"}


# --- 6 lattice ------------------------------------------------------------------------------
def test_lattice_sums_all_segmentations():
    lattice = lm_score.Lattice(lm_score.Pieces.load(PIECES, {300: 50, 1000: 10}, 100))

    def brute(t):
        if not t:
            return 1.0
        total = sum(math.exp(lattice.log[t[:k]]) * brute(t[k:]) for k in range(1, len(t) + 1) if t[:k] in lattice.log)
        return total + (0.0 if t[0] in lattice.log else math.exp(lattice._char(ord(t[0]))) * brute(t[1:]))

    words = ["the", "ciónrr", "日本", "È", "q\U0001F600"]
    assert np.allclose(lattice.many(words), [math.log(brute(lm_score.SPACE + w)) for w in words])
    long = ["ab" * 200]
    assert np.isfinite(lattice.many(long)).all()


def test_scores_equal_plain_counting(spark, scratch_tables):
    rows = [(i, f"The cat {i % 3} sat\ton the mat{'!' * (i % 2)}") for i in range(30)] + [(50, None), (51, ""), (52, "é unseen"), (None, "x")]
    df = docs(spark, rows)
    out = {r.doc_id: r for r in lm_score.score_texts(df, F.col("doc_id") >= 50, PIECES, scratch_tables, chunk_bytes=200).collect()}
    train = [t.encode().lower().split() + [None] for i, t in rows if i is None or i < 50]
    count = {}
    for w in sum(train, []):
        count[w] = count.get(w, 0) + 1
    n, v = sum(count.values()), len(count)
    for i, t in rows:
        words = (t or "").encode().lower().split() + [None]
        base = sum(math.log10((count.get(w, 0) + 0.5) / (n + 0.5 * (v + 1))) for w in words)
        r = out[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(words), sum(w in count for w in words), n)
        assert math.isclose(r.base_score, base, rel_tol=1e-9) and r.score < 0
    assert lm_score.score_texts(df.limit(0), F.lit(False), PIECES, Scratch(spark, "z")).count() == 0


# --- 9 pages ---------------------------------------------------------------------------------
def test_min_cut_equals_brute_force():
    g = np.random.default_rng(5)
    for _ in range(60):
        n = int(g.integers(1, 8))
        s = g.normal(0, 1, n).tolist()
        e = [(a, b, float(g.uniform(0, 1))) for a in range(n) for b in range(a) if g.random() < 0.5]

        def cost(labels):
            return sum(max(x, 0) if not k else max(-x, 0) for x, k in zip(s, labels)) + sum(w for a, b, w in e if labels[a] != labels[b])

        best = min(cost([m >> i & 1 for i in range(n)]) for m in range(1 << n))
        assert math.isclose(cost(html_extract.min_cut(s, e)), best, abs_tol=1e-9)


def test_page_text(spark):
    page = ('<html><head><title>T</title><script>var a="</p>";</script></head><body><header>Site</header><nav><a href=x>Home</a></nav>'
            '<div class="cookie-notice"><p>We use cookies on this site.</p></div><article><h1>Big &amp; bold</h1><p>One\n  two <b>three</b>.'
            '<p>Four<br>five.</p><div class="ad">Buy!</div></article><section id="comments"><p>Nice article, thank you very much.</p></section>'
            '<aside>More</aside><form><label>Mail</label></form><footer>&copy; x</footer>')
    rows = [(1, "u", page), (2, None, None), (3, "u", ""), (4, "u", "<"), (5, "u", "<p")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = {r.page_id: r.text for r in html_extract.extract(df).collect()}
    assert got[1] == "Big & bold\nOne two three.\nFour five." and got[2] == got[3] == got[5] == ""


def test_page_marks_are_whole_names_that_content_outvotes():
    long = "A sentence of a real story, with some words in it. " * 6
    p, want = f"<p>{long}</p>", " ".join(long.split())
    keeps = [f'<body class="has-sidebar hidden">{p}', f'<div class="content no-comments">{p}</div>', f'<div id="layout-with-sidebar">{p}</div>',
             f'<div class="no-header">{p}</div>', f'<article data-title="the hidden cost">{p}</article>', f"<main title=' aria-hidden=true '>{p}</main>",
             f'<p title="a class=ad b">{long}</p>', f'<article class="post popular">{p}</article>', f'<div class="content share">{p}</div>',
             *[f'<div class="{w}"><article>{p}</article><p>Short words.</p></div>' for w in ("sidebar", "side", "social", "share", "notice reply")],
             f'<div id="popular"><main class="related">{p}</main></div>']
    assert [html_extract.main_text(x) for x in keeps] == [want] * len(keeps)
    for mark in ('class="notice"', 'class="header"'):  # among content, the cut keeps a long paragraph with a name
        assert html_extract.main_text(f"<article>{p}<p {mark}>{long}</p>{p}</article>") == "\n".join([want] * 3)
        assert html_extract.main_text(f"<article>{p}<div {mark}>Buy it</div>{p}</article>") == "\n".join([want] * 2)
    drops = ["hidden", "hidden=x", "HIDDEN=''", "aria-hidden='true'", "class=ad", 'class="x  Sidebar y"', "id='post-comments'", 'role="navigation"',
             'class="cookie-notice"', 'class="widget-3"', 'class="site-footer"']
    assert [html_extract.main_text(f"<article>{p}</article><div {x}>{p}</div>") for x in drops] == [want] * len(drops)
    assert html_extract.main_text(f"<div hidden><article>{p}</article></div><article>{p}</article>") == want


# --- 10 vectors ------------------------------------------------------------------------------
def test_vectors_equal_brute_force(spark, scratch_tables):
    g = np.random.default_rng(1)
    centre = g.normal(size=(6, 8))
    x = np.concatenate([centre[g.integers(0, 6, 300)] + g.normal(size=(300, 8)) * 0.12, centre, centre])
    rows = [(i, v.tolist(), i % 2) for i, v in enumerate(x)]
    bad = [(900, None, 1), (901, [0.0] * 8, 1), (902, [float("nan")] + [1.0] * 7, 1), (903, [None] + [1.0] * 7, 1), (904, x[0].tolist(), None), (905, [], 0)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embed_dup.near_vectors(df, scratch_tables, block=16).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    link = (u @ u.T >= 0.98) & (np.arange(len(x))[:, None] % 2 == np.arange(len(x)) % 2)
    np.fill_diagonal(link, False)
    low = np.arange(len(x))
    while True:
        new = np.minimum(low, np.where(link, low[None], 10**6).min(axis=1))
        if (new == low).all():
            break
        low = new
    assert got == {**{i: (int(link[i].sum()), int(low[i])) for i in range(len(x))}, **{b[0]: (0, b[0]) for b in bad}}
    assert embed_dup.near_vectors(df.limit(0), Scratch(spark, "e")).count() == 0
