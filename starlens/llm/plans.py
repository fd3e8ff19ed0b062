"""The numbered operators' queries on the given tables, and their DuckDB SQL.

Each query applies its operator to a whole table and derives the digest
columns of its contract; the operators keep their own interfaces.
"""

from __future__ import annotations

import os
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starlens.llm import (centroids, decontam, embed_dup, html_extract, lang_id, line_dedup, lm_score, near_dup, packing,
                          quality, url_rules, warc, whiten)
from starlens.llm.scratch import Scratch

# The folder of the tokenizer files, where the package that holds them is installed unless it is named.
TOKENIZERS = os.environ.get("STARLENS_TOKENIZERS") or os.path.dirname(public_tokenizers.path("byte_bpe_50k.json"))

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

# The rules of the url query, as host, path, verdict.
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"),
             ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f
    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_DIGEST_32 = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((v[{g + 1}]) >> {s}) & 31)::INT + 1, 1)"
    for g in range(8) for s in (15, 10, 5, 0))


@query("op1_warc", f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h) AS n, sha1(h) AS x, min(page_id) OVER (PARTITION BY h) AS first_id FROM p),
v AS (SELECT *, [list_reduce([0] || [strpos('0123456789abcdef', c) - 1 FOR c IN string_split(substr(x, 5 * g + 1, 5), '')],
                             lambda a, b: a * 16 + b)::BIGINT FOR g IN range(8)] AS v FROM d)
SELECT page_id, n::BIGINT AS payload_bytes, {_DIGEST_32} AS payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM v""")
def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page through an archive and back."""
    records = warc.archive_round_trip(table(spark, sf_dir, "pages"), Scratch(spark, "op1"))
    return records.select(
        "page_id", "payload_bytes", "payload_digest",
        F.when(F.col("status") == "ok", F.col("record_type")).otherwise(F.col("status")).alias("record_type"), "refers_to")


@query("op2_minhash")
def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components over five-word shingles at 85 per cent."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_dup.near_duplicates(docs, Scratch(spark, "op2"), percent=85)


@query("op3_packing")
def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 2048 tokens."""
    pieces = packing.pack(table(spark, sf_dir, "documents"), f"{TOKENIZERS}/byte_bpe_50k.json")
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def _remainder(k: int):
    """crc32 of doc_id as text, modulo ``k``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % k


@query("op4_langid")
def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every text, learned from two thirds of the ids."""
    docs = table(spark, sf_dir, "documents")
    model = lang_id.train(docs.where(_remainder(3) != 1).select("doc_id", "text", "lang"))
    out = lang_id.predict(docs.select("doc_id", (_remainder(3) == 1).alias("held_out"), "text"), model, keep_text=False)
    return out.select("doc_id", "held_out", "lang_pred", "score")


@query("op6_lattice")
def op6_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """log10 probability of every text, learned from four fifths of the ids."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return lm_score.score_texts(docs, _remainder(5) == 1, f"{TOKENIZERS}/piece_bpe_32k.model", Scratch(spark, "op6"))


@query("op9_html")
def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_extract.extract(pages).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


@query("op5_decontam", f"""
WITH b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, array_to_string(w[s + 1 : s + 10], ' ') AS win, least(len(w), 10) AS n
       FROM b, unnest(range(greatest(len(w) - 9, 1))) AS t(s) WHERE len(w) > 0),
d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
dw AS (SELECT doc_id, s, n, array_to_string(w[s + 1 : s + n], ' ') AS win
       FROM d, (SELECT DISTINCT n FROM iw), unnest(range(len(w) - n + 1)) AS t(s)),
hits AS (SELECT doc_id, s, dw.n, item_id FROM dw JOIN iw ON dw.win = iw.win AND dw.n = iw.n),
cover AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM hits, unnest(range(s, s + n)) AS t(p) GROUP BY doc_id),
held AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS items
         FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cover USING (doc_id) LEFT JOIN held USING (doc_id)""")
def op5_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each document inside benchmark windows of ten words."""
    out = decontam.decontaminate(
        table(spark, sf_dir, "documents").select("doc_id", "text"),
        table(spark, sf_dir, "benchmark").select("item_id", "text"), Scratch(spark, "op5"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                      F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


@query("op7_line_dedup", """
WITH l AS (SELECT doc_id, i AS pos, string_split(coalesce(text, ''), chr(10))[i] AS line
           FROM documents, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS t(i)),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
s AS (SELECT key, max(doc_id) AS keep FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT k.*, s.key IS NOT NULL AND s.keep <> k.doc_id AS dropped FROM k LEFT JOIN s ON k.key = s.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (dropped))::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
FROM m GROUP BY doc_id""")
def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines held by three or more documents stay in the largest id only."""
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), Scratch(spark, "op7"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


@query("op8_url_rules", """
WITH u AS (SELECT page_id,
    CASE WHEN contains(url, '://') THEN translate(regexp_extract(url, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
    CASE WHEN contains(url, '://') THEN regexp_extract(url, '://[^/?#]*([^?#]*)', 1) ELSE '' END AS path FROM pages),
r(h, p, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
m AS (SELECT page_id, host, path, h || p AS rule, v,
             row_number() OVER (PARTITION BY page_id ORDER BY length(h || p) DESC) AS n
      FROM u LEFT JOIN r ON (u.host = h OR ends_with(u.host, '.' || h)) AND starts_with(u.path, p))
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM m WHERE n = 1""")
def op8_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every url under the four rules."""
    rules = spark.sql("SELECT * FROM VALUES "
                      + ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES) + " AS t(host, path, verdict)")
    return url_rules.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rules, Scratch(spark, "op8"))\
        .select("page_id", "host", "path", "rule", "verdict")


@query("op10_embed", """
WITH RECURSIVE e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
      AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b
      ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE list_cosine_similarity(a.v, b.v) >= 0.98),
r AS (SELECT a AS n, b AS m FROM l UNION SELECT r.n, l.b FROM r JOIN l ON r.m = l.a)
SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, least(vec_id, coalesce(low, vec_id)) AS component_id,
       vec_id = least(vec_id, coalesce(low, vec_id)) AS kept
FROM embeddings LEFT JOIN (SELECT a, count(*) AS n_links FROM l GROUP BY a) c ON c.a = vec_id
     LEFT JOIN (SELECT n, min(m) AS low FROM r GROUP BY n) k ON k.n = vec_id""")
def op10_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of one label linked at cosine 0.98."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    return embed_dup.near_vectors(vectors, Scratch(spark, "op10"))


@query("op11_whiten")
def op11_whiten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 16 whitened components of every vector; a deviation that no long holds is null."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    out = whiten.transform(vectors, whiten.fit(vectors, Scratch(spark, "op11")))
    return out.withColumn("deviation", F.col("deviation").try_cast("long"))


def _rounds_sql(rounds: int) -> str:
    """Chained assignments and updates; floors by the remainder, as ``//`` cuts towards zero."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""a{r} AS MATERIALIZED (SELECT vec_id, x, b.d AS distance, b.k AS cluster FROM (
  SELECT vec_id, any_value(x) AS x, min({{'d': list_sum(list_transform(range(1, 65), lambda i: (x[i] - c[i]) * (x[i] - c[i])))::BIGINT, 'k': k}}) AS b
  FROM v, c{r} GROUP BY vec_id))""")
        if r < rounds:
            steps.append(f"""c{r + 1} AS MATERIALIZED (SELECT k, coalesce(m, c) AS c FROM c{r} LEFT JOIN (
  SELECT cluster, list(((s - (s % n + n) % n) // n)::BIGINT ORDER BY i) AS m FROM (
    SELECT cluster, i, sum(x[i]) AS s, count(*) AS n FROM a{r}, range(1, 65) AS t(i) GROUP BY cluster, i) GROUP BY cluster)
  ON cluster = k)""")
    return ",\n".join(steps)


@query("op12_centroids", f"""
WITH v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda e: floor(256 * e::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY h) - 1)::INT AS k, x AS c
  FROM (SELECT x, sha256('2:' || vec_id) AS h FROM v ORDER BY h LIMIT 40)),
{_rounds_sql(5)}
SELECT vec_id, cluster, distance, (sum(distance) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia,
       (sum(distance) OVER ())::BIGINT AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a5 JOIN c5 ON k = cluster""")
def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five rounds of forty centroids over all vectors of 64 components."""
    out = centroids.cluster(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), Scratch(spark, "op12"))
    return out.select(
        "vec_id", "cluster", "distance", F.col("cluster_inertia").try_cast("long").alias("cluster_inertia"),
        F.col("inertia").try_cast("long").alias("inertia"),
        F.sha2(F.array_join(F.col("centroid").cast("array<string>"), ","), 256).alias("centroid_sha256"))


@query("op13_quality")
def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every text, learned from the labels of four fifths of the ids."""
    held_out = _remainder(5) == 0
    return quality.score_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"),
                                   ~held_out, Scratch(spark, "op13"), keep={"held_out": held_out})
