"""Cleaning and text-feature queries over whole documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from starlens.functions import clean, text
from starlens.operators import heavy, profile, terms
from starlens.plans import entities as E
from starlens.plans.registry import register
from starlens.session import written
from starlens.sources.tables import read_table

R6 = 6

# --- SQL fragments (DuckDB) -------------------------------------------------------
def sql_tokens(t: str) -> str:
    trimmed = f"regexp_replace(lower({t}), '\\s+$', '')"
    return (f"(CASE WHEN {t} <> '' AND {trimmed} = '' THEN []::VARCHAR[] "
            f"ELSE string_split_regex({trimmed}, '\\s') END)")


def sql_strip_punct(t: str) -> str:
    return f"regexp_replace({t}, '[^\\p{{L}}\\p{{N}}_\\s]', '', 'g')"


SQL_STOP_LIST = ", ".join("'" + w.replace("'", "''") + "'" for w in text.STOP_WORDS_EN)


def sql_no_stop(toks: str) -> str:
    return f"list_filter({toks}, lambda x: x NOT IN ({SQL_STOP_LIST}))"


SQL_TRIGRAMS = f"""(SELECT doc_id, g FROM (
  SELECT doc_id, w || ' ' || lead(w) OVER p || ' ' || lead(w, 2) OVER p AS g
    FROM (SELECT doc_id, unnest(t) AS w, generate_subscripts(t, 1) AS i
            FROM (SELECT doc_id, {sql_tokens(sql_strip_punct('text'))} AS t FROM documents))
  WINDOW p AS (PARTITION BY doc_id ORDER BY i)) WHERE g IS NOT NULL)"""


def clean_tokens(t):
    """Punctuation stripped, tokenized, stop words removed."""
    return text.remove_stop_words(text.tokenize(clean.strip_punct(t)))


SQL_CLEAN_TOKENS = sql_no_stop(sql_tokens(sql_strip_punct("text")))


# --- F1-F4: scrubs and casts -----------------------------------------------------
@register("scrub_decimal", "SELECT event_id, TRY_CAST(regexp_replace(props, '[^0-9.]+', '', 'g') AS DOUBLE) AS k FROM events")
def scrub_decimal(spark, d):
    ev = read_table(spark, d, "events", "event_id", "props")
    return ev.select("event_id", clean.decimal_value("props").alias("k"))


@register("scrub_integer", "SELECT event_id, TRY_CAST(regexp_replace(props, '[^0-9]', '', 'g') AS BIGINT) AS k FROM events")
def scrub_integer(spark, d):
    ev = read_table(spark, d, "events", "event_id", "props")
    return ev.select("event_id", clean.integer_value("props").alias("k"))


@register("scrub_letters", "SELECT doc_id, regexp_replace(text, '[^a-zA-Z\\s]', '', 'g') AS letters FROM documents")
def scrub_letters(spark, d):
    docs = read_table(spark, d, "documents", "doc_id", "text")
    return docs.select("doc_id", clean.letters_only("text").alias("letters"))


@register("try_cast_counts", """
SELECT count(*) AS n_rows, count(url) AS n_present,
       count(TRY_CAST(regexp_replace(url, '[^0-9.]+', '', 'g') AS DOUBLE)) AS n_parsed FROM pages
""")
def try_cast_counts(spark, d):
    pages = read_table(spark, d, "pages", "url")
    return profile.parse_counts(pages, "url", clean.decimal_value("url"))


# --- P11-P13: null handling ------------------------------------------------------
SQL_HOLES = f"""(SELECT c_custkey, nullif(c_mktsegment, '{E.NON_ELITE}') AS segment,
        nullif(c_nationkey, 0) AS nation FROM customer)"""


def holes(spark, d):
    c = read_table(spark, d, "customer", "c_custkey", "c_mktsegment", "c_nationkey")
    return c.select("c_custkey",
                    F.nullif(F.col("c_mktsegment"), F.lit(E.NON_ELITE)).alias("segment"),
                    F.nullif(F.col("c_nationkey"), F.lit(0)).alias("nation"))


@register("dropna_any", f"SELECT * FROM {SQL_HOLES} WHERE segment IS NOT NULL AND nation IS NOT NULL")
def dropna_any(spark, d):
    return profile.drop_nulls(holes(spark, d), "any")


@register("dropna_subset", f"SELECT * FROM {SQL_HOLES} WHERE segment IS NOT NULL")
def dropna_subset(spark, d):
    return profile.drop_nulls(holes(spark, d), "any", ["segment"])


@register("dropna_all", f"SELECT * FROM {SQL_HOLES} WHERE segment IS NOT NULL OR nation IS NOT NULL")
def dropna_all(spark, d):
    return profile.drop_nulls(holes(spark, d), "all", ["segment", "nation"])


# --- U1, T1, T2, F6: punctuation, tokens, stop words -------------------------------
@register("strip_punct", f"SELECT doc_id, {sql_strip_punct('text')} AS text FROM documents")
def strip_punct(spark, d):
    return E.texts(spark, d).select("doc_id", clean.strip_punct("text").alias("text"))


@register("tokenize", f"""
SELECT doc_id, CAST(len(t) AS INTEGER) AS n_tokens, array_to_string(t, '|') AS tokens
  FROM (SELECT doc_id, {sql_tokens('text')} AS t FROM documents)
""")
def tokenize(spark, d):
    toks = E.texts(spark, d).select("doc_id", text.tokenize("text").alias("t"))
    return toks.select("doc_id", F.size("t").alias("n_tokens"), F.array_join("t", "|").alias("tokens"))


@register("stopwords", f"""
SELECT doc_id, CAST(len(k) AS INTEGER) AS n_kept, array_to_string(k, '|') AS kept
  FROM (SELECT doc_id, {sql_no_stop(sql_tokens('text'))} AS k FROM documents)
""")
def stopwords(spark, d):
    kept = E.texts(spark, d).select("doc_id", text.remove_stop_words(text.tokenize("text")).alias("k"))
    return kept.select("doc_id", F.size("k").alias("n_kept"), F.array_join("k", "|").alias("kept"))


@register("token_count", f"""
SELECT lang, count(*) AS n_docs, CAST(sum(len(t)) AS BIGINT) AS n_tokens, round(avg(len(t)), {R6}) AS avg_tokens
  FROM (SELECT lang, {sql_tokens('text')} AS t FROM documents) GROUP BY lang
""")
def token_count(spark, d):
    n = E.texts(spark, d).select("lang", text.token_count(text.tokenize("text")).alias("n"))
    return n.groupBy("lang").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n").alias("n_tokens"),
                                 F.round(F.avg("n"), R6).alias("avg_tokens"))


# --- T3, T5: trigrams and vocabulary -------------------------------------------------
def trigrams(spark, d, by_id: bool = False):
    docs = E.texts_by_id(spark, d) if by_id else E.texts(spark, d)
    toks = docs.select("doc_id", text.tokenize(clean.strip_punct("text")).alias("t"))
    return text.with_ngrams(toks, "t", "g", 3).select("doc_id", "g")


@register("trigram_counts", f"""
SELECT doc_id, CAST(count(g) AS INTEGER) AS n_trigrams, CAST(count(DISTINCT g) AS INTEGER) AS n_distinct
  FROM documents LEFT JOIN {SQL_TRIGRAMS} USING (doc_id) GROUP BY doc_id
""")
def trigram_counts(spark, d):
    g = trigrams(spark, d)
    return g.select("doc_id", F.size("g").alias("n_trigrams"), F.size(F.array_distinct("g")).alias("n_distinct"))


VOCAB_TOP = 1000


SQL_VOCABULARY = f"""
WITH g AS (SELECT doc_id, g AS term FROM {SQL_TRIGRAMS}),
     s AS (SELECT term, count(*) AS count, count(DISTINCT doc_id) AS df FROM g GROUP BY term)
SELECT term, count, df, CAST(row_number() OVER (ORDER BY count DESC, term) - 1 AS INTEGER) AS vocab_index
  FROM s ORDER BY count DESC, term LIMIT {VOCAB_TOP}
"""


@register("vocabulary_top", SQL_VOCABULARY)
def vocabulary_top(spark, d):
    # trigrams that a sketch rules out are left out before they are counted
    sketch, least = heavy.sure_threshold(trigrams(spark, d), "g", VOCAB_TOP)
    return terms.vocabulary(trigrams(spark, d, by_id=True), "doc_id", "g", vocab_size=VOCAB_TOP,
                            keep=lambda pairs: heavy.heavy_pairs(pairs, sketch, least))


@register("vocabulary_sketch", SQL_VOCABULARY)
def vocabulary_sketch(spark, d):
    """The same rows from a sketch and exact counts of the terms it cannot rule out."""
    return heavy.heavy_vocabulary(trigrams(spark, d), "doc_id", "g", VOCAB_TOP)


# --- T6: IDF and TF-IDF ------------------------------------------------------------------
SQL_TF = f"""(SELECT doc_id, term, count(*) AS tf
   FROM (SELECT doc_id, unnest({SQL_CLEAN_TOKENS}) AS term FROM documents) GROUP BY doc_id, term)"""
SQL_IDF = f"""(SELECT term, count(*) AS df, ln(((SELECT count(*) FROM documents) + 1.0) / (count(*) + 1.0)) AS idf
   FROM {SQL_TF} GROUP BY term)"""


def _tf_idf(spark, d, once: bool = False):
    docs = E.texts_by_id(spark, d) if once else E.texts(spark, d)
    toks = docs.select("doc_id", text.tokenize(clean.strip_punct("text")).alias("t"))
    tf = terms.term_frequencies(toks, "doc_id", "t", exclude=text.STOP_WORDS_EN)
    if once:
        tf = written(tf, "tf")
    n_docs = read_table(spark, d, "documents", "doc_id").agg(F.count(F.lit(1))).scalar()
    idf = terms.idf_table(tf, n_docs)
    # idf (one row per term) feeds the small side, the hot-key list and its total
    return tf, (written(idf, "idf") if once else idf)


@register("idf_terms", f"SELECT term, df, round(idf, {R6}) AS idf FROM {SQL_IDF}")
def idf_terms(spark, d):
    _, idf = _tf_idf(spark, d)
    return idf.select("term", "df", F.round("idf", R6).alias("idf"))


@register("tfidf_top_per_doc", f"""
SELECT doc_id, term, tf, round(tfidf, {R6}) AS tfidf, CAST(rank AS INTEGER) AS rank FROM (
  SELECT t.doc_id, t.term, t.tf, t.tf * i.idf AS tfidf,
         row_number() OVER (PARTITION BY t.doc_id ORDER BY t.tf * i.idf DESC, t.term) AS rank
    FROM {SQL_TF} t JOIN {SQL_IDF} i ON t.term = i.term)
 WHERE rank <= 5
""")
def tfidf_top_per_doc(spark, d):
    # tf and idf feed several branches (big side, small side, hot-key list,
    # totals): written once in the shared folder instead of tokenizing per branch.
    tf, idf = _tf_idf(spark, d, once=True)
    weights = terms.tfidf(tf, idf, "doc_id")
    top = terms.top_terms_per_doc(weights, "doc_id", "tfidf", 5)
    return top.select("doc_id", "term", "tf", F.round("tfidf", R6).alias("tfidf"), "rank")
