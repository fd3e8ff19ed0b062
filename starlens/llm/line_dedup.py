"""Operator 7: drop lines that many documents share.

Lines are exploded, normalised and hashed; documents are counted per hash;
lines over the threshold go everywhere but in one document; the rest is put
together again by position.

Hot lines: counting is partially aggregated, so a line held by a third of
all documents is one row a task; the join that marks its occurrences is a
plain equi-join, which adaptive execution splits. Shuffled: 16-byte hashes
for the counts, each document's lines once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starlens.llm.scratch import Scratch, ascii_lower, others, same_row, text_or_empty

WHITE = " \t\n\x0b\f\r"


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(WHITE)))


def dedup_lines(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text",
                min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """``docs`` with ``text_col`` reduced to its kept lines, plus ``n_lines`` and ``n_dropped``.

    A key of at least ``min_chars`` code points found in at least
    ``min_docs`` documents loses all its lines but those in the largest id
    that holds it. Null or empty text is one empty line. Rows that repeat
    an id count as one document; a null id counts as none, and its lines
    go wherever the key goes. A document that loses every line has empty
    text. Input columns named ``n_lines`` or ``n_dropped`` are replaced.
    An empty table gives an empty table.
    """
    keep = others(docs, "n_lines", "n_dropped")
    rest = [c for c in keep if c.lower() != text_col.lower()]
    base = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in rest]).alias("row"), F.col(id_col).alias("id"),
        F.xxhash64(text_or_empty(text_col)).alias("th"),
        F.split(text_or_empty(text_col), "\n", -1).alias("lines"),
    )
    key = line_key(F.col("line"))
    occurrences = (
        docs.select(F.col(id_col).alias("id"), F.xxhash64(text_or_empty(text_col)).alias("th"),
                    F.posexplode(F.split(text_or_empty(text_col), "\n", -1)).alias("pos", "line"))
        .where(F.char_length("line") >= min_chars)
        .select("id", "th", "pos", key.alias("key"))
        .where(F.char_length("key") >= min_chars)
        .select("id", "th", "pos", F.unhex(F.md5("key")).alias("hash"))
    )
    shared = (
        occurrences.where(F.col("id").isNotNull()).groupBy("hash", "id").agg(F.lit(1).alias("one"))
        .groupBy("hash").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("keep"))
        .where(F.col("n") >= min_docs).select("hash", "keep")
    )
    # a written table, not an aggregate: only then can the join split the partition of a hot line
    shared = scratch.save(shared, "shared-lines")
    drops = (
        occurrences.join(shared.hint("merge"), "hash").where(~F.col("id").eqNullSafe(F.col("keep")))
        .groupBy("id", "th").agg(F.collect_set("pos").alias("drop"))
    )
    joined = base.join(drops.hint("merge"), same_row(base, drops, "id", "th"), "left")
    kept = F.transform(
        F.array_except(F.sequence(F.lit(0), F.size(base["lines"]) - 1), F.col("drop")),
        lambda i: F.get(base["lines"], i),
    )
    text = F.array_join(F.when(F.col("drop").isNull(), base["lines"]).otherwise(kept), "\n")
    out = joined.select(
        "row", text.alias("text"), F.size(base["lines"]).cast("long").alias("n_lines"),
        F.coalesce(F.size("drop"), F.lit(0)).cast("long").alias("n_dropped"),
    )
    cols = [F.col("text").alias(c) if c.lower() == text_col.lower() else F.col(f"row.`{c}`") for c in keep]
    return out.select(*cols, "n_lines", "n_dropped")
