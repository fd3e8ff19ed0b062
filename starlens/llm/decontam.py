"""Operator 5: find benchmark passages in documents, a prefix-filtered set join.

An item's windows are sets of shingles with positions. A window occurs in a
document only if all its shingles do, so its rarest shingle is a necessary
prefix: only that one is joined. Candidates must keep the positional bound
(start >= 0) and the length bound (start + length <= words); those left are
verified shingle by shingle at their exact positions.

Built-in functions only. The documents are split into words once, for the
shingles that the benchmark holds and for the word counts; what is shuffled
is in proportion to benchmark shingles found and one count a document. The benchmark's shingles are
a written table, so Spark knows their real size and broadcasts them only
below its threshold; beyond it the same join is a shuffled one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from starlens.llm.scratch import Scratch, ascii_lower, others, same_row, text_or_empty

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"  # on text with A-Z lower-cased
WINDOW = 10
SHINGLE = 3


def words(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(text), F.lit(f"({WORD})"), F.lit(1))


def _windows(items: DataFrame, window: int) -> DataFrame:
    """``(wid, item_id, win)``: all windows of ``window`` words; a shorter item is one window."""
    n = F.size("words")
    start = F.explode(F.sequence(F.lit(0), F.greatest(n - window, F.lit(0))))
    return (items.where(n > 0).select("item_id", "words", start.alias("start"))
            .select("item_id", F.slice("words", F.col("start") + 1, F.lit(window)).alias("win"))
            .select(F.unhex(F.md5(F.array_join("win", " "))).alias("wid"), "item_id", "win"))


def _window_shingles(windows: DataFrame, shingle: int) -> DataFrame:
    """``(wid, len, size, off, tok)``: shingles of each distinct window; a window under ``shingle`` words is one."""
    w = windows.groupBy("wid").agg(F.first("win").alias("win")).withColumn("len", F.size("win"))
    w = w.withColumn("size", F.least(F.lit(shingle), F.col("len")))
    return (w.select("wid", "win", "len", "size", F.explode(F.sequence(F.lit(0), F.col("len") - F.col("size"))).alias("off"))
            .select("wid", "len", "size", "off",
                    F.array_join(F.slice("win", F.col("off") + 1, F.col("size")), " ").alias("tok")))


def _document_shingles(docs: DataFrame, id_col: str, text_col: str, sizes: list[int]) -> DataFrame:
    """``(id, th, n_words, pos, size, tok)`` for every position and size; ``tok`` is null where the words end before.

    A document with too few words for any has one row without position.
    """
    text = text_or_empty(text_col)
    one = (docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("th"),
                       F.explode(F.array(words(text))).alias("words"))  # the explode keeps the split from being repeated
           .withColumn("n_words", F.size("words")))
    count = F.greatest(F.col("n_words") - (min(sizes) - 1), F.lit(0))
    zipped = F.arrays_zip(*[F.slice("words", k + 1, count).alias(f"w{k}") for k in range(max(sizes))])
    at = one.select("id", "th", "n_words", F.posexplode_outer(zipped).alias("pos", "w"))

    def token(size: int) -> Column:
        return F.when(F.col(f"w.w{size - 1}").isNotNull(), F.concat_ws(" ", *[F.col(f"w.w{k}") for k in range(size)]))

    if len(sizes) == 1:
        return at.select("id", "th", "n_words", "pos", F.lit(sizes[0]).alias("size"), token(sizes[0]).alias("tok"))
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("size"), token(n).alias("tok")) for n in sizes]))
    return at.select("id", "th", "n_words", "pos", each.alias("t")).select("id", "th", "n_words", "pos", "t.size", "t.tok")


def contaminated_words(docs: DataFrame, bench: DataFrame, scratch: Scratch, id_col: str = "doc_id",
                       text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
                       window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """Words and hits of each document: ``id, th, n_words, n_hit, items`` (``th``: hash of its text).

    ``items`` are the item ids as sorted strings. Documents without a hit
    have null in both. Null or empty texts have no words; an item without
    words has no window; a null item id is not listed. Rows that repeat
    (id, text) share one row here. Empty tables give an empty table.
    """
    items = scratch.save(bench.select(F.col(item_col).cast("string").alias("item_id"),
                                      words(text_or_empty(item_text_col)).alias("words")), "items")
    windows = scratch.save(_windows(items, window), "windows")
    shingles = scratch.save(_window_shingles(windows, shingle), "shingles")
    tokens = scratch.save(shingles.select("size", "tok").distinct(), "tokens")
    sizes = sorted(r["size"] for r in tokens.select("size").distinct().collect()) or [shingle]  # at most `shingle` rows
    # a document's first position stays without a shingle too: it carries the count
    seen = (_document_shingles(docs, id_col, text_col, sizes)
            .join(tokens.withColumn("held", F.lit(True)), ["size", "tok"], "left")
            .where(F.col("held") | (F.coalesce("pos", F.lit(0)) == 0))
            .select("id", "th", "n_words", "pos", F.when(F.col("held"), F.col("tok")).alias("tok")))
    seen = scratch.save(seen.distinct(), "found")
    counts = seen.select("id", "th", F.col("n_words").cast("long").alias("n_words")).distinct()
    found = seen.where(F.col("tok").isNotNull())

    # order by rarity in the documents: the rarest shingle is the window's prefix
    rarity = found.groupBy("tok").agg(F.count(F.lit(1)).alias("n"))
    ranked = shingles.join(rarity, "tok", "left")
    prefix = (ranked.groupBy("wid").agg(
        F.min(F.struct("n", "off", "tok")).alias("p"), F.first("len").alias("len"), F.first("size").alias("size"),
        F.count("n").alias("present"), F.count(F.lit(1)).alias("all"))
        .where(F.col("present") == F.col("all"))
        .select("wid", "len", "size", F.col("p.off").alias("off"), F.col("p.tok").alias("tok")))
    candidates = (found.join(prefix, "tok")
                  .withColumn("start", F.col("pos") - F.col("off"))
                  .where((F.col("start") >= 0) & (F.col("start") + F.col("len") <= F.col("n_words")))
                  .select("id", "th", "start", "wid", "len", "size"))
    # exact containment: shingles that cover the window, each at its position
    cover = shingles.where((F.col("off") % F.col("size") == 0) | (F.col("off") == F.col("len") - F.col("size")))
    needed = cover.groupBy("wid").agg(F.count(F.lit(1)).alias("needed"))
    # a written table: broadcast by its real size, and if shuffled, a passage held by many documents can be split
    cover = scratch.save(cover.join(needed, "wid").select("wid", "off", "tok", "needed"), "cover")
    expected = (candidates.join(cover, "wid")
                .select("id", "th", "start", "wid", "len", "needed", "tok", (F.col("start") + F.col("off")).alias("pos")))
    there = found.select("id", "th", "pos", "tok")
    hits = (expected.join(there, same_row(expected, there, "id", "th", "pos", "tok"), "left_semi")
            .groupBy("id", "th", "start", "wid").agg(F.count(F.lit(1)).alias("seen"),
                                                     F.first("needed").alias("needed"), F.first("len").alias("len"))
            .where(F.col("seen") == F.col("needed")).select("id", "th", "start", "wid", "len"))
    hits = scratch.save(hits, "hits")

    # words covered: each span adds what lies beyond all earlier ends
    spans = hits.groupBy("id", "th", "start").agg(F.max(F.col("start") + F.col("len")).alias("end"))
    before = Window.partitionBy("id", "th").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn("from", F.greatest(F.col("start"), F.coalesce(F.max("end").over(before), F.lit(0))))
    covered = spans.groupBy("id", "th").agg(
        F.sum(F.greatest(F.col("end") - F.col("from"), F.lit(0))).cast("long").alias("n_hit"))
    member = windows.where(F.col("item_id").isNotNull()).select("wid", "item_id").distinct()
    held = (hits.select("id", "th", "wid").distinct().join(member, "wid").select("id", "th", "item_id").distinct()
            .groupBy("id", "th").agg(F.sort_array(F.collect_list("item_id")).alias("items")))
    hit = covered.join(held, same_row(covered, held, "id", "th"), "left").select(
        covered["id"], covered["th"], "n_hit", F.coalesce("items", F.array().cast("array<string>")).alias("items"))
    return counts.join(hit, same_row(counts, hit, "id", "th"), "left").select(
        counts["id"], counts["th"], "n_words", "n_hit", "items")


def decontaminate(docs: DataFrame, bench: DataFrame, scratch: Scratch, id_col: str = "doc_id",
                  text_col: str = "text", **kw) -> DataFrame:
    """``docs`` plus ``n_words``, ``n_hit``, ``items`` and ``contaminated``, one row each.

    A document without words, or without a window, has 0 hits and no
    items. Input columns with these four names are replaced.
    """
    keep = others(docs, "n_words", "n_hit", "items", "contaminated")
    hits = contaminated_words(docs, bench, scratch, id_col, text_col, **kw)
    text = text_or_empty(text_col)
    base = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"),
                       F.col(id_col).alias("id"), F.xxhash64(text).alias("th"))
    out = base.join(hits.hint("merge"), same_row(base, hits, "id", "th"), "left")
    return out.select(*[F.col(f"row.`{c}`") for c in keep], "n_words",
                      F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
                      F.coalesce("items", F.array().cast("array<string>")).alias("items"),
                      F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"))
