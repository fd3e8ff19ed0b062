"""From raw documents to packed training sequences, in five stages.

Each stage is one of the numbered operators with its decision put into
effect. A stage gets (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet in the shared folder and read again as the next one's
docs; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from starlens.llm import decontam, lang_id, line_dedup, near_dup, packing
from starlens.llm.plans import TOKENIZERS
from starlens.llm.scratch import Scratch


NEEDED = ("doc_id", "text", "lang")


def _held(docs: DataFrame) -> DataFrame:
    """What the operators read, all else in one struct: no name of theirs meets a further column's."""
    rest = [c for c in docs.columns if c not in NEEDED]
    return docs.select(*NEEDED, F.struct(F.lit(True).alias("row"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(rest)]).alias("held"))


def _columns(held: DataFrame, docs: DataFrame, **changed: Column) -> DataFrame:
    """The columns of ``docs`` again, but for those in ``changed``."""
    rest = [c for c in docs.columns if c not in NEEDED]
    at = {c: F.col(f"held.c{i}") for i, c in enumerate(rest)} | {c: x for c, x in changed.items() if c in docs.columns}
    return held.select(*[at.get(c, F.col(c)).alias(c) for c in docs.columns])


def language(spark: SparkSession, docs: DataFrame, sf_dir: str, wanted: Sequence[str] | None = None) -> DataFrame:
    """Documents that the network labels with a wanted language.

    None wants every language it learned. Then only text that is null or has
    no letter (``und``) goes, so the default is a test for a letter. Nothing
    can be learned from a corpus without labels (``und`` is none); there ``wanted`` has no effect.
    """
    model = lang_id.train(docs.where(F.col("lang") != lang_id.UND).select("doc_id", "text", "lang"))
    if model is None:
        return lang_id.with_letters(docs)
    known = lang_id.predict(_held(docs), model)
    return _columns(known.where(F.col("lang_pred").isin(list(model.langs if wanted is None else wanted))), docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that three or more documents hold stay in one of them; ``n_chars`` follows the text."""
    kept = line_dedup.dedup_lines(_held(docs), Scratch(spark, "lines"))
    return _columns(kept, docs, n_chars=F.char_length("text").cast("long"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest id of each group of near duplicates (similarity of 0.8 or more); rows without an id stay."""
    judged = near_dup.near_duplicates(docs.select("doc_id", "text"), Scratch(spark, "near"))
    gone = judged.where(~F.col("kept") & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("gone"))
    held = _held(docs)
    return _columns(held.join(gone.hint("merge"), F.col("doc_id") == F.col("gone"), "left_anti"), docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    judged = decontam.decontaminate(_held(docs), items, Scratch(spark, "bench"))
    return _columns(judged.where(~F.col("contaminated")), docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents that are left, in sequences of at most 2048 tokens."""
    pieces = packing.pack(docs.select("doc_id", "text"), f"{TOKENIZERS}/byte_bpe_50k.json")
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [("language_id", language), ("line_dedup", lines), ("near_dedup", near_duplicates),
          ("decontamination", benchmark), ("packing", pack)]

# No stage but line dedup and decontamination is expressible in SQL; tests/llm hold the whole against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; each is written and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return docs
