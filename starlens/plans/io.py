"""CSV ingest queries: round trip and malformed-record split."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from starlens.plans.registry import register
from starlens.session import shared_path
from starlens.sources import csv, csv_ranges
from starlens.sources.tables import read_table

_DOC_COLS = ["doc_id", "text", "lang", "source", "n_chars"]


@register("csv_roundtrip", "SELECT doc_id, text, lang, source, n_chars FROM documents")
def csv_roundtrip(spark, d):
    """Documents (quotes, commas, newlines in text) -> CSV -> typed frame."""
    path = shared_path(spark, "csv", f"documents-{uuid.uuid4().hex}")
    csv.write_csv(read_table(spark, d, "documents", *_DOC_COLS), path)
    raw = csv.read_csv(spark, path, csv.string_schema(_DOC_COLS))
    return raw.select(F.col("doc_id").try_cast("bigint").alias("doc_id"), "text", "lang", "source",
                      F.col("n_chars").try_cast("bigint").alias("n_chars"))


@register("csv_padded", """
SELECT event_id, '  ' || event_type || ' ' AS padded FROM events
""")
def csv_padded(spark, d):
    """Values with white space at their ends survive the write and the header-derived read."""
    path = shared_path(spark, "csv", f"padded-{uuid.uuid4().hex}")
    events = read_table(spark, d, "events", "event_id", "event_type")
    csv.write_csv(events.select("event_id", F.concat(F.lit("  "), "event_type", F.lit(" ")).alias("padded")), path)
    return csv.read_csv(spark, path).select(F.col("event_id").try_cast("bigint").alias("event_id"), "padded")


@register("csv_bad_rows", """
SELECT CASE WHEN event_id % 10 IN (3, 7) THEN 'bad' ELSE 'good' END AS kind, count(*) AS n FROM events GROUP BY 1
""")
def csv_bad_rows(spark, d):
    """Two-field lines made of a table's columns, two of ten with a field too many or too few: none is lost."""
    path = shared_path(spark, "csv", f"lines-{uuid.uuid4().hex}")
    k = F.col("event_id") % 10
    line = (F.when(k == 3, F.col("event_type")).when(k == 7, F.concat_ws(",", "event_id", "event_type", "user_id"))
            .otherwise(F.concat_ws(",", "event_id", "event_type")))
    read_table(spark, d, "events", "event_id", "event_type", "user_id").select(line).write.mode("overwrite").text(path)
    good, bad = csv.read_csv_checked(spark, path, csv.string_schema(["a", "b"]), multiline=False, header=False)
    return (good.agg(F.count(F.lit(1)).alias("n")).withColumn("kind", F.lit("good"))
            .unionByName(bad.agg(F.count(F.lit(1)).alias("n")).withColumn("kind", F.lit("bad"))))


@register("csv_by_ranges", "SELECT doc_id, text, lang, source, n_chars FROM documents")
def csv_by_ranges(spark, d):
    """The same trip, the files read by ranges: line breaks in texts end no record."""
    path = shared_path(spark, "csv", f"ranges-{uuid.uuid4().hex}")
    csv.write_csv(read_table(spark, d, "documents", *_DOC_COLS), path)
    raw = csv_ranges.read_csv_ranges(spark, path, csv.string_schema(_DOC_COLS))
    return raw.select(F.col("doc_id").try_cast("bigint").alias("doc_id"), "text", "lang", "source",
                      F.col("n_chars").try_cast("bigint").alias("n_chars"))
