"""One big CSV file with line breaks inside quotes, read by many tasks.

Spark cuts a CSV file into ranges only when every record is one line; with
line breaks in quoted fields a file is one task.  Here a file is read as
lines, which Spark does cut into ranges, and records are found again from
the quotes: after an even number of quotes a line break ends a record, after
an odd number it belongs to a field (a doubled quote changes nothing).

1. Every range's quotes are counted (a scan and an aggregate, one row a range).
2. A running sum over a file's ranges gives the parity at each range's begin.
3. A second scan joins each range to its parity (one small row a range, sent
   to all tasks) and puts its lines together to records, in order, without a
   shuffle.  Only the pieces of records that cross a range, at most two a
   range, are shuffled and joined; a file's pieces are numbered in one task,
   which is one record's text for each ``maxPartitionBytes`` of the file.
4. ``from_csv`` parses the records.

Files must follow RFC 4180: quotes stand around whole fields and are doubled
inside them.  Records may end in ``\\n`` or ``\\r\\n``; empty lines between
records are no records.  A file whose last quote stays open ends with the
record that it opens.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from starlens.sources.csv import CORRUPT_COL

WHOLE, HEAD, TAIL, MIDDLE = 0, 1, 2, 3  # a record; the end, the begin, the middle of one that crosses ranges
PIECES = "file long, block long, first boolean, kind int, record string"
HELD_CHARS = 1 << 22  # of records given on at once


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with the range they come from: a file's hash and the range's first byte."""
    text = spark.read.option("lineSep", "\n").text(path)
    return text.select(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")


def range_parities(lines: DataFrame) -> DataFrame:
    """``(file, block, open)``: whether the range begins inside quotes."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    per = lines.groupBy("file", "block").agg(F.sum(quotes).alias("quotes"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return per.select("file", "block", (F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2 == 1).alias("open"))


def _find_records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines ``(file, block, open, value)`` of whole ranges, in order, to records and pieces of records."""
    out: list[tuple] = []
    at, inside, first, held, head, size = None, False, True, [], False, 0

    def give() -> pa.RecordBatch:
        columns = list(zip(*out))
        arrays = [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.bool_()),
                  pa.array(columns[3], pa.int32()), pa.array(columns[4], pa.string())]
        out.clear()
        return pa.RecordBatch.from_arrays(arrays, names=["file", "block", "first", "kind", "record"])

    def end_of_range() -> None:
        if at is not None and held:
            out.append((*at, False if head else first, MIDDLE if head else TAIL, "\n".join(held)))

    for batch in batches:
        values = batch.column(3).to_pylist()
        odd = np.asarray(pc.count_substring(batch.column(3), '"')) % 2 == 1
        files, blocks, opens = (batch.column(i).to_pylist() for i in range(3))
        for i, value in enumerate(values):
            here = (files[i], blocks[i])
            if here != at:
                end_of_range()
                at, inside, held, first = here, opens[i], [], blocks[i] == 0
                head = inside
            held.append(value)
            inside ^= bool(odd[i])
            if not inside:
                record = held[0] if len(held) == 1 else "\n".join(held)
                out.append((*at, first and not head, HEAD if head else WHOLE, record))
                size += len(record)
                held, head, first = [], False, False
                if size > HELD_CHARS:
                    yield give()
                    size = 0
    end_of_range()
    if out:
        yield give()


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """``(record, first)``: the text of every record, and whether it is the first of its file."""
    lines = _lines(spark, path)
    # one row a range: 24 bytes for each spark.sql.files.maxPartitionBytes of input
    known = lines.join(F.broadcast(range_parities(lines)), ["file", "block"], "left")
    start = F.when(F.col("open").isNull(), F.raise_error(F.lit("the ranges of the file changed between two scans")).cast("boolean"))
    pieces = known.select("file", "block", start.otherwise(F.col("open")).alias("open"), "value").mapInArrow(_find_records, PIECES)
    whole = pieces.where(F.col("kind") == WHOLE).select("record", "first")
    # pieces of records that cross ranges: a tail, any number of middles, a head
    split = pieces.where(F.col("kind") != WHOLE)
    order = Window.partitionBy("file").orderBy("block", F.when(F.col("kind") == TAIL, 1).otherwise(0))
    group = split.withColumn("n", F.count_if(F.col("kind") == TAIL).over(order))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("block", F.col("kind") == TAIL, "record"))), lambda p: p["record"])
    joined = group.groupBy("file", "n").agg(F.array_join(parts, "\n").alias("record"), F.bool_or("first").alias("first"))
    return whole.unionByName(joined.select("record", "first"))


def read_csv_ranges(spark: SparkSession, path: str, schema: T.StructType, header: bool = True,
                    corrupt: bool = False) -> DataFrame:
    """Read CSV files of any size by ranges, with line breaks in quoted fields.

    With ``header`` the first record of every file names its columns and is
    left out.  ``corrupt`` adds the raw text of malformed records as
    ``_corrupt_record``.  A record keeps its own line breaks; the ``\\r`` of
    one that ends a record is none of its last field's.
    """
    records = csv_records(spark, path)
    if header:
        records = records.where(~F.col("first"))
    text = F.regexp_replace("record", "\r$", "")
    full = T.StructType([*schema.fields, T.StructField(CORRUPT_COL, T.StringType(), True)]) if corrupt else schema
    options = {"quote": '"', "escape": '"', "mode": "PERMISSIVE"}
    if corrupt:
        options["columnNameOfCorruptRecord"] = CORRUPT_COL
    row = F.from_csv(text, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in full), options)
    return records.where(F.length(text) > 0).select(row.alias("row")).select("row.*")
