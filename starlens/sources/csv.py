"""CSV ingest: header, multi-line quoted records, declared schema.

* Quotes are escaped by doubling (RFC 4180), the common export format;
  Spark's default backslash escape mis-splits such fields.
* Empty fields are null.
* ``read_csv_checked`` keeps malformed records apart instead of failing
  the job or silently dropping them: a record with too many or too few
  fields lands in the ``bad`` frame with its raw text.
* Spark reads a multi-line CSV file in one task; ``csv_ranges`` reads a big
  one in many.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from starlens.session import ensure_checkpoint_dir

CORRUPT_COL = "_corrupt_record"


def string_schema(columns) -> T.StructType:
    """All-string schema, the shape a header-only CSV read gives."""
    return T.StructType([T.StructField(c, T.StringType(), True) for c in columns])


def _reader(spark: SparkSession, schema: T.StructType | None, multiline: bool, header: bool):
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return (reader
            .option("header", "true" if header else "false")
            .option("multiLine", "true" if multiline else "false")
            .option("quote", '"')
            .option("escape", '"')
            .option("mode", "PERMISSIVE"))


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None, multiline: bool = True,
             header: bool = True) -> DataFrame:
    """Read CSV with a declared schema, or all strings named by the header line."""
    return _reader(spark, schema, multiline, header).csv(path)


def read_csv_or_empty(spark: SparkSession, path: str, schema: T.StructType, multiline: bool = True,
                      header: bool = True) -> DataFrame:
    """Read CSV; a path that is not there gives an empty table of the declared schema."""
    try:
        return read_csv(spark, path, schema, multiline, header)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return empty_table(spark, schema)


def read_csv_checked(spark: SparkSession, path: str, schema: T.StructType,
                     multiline: bool = True, header: bool = True) -> tuple[DataFrame, DataFrame]:
    """Return ``(good, bad)``: parsed rows and malformed raw records.

    With ``header`` the first line of every file names the columns; without
    it every line is a record, so good and bad add up to all lines. The
    parse is checkpointed once, as Spark wants for the corrupt-record
    column, and both halves come from it.
    """
    ensure_checkpoint_dir(spark)
    with_corrupt = T.StructType(list(schema.fields) + [T.StructField(CORRUPT_COL, T.StringType(), True)])
    parsed = (_reader(spark, with_corrupt, multiline, header)
              .option("columnNameOfCorruptRecord", CORRUPT_COL)
              .csv(path)
              .checkpoint())
    good = parsed.filter(F.col(CORRUPT_COL).isNull()).drop(CORRUPT_COL)
    bad = parsed.filter(F.col(CORRUPT_COL).isNotNull()).select(CORRUPT_COL)
    return good, bad


def empty_table(spark: SparkSession, schema: T.StructType) -> DataFrame:
    """Empty frame with a declared schema (fallback for a missing input)."""
    return spark.createDataFrame([], schema)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    (df.write.mode(mode)
     .option("header", "true")
     .option("quote", '"')
     .option("escape", '"')
     .option("quoteAll", "false")
     .option("ignoreLeadingWhiteSpace", "false")
     .option("ignoreTrailingWhiteSpace", "false")
     .csv(path))
