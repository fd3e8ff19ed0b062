"""CSV files read by ranges equal the one-task read."""

import os

import pytest
from pyspark.sql import functions as F

from starlens.sources import csv, csv_ranges


@pytest.fixture
def small_ranges(spark):
    """Ranges of a few hundred bytes."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}

    def use(size):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        spark.conf.set("spark.sql.files.openCostInBytes", "1")

    yield use
    for k, v in old.items():
        spark.conf.set(k, v)


def as_sorted(df):
    return sorted(map(str, df.collect()))


def both(spark, path, schema, **kw):
    return as_sorted(csv_ranges.read_csv_ranges(spark, path, schema, **kw)), as_sorted(csv.read_csv(spark, path, schema))


FIELDS = ['plain', '', 'a,b', 'say ""hi""', 'two\nlines', '\n\n', 'ends\n', '"",""\n""', 'é ß\nñ', 'x' * 900 + '\n' + 'y' * 900, '  padded ']


def write_file(folder, rows, end="\n", name="one.csv"):
    path = os.path.join(folder, name)
    with open(path, "w", newline="", encoding="utf-8") as f:
        f.write("k,v,w" + end)
        for k, v in rows:
            quoted = f'"{v}"' if any(c in v for c in ',"\n') else v
            f.write(f"{k},{quoted},{'z' if k % 3 else ''}{end}")
    return path


@pytest.mark.parametrize("size", [64, 257, 1000, 5000])
def test_one_file_in_many_tasks_equals_one_task(spark, scratch, small_ranges, size):
    path = write_file(scratch, [(i, FIELDS[i * 7 % len(FIELDS)]) for i in range(300)])
    schema = csv.string_schema(["k", "v", "w"])
    small_ranges(size)
    assert spark.read.option("lineSep", "\n").text(path).rdd.getNumPartitions() > 4
    got, want = both(spark, path, schema)
    assert len(want) == 300 and got == want


def test_a_record_over_many_ranges_and_many_files(spark, scratch, small_ranges):
    long = "\n".join(f'line ""{i}"", of a long field' for i in range(200))
    for n in range(3):
        write_file(scratch, [(n * 10 + 1, "a"), (n * 10 + 2, long), (n * 10 + 3, "two\nlines")], name=f"{n}.csv")
    small_ranges(300)
    got, want = both(spark, scratch, csv.string_schema(["k", "v", "w"]))
    assert len(want) == 9 and got == want


def test_ends_of_lines_empty_lines_and_no_header(spark, scratch, small_ranges):
    path = os.path.join(scratch, "crlf.csv")
    with open(path, "w", newline="") as f:
        f.write('1,a\r\n\r\n2,"b\r\nc"\r\n3,"d"')
    small_ranges(8)
    rows = csv_ranges.read_csv_ranges(spark, path, csv.string_schema(["k", "v"]), header=False).orderBy("k").collect()
    assert [(r.k, r.v) for r in rows] == [("1", "a"), ("2", "b\r\nc"), ("3", "d")]
    empty = os.path.join(scratch, "empty.csv")
    open(empty, "w").close()
    assert csv_ranges.read_csv_ranges(spark, empty, csv.string_schema(["k"])).count() == 0


def test_malformed_records_and_types(spark, scratch, small_ranges):
    path = os.path.join(scratch, "bad.csv")
    with open(path, "w") as f:
        f.write('k,v\n1,"a\nb"\n2\n3,c,d\nx,"e\nf"\n')
    small_ranges(6)
    schema = csv.string_schema(["k", "v"])
    rows = {r.k: r for r in csv_ranges.read_csv_ranges(spark, path, schema, corrupt=True).collect()}
    assert {k for k, r in rows.items() if r._corrupt_record is None} == {"1", "x"}
    assert rows["3"]._corrupt_record == "3,c,d" and rows["2"]._corrupt_record == "2" and rows["1"].v == "a\nb"


def test_no_text_is_shuffled_but_crossing_records(spark, scratch):
    path = write_file(scratch, [(1, "a")])
    plan = csv_ranges.csv_records(spark, path)._jdf.queryExecution().executedPlan().toString()
    whole = plan[plan.index("Union"):plan.rindex("HashAggregate")]
    assert "BroadcastHashJoin" in whole and "MapInArrow" in whole


def test_open_quote_at_the_end_keeps_its_record(spark, scratch, small_ranges):
    path = os.path.join(scratch, "open.csv")
    with open(path, "w") as f:
        f.write('k,v\n1,a\n2,"never closed\nmore\n')
    small_ranges(7)
    records = csv_ranges.csv_records(spark, path).where(~F.col("first")).collect()
    assert sorted(r.record for r in records) == ["1,a", '2,"never closed\nmore']
