"""CSV ingest: quoting, multi-line records, empty fields, malformed rows."""

import os

from starlens.sources import csv


def write(path, content):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(content)


def test_quoted_fields_and_newlines(spark, scratch):
    p = os.path.join(scratch, "in", "r.csv")
    write(p, 'id,text,stars\n1,"say ""hi"", then ""bye"", x",5\n2,"line one\nline two",\n3,"",4\n')
    df = csv.read_csv(spark, p, csv.string_schema(["id", "text", "stars"]))
    rows = sorted(df.collect())
    assert [r.id for r in rows] == ["1", "2", "3"]
    assert rows[0].text == 'say "hi", then "bye", x'
    assert rows[1].text == "line one\nline two"
    assert rows[1].stars is None
    assert rows[2].text is None


def test_malformed_rows_kept_apart(spark, scratch):
    p = os.path.join(scratch, "bad", "r.csv")
    write(p, "a,b\n1,2\n3\n4,5,6\n7,8\n")
    good, bad = csv.read_csv_checked(spark, p, csv.string_schema(["a", "b"]), multiline=False, header=True)
    assert sorted((r.a, r.b) for r in good.collect()) == [("1", "2"), ("7", "8")]
    assert sorted(r[0] for r in bad.collect()) == ["3", "4,5,6"]


def test_roundtrip_documents(spark, sf_small, scratch):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet").select("doc_id", "text", "lang")
    out = os.path.join(scratch, "docs")
    csv.write_csv(docs, out)
    back = csv.read_csv(spark, out, csv.string_schema(["doc_id", "text", "lang"]))
    back = back.selectExpr("cast(doc_id as bigint) as doc_id", "text", "lang")
    assert back.exceptAll(docs).count() == 0 and docs.exceptAll(back).count() == 0


def test_empty_table_schema(spark):
    s = csv.string_schema(["a", "b"])
    e = csv.empty_table(spark, s)
    assert e.count() == 0 and e.schema == s


def test_missing_input_gives_empty_table(spark, scratch):
    s = csv.string_schema(["a", "b"])
    e = csv.read_csv_or_empty(spark, os.path.join(scratch, "nowhere"), s)
    assert e.count() == 0 and e.schema == s


def test_header_names_columns(spark, scratch):
    p = os.path.join(scratch, "h", "r.csv")
    write(p, "id,full name\n1,Ann\n")
    df = csv.read_csv(spark, p)
    assert df.dtypes == [("id", "string"), ("full name", "string")] and df.count() == 1


def test_good_and_bad_are_all_lines(spark, scratch):
    lines = spark.range(200).selectExpr("if(id % 7 = 0, 'only', concat(id, ',x')) as value")
    for files in (1, 8):
        out = os.path.join(scratch, f"lines{files}")
        lines.repartition(files).write.text(out)
        good, bad = csv.read_csv_checked(spark, out, csv.string_schema(["a", "b"]), multiline=False, header=False)
        assert (good.count(), bad.count()) == (171, 29)


def test_edge_spaces_survive(spark, scratch):
    df = spark.createDataFrame([("  lead",), ("trail  ",), (" a\tb ",)], "v string")
    out = os.path.join(scratch, "pad")
    csv.write_csv(df, out)
    assert sorted(csv.read_csv(spark, out).collect()) == sorted(df.collect())
