"""Every registered query with an oracle equals its DuckDB SQL (sf0.001)."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from starlens.sources.tables import TABLES

ORACLES = entry.oracle_sql()


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{round(v, 6):.6f}"
    return "∅" if v is None else str(v)


def canon(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted("|".join(norm(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def con(sf_small):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_small}/{t}.parquet')")
    return c


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, sf_small, con, name):
    df = entry.queries()[name](spark, sf_small)
    rows = [tuple(r) for r in df.collect()]
    cur = con.execute(ORACLES[name])
    ocols = [c[0] for c in cur.description]
    orows = cur.fetchall()
    assert sorted(df.columns) == sorted(ocols)
    assert canon(df.columns, rows) == canon(ocols, orows)


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.columns == ["state", "StarBucket", "count", "percentage"]
    assert df.count() > 0
