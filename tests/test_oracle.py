"""Every registered query against its SQL, on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from tests.compare import rows_of

QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    con = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", list(SQL))
def test_same_result(spark, sf, con, name):
    got = rows_of(QUERIES[name](spark, sf).toPandas())
    want = rows_of(con.execute(SQL[name]).df())
    assert got[0] == want[0]
    assert got[1] == want[1]


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in SQL])
def test_rows(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    out = entry.entry(spark)
    assert out.columns == ["split", "label", "n_rows", "mean_ll", "mean_length"]
    assert out.count() > 0
