"""Every registered query of the library against its SQL on the smallest tables, as the driver compares them."""

import os

import duckdb
import pytest

from spanlight.plans import catalogue

FOLDER = os.environ.get("SPANLIGHT_TESTDATA", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def rows(names, found, order):
    at = [names.index(c) for c in order]
    return sorted(tuple(repr(float(r[i]) if isinstance(r[i], float) else r[i]) for i in at) for r in found)


def test_every_query_has_sql():
    assert catalogue.QUERIES.keys() == catalogue.ORACLES.keys()


@pytest.mark.parametrize("name", catalogue.QUERIES)
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, FOLDER)
    want = duck.sql(catalogue.ORACLES[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()], columns) == rows(want.columns, want.fetchall(), columns)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 25
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
