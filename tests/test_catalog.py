"""Every registered query against its SQL on the smallest driver tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry_point
from aerocal import catalog

FOLDER = "/root/testdata/sf0.001"
TABLES = ("customer", "events", "lineitem", "nation", "orders", "part", "region", "supplier")

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no driver tables")


@pytest.fixture(scope="module")
def con():
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return db


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(repr(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, con, name):
    df = entry_point.queries()[name](spark, FOLDER)
    found = con.execute(entry_point.oracle_sql()[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(df.columns)
    want = rows(columns, found.fetchall())
    assert want and rows(df.columns, df.collect()) == want


def test_entry(spark):
    assert entry_point.entry(spark).count() == 30


def test_every_sql_has_a_query():
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())
