"""Every registered query against its SQL twin, on the smallest test tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as registered

SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables not present")


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return connection


def canonical(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def text(value):
        if value is None or (isinstance(value, float) and math.isnan(value)):
            return "NULL"
        return repr(float(value)) if isinstance(value, float) else str(value)

    return sorted(columns), sorted(tuple(text(row[i]) for i in order) for row in data)


@pytest.mark.parametrize("name", sorted(registered.library_queries()))
def test_query(spark, db, name):
    frame = registered.library_queries()[name](spark, SF_DIR)
    mine = canonical(frame.columns, [tuple(r) for r in frame.collect()])
    assert mine[1], "no rows"
    sql = registered.library_sql().get(name)
    if sql:
        cursor = db.execute(sql)
        theirs = canonical([d[0] for d in cursor.description], cursor.fetchall())
        assert mine == theirs


def test_entry(spark):
    assert registered.entry(spark).limit(1).count() == 1


def test_every_oracle_has_a_query():
    assert set(registered.oracle_sql()) <= set(registered.queries())
