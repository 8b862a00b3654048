"""Every query of the package on the smallest tables, against SQL where SQL can say it."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as registered
from shelfmate.llm import registry

SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for name in ("documents", "pages", "labels", "conversations"):
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return connection


def canonical(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    text = lambda v: "NULL" if v is None or isinstance(v, float) and math.isnan(v) else str(v)
    return sorted(columns), sorted(tuple(text(row[i]) for i in order) for row in data)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, db, name):
    frame = registered.queries()[name](spark, SF_DIR)
    mine = canonical(frame.columns, [tuple(r) for r in frame.collect()])
    table = "pages" if name.startswith(("op4", "op5", "op9")) else "documents"
    rows = "count(DISTINCT conv_id) FROM conversations" if name.startswith("op13") else f"count(*) FROM {table}"
    if not name.startswith("op11"):  # a row per word
        assert len(mine[1]) == db.execute(f"SELECT {rows}").fetchone()[0]
    sql = registered.oracle_sql().get(name)
    if sql:
        cursor = db.execute(sql)
        assert mine == canonical([d[0] for d in cursor.description], cursor.fetchall())
