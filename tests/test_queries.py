"""Every registered query against its SQL counterpart in DuckDB."""

import math
import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry_point

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"create view {name} as select * from '{os.path.join(data, name)}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else repr(value)
    return value if value is None else str(value)


@pytest.mark.parametrize("name", sorted(entry_point.oracle_sql()))
def test_query_matches_sql(spark, data, duck, name):
    result = entry_point.queries()[name](spark, data)
    columns = sorted(result.columns)
    expected = duck.sql(entry_point.oracle_sql()[name])
    assert sorted(expected.columns) == columns
    order = [expected.columns.index(c) for c in columns]
    want = Counter(tuple(plain(row[i]) for i in order) for row in expected.fetchall())
    got = Counter(tuple(plain(v) for v in row) for row in result.select(*columns).collect())
    assert got == want


def test_every_oracle_has_a_query():
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())


def test_entry(spark):
    row = entry_point.entry(spark).collect()
    assert len(row) == 1 and row[0].total_invoices == 1500
