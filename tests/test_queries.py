"""Every registered query against its SQL on the smallest tables."""

import math
import os

import pytest

import __spark_entry__ as entry
from causeway.plans.registry import QUERIES

SF_DIR = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return connection


def plain(value):
    if isinstance(value, float) and math.isnan(value):
        return None
    return float(value) if isinstance(value, float) else value


def ordered(rows):
    return sorted(rows, key=lambda row: tuple((v is None, str(v)) for v in row))


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    frame = QUERIES[name](spark, SF_DIR)
    columns = sorted(frame.columns)
    got = [tuple(plain(v) for v in row) for row in frame.select(*columns).collect()]
    cursor = duck.execute(entry.oracle_sql()[name])
    named = [d[0] for d in cursor.description]
    assert sorted(named) == columns
    places = [named.index(c) for c in columns]
    want = [tuple(plain(row[i]) for i in places) for row in cursor.fetchall()]
    assert ordered(got) == ordered(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
