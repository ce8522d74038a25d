"""Every registered query with SQL against DuckDB over the smallest tables: the same columns and rows."""

import math
import os
from decimal import Decimal

import duckdb
import pytest

import __spark_entry__

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SQL = __spark_entry__.oracle_sql()


def plain(value):
    if isinstance(value, (float, Decimal)):
        value = float(value)
        return "nan" if math.isnan(value) else round(value, 6) + 0.0
    return tuple(map(plain, value)) if isinstance(value, list) else value


@pytest.mark.skipif(not os.path.exists(DATA), reason="no test data")
@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, name):
    frame = __spark_entry__.queries()[name](spark, DATA)
    columns = sorted(frame.columns)
    got = [[plain(r[c]) for c in columns] for r in frame.collect()]
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    found = db.sql(SQL[name])
    assert sorted(found.columns) == columns
    places = [found.columns.index(c) for c in columns]
    assert sorted(map(str, got)) == sorted(str([plain(r[i]) for i in places]) for r in found.fetchall())
