"""Every query with SQL against DuckDB at the smallest scale."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from quillmatch.plans import catalogue

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def values(rows):
    return sorted(repr([round(v, 9) if isinstance(v, float) else v for v in r]) for r in rows)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    found, expected = catalogue.QUERIES[name](spark, DATA), con.sql(catalogue.ORACLES[name])
    columns = sorted(found.columns)
    assert columns == sorted(expected.columns)
    assert values(found.select(columns).collect()) == values(expected.select(*columns).fetchall())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
