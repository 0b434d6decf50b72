"""Every registered query against its DuckDB SQL on the driver's smallest useful tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from gleanwork.plans import registry

SF = "/root/testdata/sf0.01"
TABLES = "documents pages labels conversations orders events part supplier embeddings benchmark region nation".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(columns, data):
    at = [columns.index(c) for c in sorted(columns)]
    clean = lambda v: None if isinstance(v, float) and math.isnan(v) else v
    return sorted((tuple(clean(r[i]) for i in at) for r in data), key=repr)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    told = duck.sql(registry.SQL[name])
    assert sorted(df.columns) == sorted(told.columns)
    mine = rows(df.columns, df.collect())
    assert mine
    assert mine == rows(told.columns, told.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_registry_is_consistent():
    assert set(entry.oracle_sql()) <= set(entry.queries())
