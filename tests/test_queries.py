"""Every registered query with SQL agrees with DuckDB on the smallest tables, sorted by all columns."""

import math
import os

import duckdb
import pytest

import __spark_entry__
from marginalia.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(SF):
        pytest.skip("no tables here")
    c = duckdb.connect()
    c.sql("SET timezone = 'UTC'")
    for name in os.listdir(SF):
        c.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SF}/{name}')")
    return c


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, bool) or isinstance(v, str):
        return v
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return round(float(v), 6)


def table(rows, columns):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_agrees_with_sql(spark, duck, name):
    got = registry.QUERIES[name](spark, SF)
    want = duck.sql(registry.SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert table([tuple(r) for r in got.collect()], got.columns) == table(want.fetchall(), want.columns)


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["query_id", "chunk_id", "score", "rank"] and df.count() > 0


def test_names():
    every = __spark_entry__.queries()
    assert set(__spark_entry__.oracle_sql()) <= set(every) and set(registry.QUERIES) <= set(every)
