"""Every registered query against its SQL on the smallest tables, as the driver compares them."""

import os

import pytest
from factloom.plans.catalogue import CATALOGUE

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{FOLDER}/{t}.parquet')")
    return c


def plain(x):
    return round(x, 9) if isinstance(x, float) else x


@pytest.mark.skipif(not os.path.exists(FOLDER), reason="no test tables")
@pytest.mark.parametrize("name", CATALOGUE)
def test_same_rows_as_sql(spark, duck, name):
    f, sql = CATALOGUE[name]
    df = f(spark, FOLDER)
    names = sorted(df.columns)
    got = sorted(str([plain(r[n]) for n in names]) for r in df.collect())
    if sql is None:
        assert got
        return
    found = duck.sql(sql)
    at = [found.columns.index(n) for n in names]
    assert sorted(found.columns) == names
    assert got == sorted(str([plain(r[i]) for i in at]) for r in found.fetchall())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.skipif(not os.path.exists(FOLDER), reason="no test tables")
@pytest.mark.parametrize("name, column, n", [("fuse_radii", "fusion_status", 5), ("route_intent", "intent", 6), ("norm_gases", "gases", 5)])
def test_every_branch_comes_up(spark, name, column, n):
    assert CATALOGUE[name][0](spark, FOLDER).select(column).distinct().count() == n
