"""Every catalogue query against its SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

from tessera.catalogue import queries
from tessera.catalogue_sql import SQL

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for f in glob.glob(f"{DIR}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def test_same_keys():
    assert queries().keys() == SQL.keys()


@pytest.mark.parametrize("name", SQL)
def test_query(spark, db, name):
    found = queries()[name](spark, DIR)
    wanted = db.execute(SQL[name])
    order = sorted(found.columns)
    assert order == sorted(d[0] for d in wanted.description)
    at = [[d[0] for d in wanted.description].index(c) for c in order]
    assert sorted(repr(tuple(r)) for r in found.select(*order).collect()) == sorted(repr(tuple(r[i] for i in at)) for r in wanted.fetchall())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 10
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_whole_tables(spark, db):
    found = queries()
    all_of = lambda table: db.execute(f"select count(*) from {table}").fetchone()[0]
    assert found["nl_join_left"](spark, DIR).select("s_suppkey").distinct().count() == all_of("supplier")
    assert found["hash_join_right"](spark, DIR).count() == all_of("orders")


@pytest.mark.parametrize("name,falling", [("sort_asc_nulls_last", False), ("sort_desc_nulls_last", True)])
def test_full_sorts(spark, db, name, falling):
    prices = [r.price for r in queries()[name](spark, DIR).collect()]
    known = [p for p in prices if p is not None]
    assert len(prices) == db.execute("select count(*) from orders").fetchone()[0]
    assert prices[: len(known)] == sorted(known, reverse=falling) and None in prices
