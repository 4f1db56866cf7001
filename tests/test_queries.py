"""Every registered query against its SQL on the smallest given tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from check import TABLES, normal
from rowsmith.plans.registry import ORACLES, QUERIES

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def engine():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, engine, name):
    df = QUERIES[name](spark, FOLDER)
    got = normal([tuple(r) for r in df.collect()], df.columns)
    result = engine.execute(ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(df.columns)
    assert got == normal(result.fetchall(), names)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
