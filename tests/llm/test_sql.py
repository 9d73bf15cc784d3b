"""Corpus queries against their SQL on the smallest tables."""

import os

import duckdb
import pytest

from tidemark.llm.queries import ORACLES, QUERIES

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, name):
    duck = duckdb.connect()
    for f in os.listdir(FOLDER):
        duck.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{FOLDER}/{f}'")
    df = QUERIES[name](spark, FOLDER)
    names = ", ".join(sorted(df.columns))
    got = sorted(map(repr, map(tuple, df.select(*sorted(df.columns)).collect())))
    assert got and got == sorted(map(repr, duck.sql(f"SELECT {names} FROM ({ORACLES[name]})").fetchall()))
