"""Every query against its SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

from tidemark.plans.queries import ORACLES, QUERIES

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(FOLDER):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{FOLDER}/{f}'")
    return c


def key(row):
    return tuple("" if v is None or isinstance(v, float) and math.isnan(v) else repr(v) for v in row)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    names = sorted(df.columns)
    got = sorted(key(r) for r in df.select(*names).collect())
    assert got
    if name in ORACLES:
        rows = duck.sql(ORACLES[name])
        assert sorted(rows.columns) == names
        assert got == sorted(key(r) for r in duck.sql("SELECT " + ", ".join(f'"{n}"' for n in names) + " FROM rows").fetchall())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
