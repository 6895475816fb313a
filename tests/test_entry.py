"""Queries against their SQL on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from veracal.plans import queries as own

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def normal(rows):
    def one(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return None
        return round(float(v), 5) if isinstance(v, (int, float)) and not isinstance(v, bool) else v

    return sorted(([one(v) for v in r] for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(own.oracle_sql()))
def test_against_sql(spark, con, name):
    df = own.queries()[name](spark, SF)
    cols = sorted(df.columns)
    want = con.sql(own.oracle_sql()[name])
    assert sorted(want.columns) == cols
    got = [[r[c] for c in cols] for r in df.collect()]
    rows = [[r[want.columns.index(c)] for c in cols] for r in want.fetchall()]
    assert normal(got) == normal(rows)
    spark.catalog.clearCache()


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "lower_alpha" in df.columns
    assert set(entry.oracle_sql()) <= set(entry.queries())
