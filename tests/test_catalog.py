"""Every named query against its oracle in DuckDB, over the smallest tables."""

import datetime
import glob
import math
import os

import duckdb
import pytest

from lithoframe.plans.catalog import ORACLE, QUERIES


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for p in glob.glob(f"{data}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (int, float)):
        return round(float(v), 6)
    if isinstance(v, (datetime.date, datetime.datetime)):
        return str(v)
    return bytes(v) if isinstance(v, (bytes, bytearray)) else str(v)


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(([plain(r[k]) for k in order] for r in values), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, duck, name):
    got = QUERIES[name](spark, data)
    found = got.collect()
    if name in ORACLE:
        want = duck.execute(ORACLE[name])
        columns = [c[0] for c in want.description]
        assert sorted(columns) == sorted(got.columns)
        assert rows(got.columns, found) == rows(columns, want.fetchall())
