"""Every registered query of the reference's kind against DuckDB on the smallest tables."""

import datetime
import math
import os

import duckdb
import pytest

from tessera.plans import catalogue

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 5) + 0.0
    if isinstance(x, datetime.datetime):
        return x.isoformat()
    return tuple(map(plain, x)) if isinstance(x, list | tuple) else x


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    names = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=str)
    if name not in catalogue.ORACLE_SQL:
        return
    want = duck.execute(catalogue.ORACLE_SQL[name])
    found = [d[0] for d in want.description]
    assert sorted(found) == names
    rows = sorted((tuple(plain(r[found.index(c)]) for c in names) for r in want.fetchall()), key=str)
    assert got == rows
