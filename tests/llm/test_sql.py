"""Registered queries of the subpackage that SQL can express, against DuckDB on the smallest tables."""

import duckdb
import pytest

from tessera.llm import queries

SF = "/root/testdata/sf0.001"


def plain(x):
    return round(x, 6) if isinstance(x, float) else tuple(map(plain, x)) if isinstance(x, list | tuple) else x


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations", "labels"):
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    df = queries.QUERIES[name](spark, SF)
    names = sorted(df.columns)
    want = con.execute(queries.ORACLE_SQL[name])
    found = [d[0] for d in want.description]
    assert sorted(found) == names
    rows = sorted((tuple(plain(r[found.index(c)]) for c in names) for r in want.fetchall()), key=str)
    assert sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=str) == rows
