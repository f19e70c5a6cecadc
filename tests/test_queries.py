"""Every query with SQL is compared with it at the smallest scale."""

import math
import os

import duckdb
import pytest

from onggi.plans import core_queries

SF = "/root/testdata/sf0.001"


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, list | tuple):
        return tuple(map(plain, v))
    return round(v, 8) if isinstance(v, float) else v


def compare(spark, name, queries, sql):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    df = queries[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(repr(tuple(plain(r[c]) for c in cols)) for r in df.collect())
    rel = con.sql(sql[name])
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    assert got == sorted(repr(tuple(plain(r[i]) for i in at)) for r in rel.fetchall())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(core_queries.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    compare(spark, name, core_queries.queries(), core_queries.oracle_sql())
