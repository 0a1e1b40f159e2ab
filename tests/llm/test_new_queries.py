"""The registered queries of the newer operators against their SQL in DuckDB."""

import os

import duckdb
import pytest

from tidemark.llm.oracle import ORACLE
from tidemark.llm.queries import QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", ["op12_importance_resampling", "op13_merkle_manifest"])
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark"):
        con.execute(f"create view {table} as select * from '{DATA}/{table}.parquet'")
    got, want = QUERIES[name](spark, DATA), con.sql(ORACLE[name])
    assert got.columns == want.columns and sorted(map(tuple, got.collect()), key=repr) == sorted(want.fetchall(), key=repr)
