"""Every registered query against its SQL in DuckDB at the smallest scale."""

import os

import duckdb
import pytest

from tidemark.plans.registry import ORACLE, QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def rows(df, columns):
    def plain(x):
        if x is None or x != x:
            return None
        return x if isinstance(x, (bool, str)) else round(float(x), 6) if hasattr(x, "__float__") else str(x)

    return sorted(map(repr, (tuple(map(plain, r)) for r in df[columns].astype(object).itertuples(index=False, name=None))))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for name in os.listdir(DATA):
        con.execute(f"create view {name.removesuffix('.parquet')} as select * from '{DATA}/{name}'")
    return con


@pytest.mark.parametrize("name", QUERIES)
def test_query_matches_sql(spark, duck, name):
    got, want = QUERIES[name](spark, DATA).toPandas(), duck.sql(ORACLE[name]).to_df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got, sorted(got.columns)) == rows(want, sorted(want.columns))


def test_entry(spark):
    import __spark_entry__ as driver

    assert driver.entry(spark).count() > 0
    assert set(driver.oracle_sql()) <= set(driver.queries())
