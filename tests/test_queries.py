"""Every query with SQL against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from codeweave.plans.queries import QUERIES, SQL

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in sorted(os.listdir(DATA)):
        con.sql(f"create view {f.removesuffix('.parquet')} as select * from '{DATA}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, duck, name):
    ours, theirs = QUERIES[name](spark, DATA).toPandas(), duck.sql(SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)

    def rows(df):
        df = df[sorted(df.columns)].astype(object)
        return sorted(map(str, df.where(df.notna(), None).itertuples(index=False, name=None)))

    assert rows(ours) == rows(theirs)
