"""Every engine query against its SQL on the smallest tables."""

from __future__ import annotations

import os

import pytest

from partkin.plans import driver_queries, source_queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, ORACLE_SQL = driver_queries.QUERIES | source_queries.QUERIES, driver_queries.ORACLE_SQL | source_queries.ORACLE_SQL
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


def rows(df):
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        df[c] = df[c].round(6).astype(str) if df[c].dtype.kind == "f" else df[c].astype(str)
    return df.sort_values(list(df.columns)).to_numpy().tolist()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("orders", "lineitem", "part", "supplier", "nation"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got = QUERIES[name](spark, SF).toPandas()
    want = con.sql(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
    spark.catalog.clearCache()
