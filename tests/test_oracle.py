"""Queries against their SQL on the smallest tables: values are rounded in the queries, and must then be equal."""

import duckdb
import pandas as pd
import pytest

from strideframe import queries as Q

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in ("customer", "orders", "lineitem", "events", "embeddings", "nation", "region", "supplier", "part"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def canonical(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)]
    df = pd.DataFrame({c: df[c].astype(str) if df[c].dtype == object or df[c].dtype == "str" else df[c].astype(float) + 0.0 for c in df.columns})
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(Q.ORACLE_SQL))
def test_query_equals_sql(spark, con, name):
    got, want = canonical(Q.QUERIES[name](spark, SF).toPandas()), canonical(con.execute(Q.ORACLE_SQL[name]).df())
    assert list(got.columns) == list(want.columns)
    pd.testing.assert_frame_equal(got, want, check_dtype=False, rtol=0, atol=1e-9)
