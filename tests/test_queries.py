"""The recommendation queries against their SQL on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from newsloom.plans import queries

SF = "/root/testdata/sf0.001"
TABLES = ["events", "embeddings", "documents", "orders", "customer"]
CHECKED = sorted(queries.oracle_sql())


def rows(frame):
    frame = frame[sorted(frame.columns)]
    cell = lambda x: None if pd.isna(x) else f"{x:.6g}" if isinstance(x, float) else str(x)
    return sorted((tuple(map(cell, r)) for r in frame.astype(object).itertuples(index=False)), key=str)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", CHECKED)
def test_same_as_sql(spark, duck, name):
    got = queries.queries()[name](spark, SF).toPandas()
    want = duck.execute(queries.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry_is_registered():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
