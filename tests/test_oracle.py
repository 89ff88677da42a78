"""Every registered query with SQL, against DuckDB on the smallest tables; the others at least run."""

import os
import re

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from tessella.session import TABLES

SF = "/root/testdata/sf0.001"
SQL = entry.oracle_sql()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(df: pd.DataFrame) -> list[tuple]:
    def plain(v):
        if hasattr(v, "tolist") and not isinstance(v, (str, bytes)):
            v = v.tolist()
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
            return "null"
        if isinstance(v, (int, float)) and not isinstance(v, bool):
            return f"{float(v):.6g}"
        return pd.Timestamp(v).isoformat() if hasattr(v, "isoformat") else str(v)

    return sorted(tuple(plain(v) for v in r) for r in df.reindex(sorted(df.columns), axis=1).itertuples(index=False))


@pytest.mark.parametrize("name", [n for n in entry.queries() if not re.match(r"op\d+_|pipeline$", n)])
def test_query(spark, duck, name):
    found = entry.queries()[name](spark, SF).toPandas()
    if name in SQL:
        want = duck.sql(SQL[name]).df()
        assert sorted(found.columns) == sorted(want.columns)
        assert rows(found) == rows(want)


def test_entry(spark):
    assert entry.entry(spark).columns
