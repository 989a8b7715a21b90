"""Every query with SQL gives what DuckDB gives on the same tables."""

import glob
import math
import os

import duckdb
import pandas as pd
import pytest

from corvane import queries

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def rows(df: pd.DataFrame) -> list[tuple]:
    def plain(v):
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
            return "~"
        v = v.item() if hasattr(v, "item") else v
        return repr(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    return sorted(tuple(map(plain, r)) for r in df[sorted(df)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_rows(spark, oracle, name):
    got, want = queries.QUERIES[name](spark, FOLDER).toPandas(), oracle.sql(queries.SQL[name]).df()
    assert sorted(got) == sorted(want)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(queries.QUERIES.keys() - queries.SQL.keys()))
def test_has_rows(spark, name):
    assert queries.QUERIES[name](spark, FOLDER).count() > 0


def test_entry_point(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
