"""Every query with SQL gives the rows that DuckDB gives, on the smallest tables."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pandas as pd
import pytest

from pointweave.plans.queries import ORACLE_SQL, QUERIES

FOLDER = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="the test tables aren't here")


@pytest.fixture(scope="module")
def duck() -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for p in FOLDER.glob("*.parquet"):
        connection.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return connection


def canonical(df: pd.DataFrame) -> list[tuple]:
    df = df.reindex(sorted(df.columns), axis=1)
    value = lambda x: None if x is None or x is pd.NA or x != x else round(float(x), 5) + 0.0 if isinstance(x, (int, float)) or hasattr(x, "dtype") else str(x)
    return sorted((tuple(value(x) for x in row) for row in df.itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    found, expected = QUERIES[name](spark, str(FOLDER)).toPandas(), duck.execute(ORACLE_SQL[name]).df()
    assert sorted(found.columns) == sorted(expected.columns)
    assert canonical(found) == canonical(expected)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_query_gives_rows(spark, name):
    assert QUERIES[name](spark, str(FOLDER)).count() > 0
