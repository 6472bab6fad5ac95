"""Every query with SQL gives what DuckDB gives, on the smallest tables."""

from __future__ import annotations

import os

import pandas as pd
import pytest

import __spark_entry__ as entry

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    cell = lambda x: None if pd.isna(x) else f"{x:.9g}" if isinstance(x, float) else str(x)
    return sorted((tuple(cell(x) for x in r) for r in df.itertuples(index=False)), key=str)


def same(a: list[tuple], b: list[tuple]) -> bool:
    # a column of whole numbers with nulls comes as floats
    plain = lambda rs: sorted(str(tuple(None if x is None else x.removesuffix(".0") for x in r)) for r in rs)
    return plain(a) == plain(b)


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(DATA):
        pytest.skip("no test tables")
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", [n for n in entry.oracle_sql() if not n.startswith("op")])
def test_query_equals_sql(spark, duck, name):
    got, expected = entry.queries()[name](spark, DATA).toPandas(), duck.sql(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(expected.columns)
    assert same(rows(got), rows(expected))


@pytest.mark.parametrize("name", [n for n in entry.queries() if n not in entry.oracle_sql() and not n.startswith("op") and n != "pipeline"])
def test_query_without_sql_has_rows(spark, name):
    if not os.path.isdir(DATA):
        pytest.skip("no test tables")
    assert entry.queries()[name](spark, DATA).count() > 0


def test_entry(spark):
    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("no test tables")
    assert entry.entry(spark).count() > 0


def test_each_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
