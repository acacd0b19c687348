"""Every registered query that has SQL gives the SQL's rows on the smallest tables."""

import importlib

import duckdb
import pandas as pd
import pytest

from funnelforge.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
SQL = registry.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES.split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def cells(frame: pd.DataFrame) -> list[tuple]:
    def cell(v):
        if v is None or (not hasattr(v, "__len__") and pd.isna(v)):
            return ""
        return f"{float(v):.6g}" if not isinstance(v, str) and not hasattr(v, "__len__") else str(v)

    return sorted(tuple(map(cell, r)) for r in frame[sorted(frame.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, duck, sf_dir, name):
    found = registry.queries()[name](spark, sf_dir).toPandas()
    want = duck.sql(SQL[name]).df()
    assert sorted(found.columns) == sorted(want.columns)
    assert cells(found) == cells(want)


def test_entry_point_imports_and_registers():
    entry = importlib.import_module("__spark_entry__")
    names = entry.queries()
    assert set(registry.queries()) <= set(names) and set(entry.oracle_sql()) <= set(names)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(SQL)))
def test_query_without_sql_runs(spark, sf_dir, name):
    found = registry.queries()[name](spark, sf_dir)
    assert found.columns and found.count() >= 0
