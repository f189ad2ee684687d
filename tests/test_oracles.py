"""Every query with SQL gives the rows that DuckDB gives for it."""

import math

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from loomery.plans.queries import ORACLES, QUERIES

from .conftest import SMALL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return con


def plain(df):
    cell = lambda x: None if pd.api.types.is_scalar(x) and pd.isna(x) else float(x) if isinstance(x, float) else x.item() if hasattr(x, "item") else x
    return sorted(repr([cell(x) for x in r]) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query(spark, db, name):
    got, want = entry.queries()[name](spark, SMALL).toPandas(), db.execute(entry.oracle_sql()[name]).df()
    for c in want.select_dtypes("Int64"):  # whole numbers with nulls
        got[c] = got[c].astype("Int64")
    assert sorted(got.columns) == sorted(want.columns) and len(got) == len(want)
    assert plain(got) == plain(want)


def test_entry(spark):
    assert entry.entry(spark).count() == math.ceil(200 / 32) * 32


def test_keys():
    assert set(ORACLES) <= set(QUERIES) and set(entry.oracle_sql()) <= set(entry.queries())
