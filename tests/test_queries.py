"""Every registered query against the SQL of its oracle, on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from evidentia.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def cell(v):
    if pd.isna(v):
        return ""
    if isinstance(v, str | bool):
        return str(v)
    return repr(round(float(v), 6))


def table(df):
    df = df[sorted(df.columns)].astype(object)
    return sorted(tuple(map(cell, r)) for r in df.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, db, sf_dir, name):
    got, want = catalog.queries()[name](spark, sf_dir).toPandas(), db.execute(catalog.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert table(got) == table(want)
