"""Every query with an SQL counterpart gives the same rows on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from voxloom.plans import catalog


def rows_of(frame):
    frame = frame[sorted(frame.columns)]

    def plain(v):
        if v is None or v is pd.NA or v != v:
            return None
        return round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    return sorted(repr([plain(v) for v in row]) for row in frame.astype(object).itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def duck(small):
    def connect():
        connection = duckdb.connect()
        for name in os.listdir(small):
            connection.execute(f"create view {name.split('.')[0]} as select * from read_parquet('{small}/{name}')")
        return connection

    return connect


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_agrees_with_sql(spark, small, duck, name):
    made = catalog.queries()[name](spark, small).toPandas()
    wanted = duck().execute(catalog.oracle_sql()[name]).df()
    assert sorted(made.columns) == sorted(wanted.columns)
    assert rows_of(made) == rows_of(wanted)


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_query_runs(spark, small, name):
    assert catalog.queries()[name](spark, small).count() > 0


def test_entry_contract(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())
