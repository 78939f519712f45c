"""Every query with SQL gives the rows that DuckDB gives."""

import numbers

import duckdb
import numpy as np
import pandas as pd
import pytest

from firnline import queries

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]
    for c in frame.columns:
        if "date" in c or "datetime" in str(frame[c].dtype):
            frame = frame.assign(**{c: pd.to_datetime(frame[c]).astype(str)})
    shown = lambda x: "" if x is None or x is pd.NA or x is pd.NaT or x != x else f"{float(x):.6f}" if isinstance(x, numbers.Number) and not isinstance(x, (bool, np.bool_)) else str(x)
    return sorted(tuple(shown(x) for x in row) for row in frame.astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, duck, sf_dir, name):
    ours, theirs = queries.QUERIES[name](spark, sf_dir).toPandas(), duck.sql(queries.ORACLES[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert plain(ours) == plain(theirs)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_query_without_sql_has_rows(spark, sf_dir, name):
    assert queries.QUERIES[name](spark, sf_dir).count() > 0
