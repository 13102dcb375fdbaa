"""Every query that has SQL, against DuckDB on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from pilespan.plans.oracle import SQL
from pilespan.plans.queries import QUERIES

DIR = "/root/testdata/sf0.001"
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("orders", "events", "part"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


def plain(rows):
    cell = lambda v: "~" if pd.isna(v) else repr(round(float(v), 9)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return sorted(tuple(map(cell, r)) for r in rows)


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_is_its_sql(spark, duck, name):
    df, sql = QUERIES[name](spark, DIR), duck.sql(SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(sql.columns)
    types = dict(zip(sql.columns, map(str, sql.types)))
    assert {c: TYPES[t] for c, t in df.dtypes} == types
    order = [sql.columns.index(c) for c in columns]
    assert plain(tuple(r) for r in df.select(*columns).collect()) == plain(tuple(r[i] for i in order) for r in sql.fetchall())
