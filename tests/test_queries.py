"""Every query with SQL equals it on the smallest tables."""

import os

import duckdb
import pytest

from lexweave import catalogue

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    own = duckdb.connect()
    for name in os.listdir(DATA):
        own.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{name}'")
    return own


def plain(rows):
    value = lambda v: round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else v
    return sorted((tuple(map(value, r)) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_equals_sql(spark, con, name):
    got = catalogue.queries()[name](spark, DATA)
    columns = sorted(got.columns)
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({catalogue.oracle_sql()[name]})").fetchall()
    assert plain(map(tuple, got.select(*columns).collect())) == plain(want)
