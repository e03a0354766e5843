"""Every registered query against its SQL oracle on the smallest tables."""
import math

import duckdb
import pytest

import __spark_entry__ as E
from litlens.plans.catalog import QUERIES
from litlens.plans.oracle import SQL
from litlens.sources.tables import TABLES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])

    def norm(v):  # exact: no rounding of doubles
        if isinstance(v, float) and math.isnan(v):
            return "nan"
        return v
    return sorted(tuple(repr(norm(r[i])) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_oracle(spark, con, name):
    df = QUERIES[name](spark, SF)
    rel = con.sql(SQL[name])
    assert sorted(df.columns) == sorted(rel.columns)
    assert _rows(df.columns, [tuple(r) for r in df.collect()]) == _rows(rel.columns, rel.fetchall())


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert set(QUERIES) == set(SQL) and set(QUERIES) <= set(E.queries())
