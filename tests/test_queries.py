"""Every registered query of the core against its SQL in DuckDB, on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from entwine.plans import oracle, queries

SF = Path("/root/testdata/sf0.001")
SQL = oracle.build()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in SF.glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def tidy(rows):
    def cell(v):
        if isinstance(v, float):
            return None if math.isnan(v) else round(v + 0.0, 5)
        return v

    return sorted([tuple(cell(v) for v in r) for r in rows], key=repr)


def test_each_query_has_sql():
    assert set(SQL) == set(queries.QUERIES)


@pytest.mark.skipif(not SF.exists(), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, duck, name):
    got = queries.QUERIES[name](spark, str(SF))
    want = duck.sql(SQL[name])
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    assert tidy(got.select(*cols).collect()) == tidy(want.select(*cols).fetchall())
