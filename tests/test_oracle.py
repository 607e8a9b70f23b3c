"""Every query that has SQL gives the same rows as DuckDB on the same tables."""

import math
import os

import pytest

from lodestone.plans.queries import ORACLE_SQL, QUERIES

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
duckdb = pytest.importorskip("duckdb")


def plain(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return "NULL"
    return f"{x:.10g}" if isinstance(x, float) else str(x)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.sql(f"create view {f[:-8]} as select * from '{DATA}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows(spark, duck, name):
    df, want = QUERIES[name](spark, DATA), duck.sql(ORACLE_SQL[name])
    columns = sorted(df.columns)
    assert sorted(want.columns) == columns
    got = sorted(tuple(map(plain, r)) for r in df.select(columns).collect())
    assert got == sorted(tuple(map(plain, r)) for r in want.project(", ".join(f'"{c}"' for c in columns)).fetchall())
