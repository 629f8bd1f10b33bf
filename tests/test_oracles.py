"""Registered queries against their DuckDB oracles on the smallest fixture."""

import os

import pytest

import __spark_entry__ as entry
from test_plans import formatted
from tools.check_oracles import TABLES, rows_of

SF = "/root/testdata/sf0.001"
ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="fixture tables absent")
@pytest.mark.parametrize("key", sorted(ORACLES))
def test_query_matches_oracle(spark, duck, key):
    df = entry.queries()[key](spark, SF)
    plan = formatted(df)
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    res = duck.execute(ORACLES[key])
    dcols = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(dcols)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(dcols, res.fetchall())


@pytest.mark.skipif(not os.path.isdir(SF), reason="fixture tables absent")
def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0
