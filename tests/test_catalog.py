"""Every registered query: same values as its SQL in DuckDB, and a plan that scales."""

import re
from pathlib import Path

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check import canonical
from wayfare.catalog import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="test tables not present")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for file in sorted(Path(FOLDER).glob("*.parquet")):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return con


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
    assert set(oracle_sql()) <= set(queries()) and set(QUERIES) <= set(queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    got = canonical(df.columns, [tuple(r) for r in df.collect()])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not re.search("CartesianProduct|NestedLoopJoin|EvalPython|MapInPandas|[ (]percentile\\(", plan)
    if name in ORACLES:
        cursor = duck.execute(ORACLES[name])
        columns = [c[0] for c in cursor.description]
        assert sorted(df.columns) == sorted(columns)
        assert got == canonical(columns, cursor.fetchall())
    else:
        assert got


def test_entry(spark):
    assert entry(spark).count() == 24
