"""Every registered query against DuckDB on the driver's tables."""

import os

import duckdb
import pytest

from spanfold.plans import fixtures, queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in fixtures.PLAIN:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def _rows(columns, rows):
    at = [columns.index(c) for c in sorted(columns)]
    return sorted(repr([round(r[i], 5) if isinstance(r[i], float) else r[i] for i in at]) for r in rows)


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, duck, name):
    df = queries.queries()[name](spark, SF)
    rows = df.collect()
    text = queries.oracle_sql().get(name)
    if text is None:
        assert rows
        return
    found = duck.execute(text)
    columns = [c[0] for c in found.description]
    assert sorted(df.columns) == sorted(columns)
    assert _rows(df.columns, rows) == _rows(columns, found.fetchall())


def test_recency_reaches_the_scan(spark):
    df = queries.queries()["span_error_rate_5m"](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts" in plan
    assert "props" not in plan.split("ReadSchema:")[1]
