"""Registered texts cover their whole table, whatever the ids are."""

import os

import pytest

from spanfold.plans import queries

SF = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.mark.parametrize(
    ("name", "table", "times"),
    [
        ("select_exclude", "events", 1),
        ("unpivot_rows", "lineitem", 2),
        ("fn_dates", "events", 1),
        ("fn_math", "lineitem", 1),
        ("fn_hashes", "events", 1),
        ("try_cast_text", "events", 1),
        ("order_nulls", "events", 1),
    ],
)
def test_every_row_is_there(spark, name, table, times):
    assert queries.queries()[name](spark, SF).count() == times * spark.read.parquet(f"{SF}/{table}.parquet").count()


def test_nulls_come_last(spark):
    v = [r.v for r in queries.queries()["order_nulls"](spark, SF).collect()]
    known = [x for x in v if x is not None]
    assert 0 < len(known) < len(v) and v[: len(known)] == sorted(known, reverse=True)
