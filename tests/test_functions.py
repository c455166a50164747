"""Functions whose name or result differs between the dialects, against DuckDB."""

import duckdb
import pytest

from spanfold import sql

ROWS = "(VALUES (1.0, 'a'), (2.0, 'é'), (9.0, ''), (4.0, NULL)) t(x, s)"


@pytest.mark.parametrize(
    "text",
    [
        "SELECT sha256(s) AS v FROM " + ROWS,
        "SELECT EXTRACT(DOW FROM TIMESTAMP '2024-01-07 10:00:00') AS v UNION ALL SELECT date_part('dow', DATE '2024-01-06')",
        "SELECT ROUND(skewness(CAST(x AS DOUBLE)), 8) AS v FROM " + ROWS,
        "SELECT skewness(CAST(x AS DOUBLE)) AS v FROM " + ROWS + " WHERE x < 3",
    ],
)
def test_functions(spark, text):
    assert sorted(repr(r.v) for r in sql.query(spark, text).collect()) == sorted(repr(r[0]) for r in duckdb.sql(text).fetchall())
