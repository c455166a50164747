"""SQL in the embedded engine's dialect on Spark: statements, dashboard macros, and results as JSON values."""

from __future__ import annotations

import base64
import datetime
import decimal
import json
import math
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .dialect import Translator, Unsupported, is_word, parse

__all__ = ["Unsupported", "encode", "execute", "macros", "query", "translate"]


def translate(text: str, as_of: datetime.datetime | None = None, scan: Callable[[str, list], str] | None = None, spark: SparkSession | None = None) -> str:
    return Translator(as_of, scan, spark).statement(text)


def macros(text: str, interval: str, start: str, end: str, **variables: str) -> str:
    """A dashboard's text with its macros and variables filled in; times are UTC texts."""
    q = lambda x: "'" + x.replace("'", "''") + "'"
    text = re.sub(r"\$__timeFilter\(([^)]*)\)", lambda m: f"{m[1]} BETWEEN TIMESTAMP {q(start)} AND TIMESTAMP {q(end)}", text)
    text = text.replace("$__interval", q(interval)).replace("$__timeFrom", q(start[:10])).replace("$__timeTo", q(end[:10]))
    for name, value in variables.items():
        text = text.replace(f"${name}", value.replace("'", "''"))
    return text


def encode(value):
    """A value as JSON has it: decimals as text, times in ISO 8601, bytes in Base64, what is no number as null."""
    if value is None or isinstance(value, (bool, str, int)):
        return value
    if isinstance(value, float):
        return value if math.isfinite(value) else None
    if isinstance(value, decimal.Decimal):
        return format(value, "f")
    if isinstance(value, (datetime.datetime, datetime.date, datetime.time)):
        return value.isoformat()
    if isinstance(value, datetime.timedelta):
        return f"months=0,days={value.days},nanos={(value.seconds * 10**6 + value.microseconds) * 1000}"
    if isinstance(value, (bytes, bytearray)):
        return base64.b64encode(bytes(value)).decode()
    if isinstance(value, dict):
        return {k if isinstance(k, str) else json.dumps(encode(k)): encode(v) for k, v in value.items()}
    if hasattr(value, "asDict"):
        return {k: encode(v) for k, v in value.asDict().items()}
    return [encode(v) for v in value]


def query(spark: SparkSession, text: str, as_of: datetime.datetime | None = None, scan=None) -> DataFrame:
    if not text or not text.strip():
        raise ValueError("the statement is empty")
    items = parse(text.strip().rstrip(";"))
    if [x.upper() for x in items[:4] if isinstance(x, str)] == ["CREATE", "OR", "REPLACE", "TABLE"]:  # Spark has no such statement for plain tables
        as_at = next(i for i, x in enumerate(items) if is_word(x, "AS"))
        name = "".join(items[4:as_at])
        made = Translator(as_of, scan, spark).render(items[as_at + 1 :])
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        return spark.sql(f"CREATE TABLE {name} AS {made}")
    return spark.sql(translate(text, as_of, scan, spark))


def execute(spark: SparkSession, text: str, as_of: datetime.datetime | None = None, scan=None) -> dict:
    """{columns, rows, row_count} of a statement, whose result the caller expects to hold in memory."""
    df = query(spark, text, as_of, scan)
    rows = [[encode(v) for v in r] for r in df.collect()]
    return {"columns": df.columns, "rows": rows, "row_count": len(rows)}
