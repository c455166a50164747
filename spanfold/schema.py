"""The three telemetry tables, their layout and promoted attribute columns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

_S, _TS, _MAP = T.StringType(), T.TimestampType(), T.MapType(T.StringType(), T.StringType(), True)


def _schema(*fields: tuple[str, T.DataType, bool]) -> T.StructType:
    return T.StructType([T.StructField(*f) for f in fields])


EVENT = _schema(("name", _S, True), ("timestamp", _TS, True), ("attributes", _MAP, True))

TRACES = _schema(
    ("session_id", _S, False), ("trace_id", _S, False), ("span_id", _S, False), ("parent_span_id", _S, True),
    ("app_id", _S, False), ("organization_id", _S, True), ("tenant_id", _S, True), ("message_type", _S, False),
    ("span_kind", _S, True), ("timestamp", _TS, False), ("end_timestamp", _TS, True), ("attributes", _MAP, True),
    ("events", T.ArrayType(EVENT), True), ("status_code", _S, True), ("status_message", _S, True),
    ("http_request_method", _S, True), ("http_request_path", _S, True), ("http_request_headers", _S, True),
    ("http_request_body", _S, True), ("http_response_status_code", T.IntegerType(), True),
    ("http_response_headers", _S, True), ("http_response_body", _S, True), ("record_date", T.DateType(), False),
)

LOGS = _schema(
    ("session_id", _S, True), ("timestamp", _TS, False), ("observed_timestamp", _TS, True),
    ("severity_number", T.IntegerType(), False), ("severity_text", _S, False), ("body", _S, False),
    ("attributes", _MAP, True), ("resource_attributes", _MAP, True), ("trace_id", _S, True), ("span_id", _S, True),
    ("record_date", T.DateType(), False),
)

METRICS = _schema(
    ("metric_name", _S, False), ("description", _S, False), ("unit", _S, False), ("metric_type", _S, False),
    ("timestamp", _TS, False), ("value", T.DoubleType(), False), ("attributes", _MAP, True),
    ("resource_attributes", _MAP, True), ("record_date", T.DateType(), False),
)


@dataclass(frozen=True)
class Layout:
    """How a table is laid out in files: one folder a day, rows sorted so that row groups hold few keys."""

    schema: T.StructType
    group: str
    order: tuple[str, ...]
    bloom: tuple[str, ...]


TABLES = {
    "spans": Layout(TRACES, "session_id", ("app_id", "session_id", "trace_id", "timestamp"), ("session_id", "trace_id", "span_id", "parent_span_id")),
    "logs": Layout(LOGS, "session_id", ("session_id", "timestamp"), ("session_id", "trace_id", "span_id")),
    "metrics": Layout(METRICS, "metric_name", ("metric_name", "timestamp"), ("metric_name",)),
}

PROMOTED_TYPES = {"string": _S, "integer": T.IntegerType(), "double": T.DoubleType(), "boolean": T.BooleanType()}


@dataclass(frozen=True)
class Promotion:
    """An attribute that becomes a typed column; what does not parse is null."""

    attribute_key: str
    column_name: str | None = None
    data_type: str = "string"
    source: str = "attributes"

    @property
    def column(self) -> str:
        return self.column_name or self.attribute_key


def with_promotions(schema: T.StructType, promotions: list[Promotion]) -> T.StructType:
    extra = [T.StructField(p.column, PROMOTED_TYPES[p.data_type.lower()], True) for p in promotions]
    return T.StructType([*schema.fields, *extra])
