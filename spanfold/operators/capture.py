"""Capture export: the spans of a capture as one JSON document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import first_non_empty, hex_to_base64, key_containing


class NotFound(LookupError):
    """The capture has no span."""


def capture_rows(spans: DataFrame, tenant_id: str, capture_id: str) -> DataFrame:
    """The tenant's spans of a capture."""
    a = F.col("attributes")
    return spans.where((a["sp.capture.id"] == capture_id) & (a["sp.tenant.id"] == tenant_id))


def _text(key: str, value: Column) -> Column:
    return F.struct(F.lit(key).alias("key"), F.struct(F.coalesce(value, F.lit("")).alias("stringValue"), F.lit(None).cast("long").alias("intValue")).alias("value"))


def _number(key: str, value: Column) -> Column:
    return F.struct(F.lit(key).alias("key"), F.struct(F.lit(None).cast("string").alias("stringValue"), value.cast("long").alias("intValue")).alias("value"))


def trace_documents(rows: DataFrame) -> DataFrame:
    """(timestamp, span_id, trace): each span as an OTLP request; columns count first, attributes after them.

    An attribute is found by a part of its key, the first such key in order. The direction is always ``outbound``.
    """
    attr = lambda k: key_containing(F.col("attributes"), k)
    column = lambda c: F.coalesce(F.col(c), F.lit(""))
    method = first_non_empty(column("http_request_method"), attr("http.request.method"), attr("http.request.header.:method"))
    known = first_non_empty(column("http_request_path"), attr("url.path"), attr("http.request.path"), attr("http.request.header.:path"))
    url = first_non_empty(column("http_request_path"), attr("url.full"), known)
    path = F.coalesce(known, F.when(F.startswith(F.col("message_type"), F.lit("/")), F.col("message_type")))
    body = first_non_empty(column("http_response_body"), attr("http.response.body"))
    status = F.coalesce(F.col("http_response_status_code"), F.lit(0)).cast("long")
    given = attr("http.response.status_code")
    status = F.when(status == 0, F.coalesce(F.when(given.rlike(r"\A[+-]?[0-9]+\z"), given.try_cast("bigint")), F.lit(0))).otherwise(status)
    attributes = F.array(
        _text("sp.span.type", F.lit("extract")),
        _text("sp.traffic.direction", F.lit("outbound")),
        _text("http.request.method", method),
        _text("url.path", path),
        _text("url.full", url),
        _text("http.response.body", body),
        _number("http.response.status_code", status),
        _text("message.type", F.col("message_type")),
    )
    attributes = F.filter(attributes, lambda x: (x["key"] != "message.type") | (x["value"]["stringValue"] != ""))
    span = F.struct(
        hex_to_base64(column("trace_id")).alias("traceId"),
        hex_to_base64(column("span_id")).alias("spanId"),
        hex_to_base64(column("parent_span_id")).alias("parentSpanId"),
        F.lit("sp.extract").alias("name"),
        attributes.alias("attributes"),
    )
    request = F.struct(F.array(F.struct(F.array(F.struct(F.array(span).alias("spans"))).alias("scopeSpans"))).alias("resourceSpans"))
    return rows.select("timestamp", "span_id", request.alias("trace"))


def export(spans: DataFrame, tenant_id: str, capture_id: str, created_at: Column | None = None) -> DataFrame:
    """One row, ``document``: the JSON of a capture, its traces by time; no row if it has no span. One capture is one
    value, so its spans meet in one task."""
    traces = trace_documents(capture_rows(spans, tenant_id, capture_id))
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("timestamp", "span_id", "trace"))), lambda x: x["trace"])
    created = F.date_format(created_at if created_at is not None else F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
    one = traces.agg(ordered.alias("traces")).where(F.size("traces") > 0)
    document = F.struct(
        F.lit("1.0.0").alias("version"), F.lit(capture_id).alias("caseId"), F.lit(capture_id).alias("captureId"),
        F.lit("capture").alias("mode"), created.alias("createdAt"), F.col("traces"),
    )
    return one.select(F.to_json(document).alias("document"))


def capture_json(spans: DataFrame, tenant_id: str, capture_id: str) -> str:
    row = export(spans, tenant_id, capture_id).first()
    if row is None:
        raise NotFound(capture_id)
    return row["document"]
