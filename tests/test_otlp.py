"""Flattening, a rule at a time, and random attributes against a plain model."""

import json

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spanfold.functions import text as T
from spanfold.schema import LOGS, METRICS, TRACES, Promotion
from spanfold.sources import otlp

NS = 1_640_995_200_000_001_999


def kv(key, **value):
    return {"key": key, "value": value}


def s(key, text):
    return kv(key, stringValue=text)


def flat(spark, kind, *documents, **options):
    df = otlp.parse(spark.createDataFrame([(json.dumps(d),) for d in documents], "value string"), kind)
    return otlp.FLATTEN[kind](df, **options).collect()


def spans(spans, resource=()):
    return {"resourceSpans": [{"resource": {"attributes": list(resource)}, "scopeSpans": [{"spans": spans}]}]}


def span(**more):
    return {"traceId": "AB01", "spanId": "0F", "name": "GET /", "startTimeUnixNano": str(NS)} | more


def test_columns_are_those_of_the_tables(spark):
    for kind, schema in (("spans", TRACES), ("logs", LOGS), ("metrics", METRICS)):
        empty = spark.createDataFrame([], otlp.SCHEMAS[kind])
        assert otlp.FLATTEN[kind](empty).columns == schema.fieldNames()


def test_span_defaults(spark):
    (r,) = flat(spark, "spans", spans([span()]))
    assert (r.session_id, r.trace_id, r.span_id, r.parent_span_id) == ("ab01", "ab01", "0f", None)
    assert (r.app_id, r.status_code, r.end_timestamp, r.span_kind) == ("unknown", None, None, "Unspecified")
    assert r.timestamp.isoformat() == "2022-01-01T00:00:00.000001" and r.record_date.isoformat() == "2022-01-01"


def test_session_app_and_last_of_repeated_keys(spark):
    resource = [s("service.name", "svc"), kv("host.port", intValue="5"), s("sp.tenant.id", "t"), s("sp.organization.id", "o")]
    (r,) = flat(spark, "spans", spans([span(attributes=[s("sp.session.id", "a"), s("sp.session.id", "b")], status={"code": 2, "message": ""})], resource))
    assert (r.session_id, r.app_id, r.tenant_id, r.organization_id) == ("b", "svc", "t", "o")
    assert (r.status_code, r.status_message) == ("ERROR", None)
    (r,) = flat(spark, "spans", spans([span(kind="SPAN_KIND_SERVER", status={"code": "STATUS_CODE_OK", "message": "fine"})], [*resource, s("sp.app.id", "app")]))
    assert (r.app_id, r.span_kind, r.status_code, r.status_message) == ("app", "Server", "OK", "fine")


def test_scalars_and_dropped_values(spark):
    attributes = [kv("i", intValue=7), kv("j", intValue="8"), kv("d", doubleValue=5.0), kv("e", doubleValue=1e10), kv("f", doubleValue=1.5), kv("b", boolValue=True), kv("list", arrayValue={"values": []}), {"key": "none"}]
    (r,) = flat(spark, "spans", spans([span(attributes=attributes)]))
    assert r.attributes == {"i": "7", "j": "8", "d": "5", "e": "10000000000", "f": "1.5", "b": "true"}


def test_events_and_http_fields(spark):
    events = [
        {"name": "http.request", "timeUnixNano": NS, "attributes": [s("http.request.body", "from event")]},
        {"name": "http.request", "timeUnixNano": NS, "attributes": [s("http.request.body", "second")]},
        {"name": "http.response", "timeUnixNano": NS, "attributes": [kv("x", arrayValue={"values": []}), s("http.response.body", "lost")]},
    ]
    attributes = [s("http.request.body", "from span"), s("http.request.headers", "h"), s("http.response.body", "kept"), s("http.target", "/t"), s("http.request.method", "GET")]
    (r,) = flat(spark, "spans", spans([span(events=events, attributes=attributes)]))
    assert (r.http_request_body, r.http_request_headers, r.http_response_body) == ("from event", "h", "kept")
    assert (r.http_request_path, r.http_request_method, len(r.events)) == ("/t", "GET", 2)


@pytest.mark.parametrize(("first", "second", "want"), [("404", "500", 404), ("bad", "500", None), (None, "500", 500), (None, " 5", None), ("99999999999", None, None)])
def test_status_code(spark, first, second, want):
    attributes = [s(k, v) for k, v in (("http.response.status_code", first), ("http.status_code", second)) if v]
    (r,) = flat(spark, "spans", spans([span(attributes=attributes)]))
    assert r.http_response_status_code == want


def test_hosted_ids_and_promotion(spark):
    promotions = [Promotion("count", data_type="integer"), Promotion("price", "cost", "double"), Promotion("on", data_type="boolean"), Promotion("region", source="resource_attributes")]
    rows = flat(spark, "spans", spans([span(attributes=[s("count", "5"), s("price", "1e2"), s("on", "yes")]), span(attributes=[s("count", " 5 "), s("on", "true")])], [s("region", "eu")]), promotions=promotions, tenant_id="T", capture_id="C")
    assert [(r["count"], r.cost, r.on, r.region) for r in rows] == [(5, 100.0, None, "eu"), (None, None, True, "eu")]
    assert rows[0].attributes["sp.capture.id"] == "C" and rows[0].tenant_id == "T"


def test_logs(spark):
    def log(**more):
        return {"timeUnixNano": NS, "severityNumber": 17} | more

    doc = {"resourceLogs": [{"resource": {"attributes": [s("session_id", "r2"), s("sp.session.id", "r3")]}, "scopeLogs": [{"logRecords": [
        log(body={"stringValue": "hi"}, attributes=[s("sp.session.id", "mine"), s("session.id", "later")]),
        log(body={"kvlistValue": {}}, severityText="custom", attributes=[kv("session.id", intValue=5)], traceId="AA"),
        log(severityNumber=0),
    ]}]}]}
    a, b, c = flat(spark, "logs", doc)
    assert (a.session_id, a.body, a.severity_text, a.trace_id) == ("mine", "hi", "SEVERITY_ERROR", None)
    assert (b.session_id, b.body, b.severity_text, b.trace_id) == ("r2", "", "custom", "aa")
    assert (c.severity_number, c.severity_text) == (0, "SEVERITY_UNSPECIFIED")


def test_metrics(spark):
    point = {"timeUnixNano": NS}
    doc = {"resourceMetrics": [{"resource": {"attributes": [s("host", "h")]}, "scopeMetrics": [{"metrics": [
        {"name": "cpu", "unit": "%", "gauge": {"dataPoints": [point | {"asDouble": 75.5}, point]}},
        {"name": "requests", "sum": {"dataPoints": [point | {"asInt": "1234"}]}},
        {"name": "sizes", "histogram": {"dataPoints": [point | {"count": "3", "sum": 9.5, "attributes": [s("k", "v")]}, point | {"count": 2}]}},
        {"name": "times", "summary": {"dataPoints": [point | {"count": "4", "sum": 2.0}]}},
        {"name": "dropped", "exponentialHistogram": {"dataPoints": [point | {"count": "4", "sum": 2.0}]}},
    ]}]}]}
    rows = {(r.metric_name, r.value): r for r in flat(spark, "metrics", doc)}
    assert set(rows) == {("cpu", 75.5), ("requests", 1234.0), ("sizes", 9.5), ("sizes", 0.0), ("times", 2.0)}
    assert rows["sizes", 9.5].attributes == {"k": "v", "count": "3"} and rows["sizes", 9.5].metric_type == "histogram"
    assert rows["cpu", 75.5].resource_attributes == {"host": "h"}


def test_empty_requests(spark):
    assert flat(spark, "spans", {"resourceSpans": []}) == [] == flat(spark, "logs", {"resourceLogs": []}) == flat(spark, "metrics", {})


def test_text_functions(spark):
    rows = [("ab01", " ", "x"), ("zz", "", " y "), ("abc", None, None)]
    df = spark.createDataFrame(rows, "h string, a string, b string")
    got = df.select(T.hex_to_base64(F.col("h")), T.first_non_empty(F.col("a"), F.col("b"))).collect()
    assert [tuple(r) for r in got] == [("qwE=", "x"), ("zz", " y "), ("abc", None)]


values = st.one_of(
    st.text(max_size=5).map(lambda x: ({"stringValue": x}, x)),
    st.integers(-(2**40), 2**40).map(lambda x: ({"intValue": x}, str(x))),
    st.booleans().map(lambda x: ({"boolValue": x}, "true" if x else "false")),
    st.just(({"arrayValue": {"values": []}}, None)),
)


@settings(max_examples=1, suppress_health_check=list(HealthCheck), deadline=None)
@given(st.lists(st.lists(st.tuples(st.sampled_from("abc"), values), max_size=6), min_size=30, max_size=60))
def test_random_attributes(spark, lists):
    document = spans([span(spanId=f"{i:04x}", attributes=[{"key": k, "value": v} for k, (v, _) in pairs]) for i, pairs in enumerate(lists)])
    rows = {r.span_id: r.attributes for r in flat(spark, "spans", document)}
    for i, pairs in enumerate(lists):
        want = {}
        for k, (_, text) in pairs:
            if text is not None:
                want[k] = text
        assert rows[f"{i:04x}"] == want
