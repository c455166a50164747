"""The dialect, value encoding, and the pipelines around captures, rules and the value catalog."""

import datetime
import decimal
import json

import pytest
from pyspark.sql import functions as F

from spanfold import sql
from spanfold.operators import capture, catalog, inject, joins


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("SELECT x::VARCHAR FROM t", "SELECT x::STRING FROM t"),
        ("SELECT CAST(a AS VARCHAR) AS text", "SELECT CAST(a AS STRING) AS text"),
        ("SELECT 'it''s \\n' AS \"a b\"", "SELECT 'it\\'s \\\\n' AS `a b`"),
        ("SELECT a FROM t ORDER BY a DESC, b NULLS FIRST LIMIT 3", "SELECT a FROM t ORDER BY a DESC NULLS LAST, b NULLS FIRST LIMIT 3"),
        ("SELECT * EXCLUDE (a) FROM t", "SELECT * EXCEPT (a) FROM t"),
        ("SELECT 'union_spans ORDER BY' FROM t", "SELECT 'union_spans ORDER BY' FROM t"),
        ("SELECT list(x) FROM read_parquet('/a b/c.parquet')", "SELECT transform(collect_list(struct(x AS v)), __e -> __e.v) FROM (SELECT * FROM parquet.`/a b/c.parquet`)"),
    ],
)
def test_translation(text, want):
    assert sql.translate(text) == want


def test_no_form_in_spark():
    for text in ("SELECT * FROM a POSITIONAL JOIN b", "SELECT (1"):
        with pytest.raises(sql.Unsupported):
            sql.translate(text)


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("SELECT 1 AS a", [[1]]),
        ("SELECT EXTRACT(EPOCH FROM INTERVAL '5 minutes') AS a", [[300.0]]),
        ("SELECT time_bucket(INTERVAL '7 minutes', TIMESTAMP '2024-01-01 00:10:00') AS a", [["2024-01-01T00:07:00"]]),
        ("SELECT list_transform([1, 2], lambda x: x * 2) AS a", [[[2, 4]]]),
        ("SELECT struct_pack(a := 1, b := 'x') AS s", [[{"a": 1, "b": "x"}]]),
        ("SELECT strptime('2024-05-06', '%Y-%m-%d') AS a", [["2024-05-06T00:00:00"]]),
        ("SELECT CAST(1.25 AS DECIMAL(5,2)) AS a", [["1.25"]]),
    ],
)
def test_execute(spark, text, want):
    text = text.replace("[1, 2]", "array(1, 2)")
    assert sql.execute(spark, text)["rows"] == want


def test_errors(spark):
    with pytest.raises(ValueError):
        sql.execute(spark, "  ")
    with pytest.raises(Exception, match="nowhere"):
        sql.execute(spark, "SELECT * FROM nowhere")


def test_explain_and_macro(spark):
    assert "Physical Plan" in sql.execute(spark, "EXPLAIN ANALYZE SELECT 1")["rows"][0][0]
    spark.range(5).selectExpr("concat('s', id) AS s", "id AS v").createOrReplaceTempView("macro_source")
    sql.execute(spark, "CREATE OR REPLACE MACRO of_session(sid) AS TABLE SELECT v FROM macro_source WHERE s = sid")
    assert sql.execute(spark, "SELECT * FROM of_session('s3')")["rows"] == [[3]]


def test_copy_and_read_back(spark, tmp_path):
    for kind in ("parquet", "json"):
        sql.execute(spark, f"COPY (SELECT 1 AS a, 'x' AS b) TO '{tmp_path}/{kind}' (FORMAT {kind})")
        assert sql.execute(spark, f"SELECT b FROM read_{kind}('{tmp_path}/{kind}') t WHERE t.a = 1")["rows"] == [["x"]]


def test_tables_of_users(spark):
    sql.execute(spark, "CREATE OR REPLACE TEMPORARY VIEW mine AS SELECT * FROM (VALUES (1, 'a'), (2, NULL)) v(id, name)")
    got = sql.execute(spark, "SELECT id, name FROM mine QUALIFY row_number() OVER (ORDER BY name) = 1 ORDER BY id")
    assert got == {"columns": ["id", "name"], "rows": [[1, "a"]], "row_count": 1}


def test_dashboard_macros():
    text = sql.macros("SELECT time_bucket(INTERVAL $__interval, t) FROM x WHERE $__timeFilter(t) AND d >= DATE $__timeFrom AND s = '$sid'", "5 minutes", "2024-01-01 00:00:00", "2024-01-02 00:00:00", sid="o'x")
    assert "t BETWEEN TIMESTAMP '2024-01-01 00:00:00' AND TIMESTAMP" in text and "DATE '2024-01-01'" in text and "'o''x'" in text


def test_encoding():
    assert sql.encode([None, True, 2**40, float("nan"), float("inf"), decimal.Decimal("1.10"), b"\x00", {"k": 1}]) == [None, True, 2**40, None, None, "1.10", "AA==", {"k": 1}]
    assert sql.encode(datetime.date(2024, 1, 2)) == "2024-01-02" and sql.encode(datetime.timedelta(days=1, microseconds=5)) == "months=0,days=1,nanos=5000"


SPAN = (
    "timestamp timestamp, trace_id string, span_id string, parent_span_id string, tenant_id string, app_id string, session_id string, message_type string, http_request_method string,"
    " http_request_path string, http_response_status_code int, http_response_body string, attributes map<string,string>"
)
AT = datetime.datetime(2024, 1, 1)


def spans(spark, *rows):
    base = {"timestamp": AT, "trace_id": "ab", "span_id": "cd", "parent_span_id": None, "tenant_id": "t", "app_id": "app", "session_id": "s", "message_type": "/sock", "http_request_method": None, "http_request_path": None, "http_response_status_code": None, "http_response_body": None, "attributes": {}}
    return spark.createDataFrame([tuple((base | r).values()) for r in rows], SPAN)


def test_capture(spark):
    ids = {"sp.capture.id": "c'1", "sp.tenant.id": "t"}
    df = spans(spark, {"attributes": ids}, {"attributes": ids | {"x.url.path": "/p", "http.response.status_code": "404", "sp.traffic.direction": "inbound", "url.full": "http://h/p"}, "span_id": "zz", "timestamp": AT + datetime.timedelta(1), "http_request_method": "GET"}, {"attributes": ids | {"sp.tenant.id": "other"}})
    doc = json.loads(capture.capture_json(df, "t", "c'1"))
    assert (doc["version"], doc["caseId"], doc["mode"], len(doc["traces"])) == ("1.0.0", "c'1", "capture", 2)
    first, second = (t["resourceSpans"][0]["scopeSpans"][0]["spans"][0] for t in doc["traces"])
    value = lambda span: {a["key"]: next(iter(a["value"].values())) for a in span["attributes"]}
    assert (first["traceId"], first["name"], value(first)["url.path"], value(first)["http.response.status_code"]) == ("qw==", "sp.extract", "/sock", 0)
    assert (second["spanId"], value(second)["url.path"], value(second)["url.full"]) == ("zz", "/p", "http://h/p")
    assert (value(second)["http.response.status_code"], value(second)["sp.traffic.direction"]) == (404, "outbound")
    with pytest.raises(capture.NotFound):
        capture.capture_json(df, "t", "none")


def rules(spark, *rows):
    base = {"session_id": "s", "rule_id": "r", "layer": inject.SESSION, "priority": 0, "position": 0, "direction": "", "service": "", "host": "", "method": "", "path": "", "path_prefix": "", "action": "mock", "status": 0, "headers": {}, "body": "{}"}
    return spark.createDataFrame([tuple((base | r).values()) for r in rows], inject.RULE)


def test_rules(spark):
    lookups = spans(spark, {"attributes": {"sp.span.type": "inject", "url.host": "h", "url.path": "/a/b", "http.request.method": "GET", "sp.service.name": " "}}, {"span_id": "later", "timestamp": AT + datetime.timedelta(1), "attributes": {"sp.span.type": "inject"}})
    requests = inject.requests_of(lookups)
    (r,) = requests.collect()
    assert (r.service, r.host, r.path, r.method) == ("app", "h", "/a/b", "GET")

    def best(*given, strict=True):
        policies = spark.createDataFrame([("s", strict, 0, "no rule")], "session_id string, strict boolean, status int, body string")
        (x,) = inject.respond(inject.select_rules(requests, inject.with_policies(rules(spark, *given), policies))).collect()
        return x.outcome, x.status, x.body, x.strict_miss

    low = {"rule_id": "low", "body": "low"}
    assert best(low, {"priority": 5, "body": '"text"', "status": 201}) == ("mock", 201, "text", False)
    assert best(low, {"position": 1, "layer": inject.CASE, "body": "case"}) == ("mock", 200, "low", False)
    assert best(low, {"position": 1, "body": "latest"})[2] == "latest"
    assert best({"path_prefix": "/x"}, {"method": "POST"}) == ("error", 500, "no rule", True)
    assert best({"host": "other"}, strict=False)[:2] == ("none", 404)
    assert best({"action": "passthrough", "path_prefix": "/a"})[1] == 404 and best({"action": "what"})[1] == 500


def test_catalog(spark):
    df = spans(spark, {"http_response_status_code": 200}, {"tenant_id": None}, {"message_type": ""})
    seen = catalog.extract(df, F.lit(AT))
    pairs = {(r.entity_type, r.entity_value) for r in seen.collect()}
    assert pairs == {("app_id", "app"), ("message_type", "/sock"), ("http_response_status_code", "200")}
    later = seen.withColumn("last_seen_at", F.lit(AT + datetime.timedelta(3)))
    merged = catalog.merge(seen, later.where("entity_type = 'app_id'"))
    assert merged.count() == 3 and [r.entity_type for r in catalog.entity_types(merged, "t", 1, F.lit(AT + datetime.timedelta(3))).collect()] == ["app_id"]
    assert [r.entity_value for r in catalog.entity_values(merged, "t", "message_type", 0).collect()] == ["/sock"]
    assert catalog.one_tenant(df) == "t"


def test_asof_edge_cases(spark):
    left = spark.createDataFrame([("a", 5, 1), ("a", None, 2), (None, 5, 3), ("b", 1, 4)], "k string, t int, id int")
    right = spark.createDataFrame([("a", 5, "x"), ("a", 4, "y"), ("a", 5, "z"), (None, 1, "n"), ("b", 2, "late")], "k string, u int, v string")
    got = {r.id: r.v for r in joins.asof_join(left, right, ["k"], "t", "u").collect()}
    assert got == {1: "z", 2: None, 3: None, 4: None}
    assert [r.id for r in joins.asof_join(left, right, ["k"], "t", "u", how="inner").collect()] == [1]


def test_asof_slices_carry_on(spark):
    import random

    rng = random.Random(3)
    left = spark.createDataFrame([(rng.choice("ab"), rng.randint(0, 300), i) for i in range(200)] + [(None, 5, 900), ("a", None, 901)], "k string, t int, id int")
    right = spark.createDataFrame([(rng.choice("abc"), rng.randint(0, 300), i) for i in range(40)], "k string, u int, v int")
    plain = joins.asof_join(left, right, ["k"], "t", "u")
    for width in (7.0, 1000.0):
        for how in ("left", "inner"):
            want = plain if how == "left" else plain.where("u is not null")
            assert sorted(map(repr, joins.asof_join(left, right, ["k"], "t", "u", how, slice_width=width).collect())) == sorted(map(repr, want.collect()))


def test_tokens_of_headers():
    from spanfold.operators.sessions import bearer

    assert [bearer(h) for h in ("Bearer  x ", "bearer x", "Bearer ", None)] == ["x", None, None, None]
