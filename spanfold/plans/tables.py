"""Queries of what the engine itself does: flattening, commits, waiting rows, time travel, upkeep, changes, derived tables.

Each writes tables out of all events of the driver and reads them again; its SQL asks the events themselves.
"""

from __future__ import annotations

import datetime
from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import sql
from ..functions.text import hex_to_base64
from ..operators import capture, catalog, etl, inject, joins, maintenance, sessions
from ..schema import Promotion
from ..scratch import Scratch
from ..session import prepared
from ..sources import otlp
from ..sources.lake import LakeTable
from ..streaming import ingest
from . import fixtures
from .views import Engine

#: Rows that wait in the hot buffer of these queries: the newest ones.
WAITING = 500
_MIDDLE = "2024-01-15"
_NEWEST = f"(SELECT event_id FROM events ORDER BY ts DESC, event_id DESC LIMIT {WAITING})"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepared(spark)
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def _lake(spark: SparkSession, sf_dir: str, kind: str = "spans", promotions: list[Promotion] = (), parts: list[str] | None = None, wait: bool = True) -> tuple[LakeTable, ingest.HotBuffer]:
    """A new table of all events: committed by parts (conditions), the newest rows in the buffer."""
    events = _events(spark, sf_dir)
    table = LakeTable(spark, Scratch(spark).path("lake"), kind, promotions)
    buffer = ingest.HotBuffer(table)
    newest = events.orderBy(F.desc("ts"), F.desc("event_id")).limit(WAITING).select("event_id")
    cold = events.join(newest, "event_id", "left_anti") if wait else events
    for part in parts or ["true"]:
        cold.where(part).createOrReplaceTempView("events")
        table.append(spark.sql(fixtures.SPARK[kind]))
    if wait:
        events.join(newest, "event_id", "left_semi").createOrReplaceTempView("events")
        buffer.append(spark.sql(fixtures.SPARK[kind]))
    events.createOrReplaceTempView("events")
    return table, buffer


def _text(spark: SparkSession, sf_dir: str, text: str, kind: str = "spans", **options) -> DataFrame:
    """A statement on a table with two commits and waiting rows."""
    options.setdefault("parts", [f"ts < TIMESTAMP_NTZ '{_MIDDLE}'", f"ts >= TIMESTAMP_NTZ '{_MIDDLE}'"])
    table, buffer = _lake(spark, sf_dir, kind, **options)
    as_of = _events(spark, sf_dir).agg(F.max("ts")).first()[0]
    return Engine(spark, {kind: table}, {kind: buffer}).query(text, as_of)


LAKE_TEXTS = {
    "lake_error_rate_by_app": "SELECT app_id, COUNT(*) AS n, COUNT(*) FILTER (WHERE http_response_status_code >= 500 OR status_code = 'ERROR') AS errors FROM union_spans GROUP BY app_id",
    "lake_session_spans": "SELECT span_id, http_request_path, attributes['sp.order.id'] AS order_id FROM union_spans WHERE session_id = 's-7'",
    "lake_recent_days": "SELECT record_date, COUNT(*) AS n FROM union_spans WHERE record_date >= CURRENT_DATE - 7 GROUP BY record_date",
    "lake_top_paths": "SELECT http_request_path, COUNT(*) AS n FROM union_spans WHERE http_request_path IS NOT NULL GROUP BY 1 ORDER BY n DESC, 1 LIMIT 10",
}


def lake_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = " UNION ALL ".join(f"SELECT '{t}' AS tier, COUNT(*) AS n FROM {t}_spans" for t in ("union", "committed", "buffer", "staged"))
    return _text(spark, sf_dir, text)


def lake_flushed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tiers after a flush: nothing waits and nothing is lost or doubled."""
    table, buffer = _lake(spark, sf_dir)
    engine = Engine(spark, {"spans": table}, {"spans": buffer})
    engine.flush()
    return engine.query("SELECT 'committed' AS tier, COUNT(*) AS n, COUNT(DISTINCT span_id) AS d FROM committed_spans UNION ALL SELECT 'buffer', COUNT(*), COUNT(DISTINCT span_id) FROM buffer_spans")


def lake_time_travel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the first snapshot, after a second commit."""
    table, _ = _lake(spark, sf_dir, parts=[f"ts < TIMESTAMP_NTZ '{_MIDDLE}'", f"ts >= TIMESTAMP_NTZ '{_MIDDLE}'"], wait=False)
    first = table.version(1).snapshot_id
    return Engine(spark, {"spans": table}).query(f"SELECT record_date, COUNT(*) AS n FROM iceberg_scan('s3://lake/spans', snapshot_id := {first}) GROUP BY record_date")


def lake_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    table, buffer = _lake(spark, sf_dir, parts=[f"ts < TIMESTAMP_NTZ '{_MIDDLE}'", f"ts >= TIMESTAMP_NTZ '{_MIDDLE}'"])
    buffer.flush()
    return table.snapshots().select("version", "operation", "rows_added")


def lake_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by day and the range of their times, from the list of files alone."""
    table, _ = _lake(spark, sf_dir, wait=False)
    micros = lambda x: F.unix_micros(x).alias("us")
    files = table.file_list().groupBy("record_date").agg(F.sum("rows").alias("n"), micros(F.min("first_time")).alias("first_us"), micros(F.max("last_time")).alias("last_us"))
    return files


def lake_pruned_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A session's rows from the files whose range of keys can hold it."""
    table, _ = _lake(spark, sf_dir, wait=False)
    return table.read(key="s-7").where("session_id = 's-7'").groupBy("record_date").agg(F.count("*").alias("n"))


def lake_upkeep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by day after compaction, expiry of all old snapshots and removal of unused files."""
    thirds = [f"ts < TIMESTAMP_NTZ '{_MIDDLE}'", f"ts >= TIMESTAMP_NTZ '{_MIDDLE}' AND event_type <> 'click'", f"ts >= TIMESTAMP_NTZ '{_MIDDLE}' AND event_type = 'click'"]
    table, _ = _lake(spark, sf_dir, parts=thirds, wait=False)
    maintenance.compact(table)
    late = table.version(table.generation()).snapshot_id + 10**9
    maintenance.expire_snapshots(table, keep=1, age_s=0, now_ms=late)
    maintenance.clean_files(table, delay_s=0, now_ms=late)
    versions = table.snapshots().count()
    return table.read().groupBy("record_date").agg(F.count("*").alias("n"), F.countDistinct("span_id").alias("d")).withColumn("versions", F.lit(versions))


def lake_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    table, _ = _lake(spark, sf_dir, wait=False)
    maintenance.drop_days_before(table, datetime.date.fromisoformat(_MIDDLE))
    return table.read().groupBy("record_date").agg(F.count("*").alias("n"))


def lake_replayed_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Micro-batches that come again are not committed again, even when the versions that held them have expired."""
    table = LakeTable(spark, Scratch(spark).path("lake"), "spans")
    _events(spark, sf_dir).createOrReplaceTempView("events")
    halves = [spark.sql(fixtures.SPARK["spans"]).where(f"timestamp {sign} TIMESTAMP_NTZ '{_MIDDLE}'") for sign in ("<", ">=")]
    for number, rows in enumerate(halves):
        table.append(rows, batch_id=f"stream#{number}")
    maintenance.expire_snapshots(table, keep=1, age_s=0, now_ms=table.version(2).snapshot_id + 10**9)
    for number, rows in enumerate(halves):
        table.append(rows, batch_id=f"stream#{number}")
    return table.read().groupBy("app_id").agg(F.count("*").alias("n"))


def _changed(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    table, buffer = _lake(spark, sf_dir)
    engine = Engine(spark, {"spans": table}, {"spans": buffer})
    engine.execute(text)
    return engine.query("SELECT app_id, status_code, COUNT(*) AS n FROM union_spans GROUP BY 1, 2")


def lake_promoted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attributes as typed columns, from OTLP requests to the table and back."""
    promotions = [Promotion("user.id", "user_name"), Promotion("attempt", data_type="integer"), Promotion("price", data_type="double")]
    table = LakeTable(spark, Scratch(spark).path("lake"), "spans", promotions)
    table.append(otlp.flatten_spans(_requests(spark, sf_dir, "spans"), promotions))
    return table.read().groupBy("user_name").agg(F.sum("attempt").alias("attempts"), F.round(F.sum("price"), 2).alias("price"))


# OTLP


def _kv(key: str, value: Column, kind: str = "stringValue") -> Column:
    kinds = ("stringValue", "intValue", "doubleValue", "boolValue")
    types = ("string", "string", "double", "boolean")
    return F.struct(F.lit(key).alias("key"), F.struct(*[(value if k == kind else F.lit(None)).cast(t).alias(k) for k, t in zip(kinds, types, strict=True)]).alias("value"))


def _nanos(x: Column) -> Column:
    """Nanoseconds as text, some of them below the microsecond."""
    return F.concat(F.unix_micros(x.cast("timestamp")).cast("string"), F.lit("999"))


def _requests(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """All events as OTLP requests in JSON, one a row, parsed."""
    e = _events(spark, sf_dir)
    hexes = lambda x, n: F.lpad(F.hex(x), n, "0")
    resource = F.struct(F.array(_kv("service.name", F.concat(F.lit("app-"), (F.col("user_id") % 4).cast("string"))), _kv("sp.tenant.id", F.lit("ten-1"))).alias("attributes")).alias("resource")
    user = F.concat(F.lit("user-"), F.col("user_id").cast("string"))
    if kind == "spans":
        attributes = F.array(
            _kv("user.id", F.lit("overwritten")), _kv("user.id", user), _kv("attempt", F.col("event_id") % 5, "intValue"), _kv("price", F.col("value"), "doubleValue"),
            _kv("ok", F.col("event_type") != "error", "boolValue"), _kv("http.request.method", F.lit("GET")), _kv("http.target", F.concat(F.lit("/"), F.col("event_type"))),
            _kv("http.status_code", F.when(F.col("event_type") == "error", 500).otherwise(200), "intValue"), _kv("http.request.body", F.lit("from the span")),
        )
        happened = F.array(F.struct(F.when(F.col("event_id") % 3 == 0, "http.request").otherwise("other").alias("name"), _nanos(F.col("ts")).alias("timeUnixNano"), F.array(_kv("http.request.body", F.col("props"))).alias("attributes")))
        span = F.struct(
            hexes(F.col("event_id") - F.col("event_id") % 4, 32).alias("traceId"), hexes(F.col("event_id"), 16).alias("spanId"),
            F.when(F.col("event_id") % 4 == 0, "").otherwise(hexes(F.col("event_id") - F.col("event_id") % 4, 16)).alias("parentSpanId"),
            F.col("event_type").alias("name"), F.lit("SPAN_KIND_SERVER").alias("kind"), _nanos(F.col("ts")).alias("startTimeUnixNano"), F.lit("0").alias("endTimeUnixNano"),
            attributes.alias("attributes"), happened.alias("events"),
            F.struct(F.when(F.col("event_type") == "error", "2").otherwise("STATUS_CODE_OK").alias("code"), F.lit("").alias("message")).alias("status"),
        )
        body = F.array(F.struct(resource, F.array(F.struct(F.array(span).alias("spans"))).alias("scopeSpans"))).alias("resourceSpans")
    elif kind == "logs":
        record = F.struct(
            _nanos(F.col("ts")).alias("timeUnixNano"), F.when(F.col("event_type") == "error", "17").when(F.col("event_type") == "purchase", "14").otherwise("9").alias("severityNumber"),
            F.when(F.col("event_id") % 2 == 0, "").otherwise("custom").alias("severityText"), _kv("", F.col("props"))["value"].alias("body"),
            F.array(_kv("n", F.col("event_id"), "intValue"), _kv("session.id", F.when(F.col("event_id") % 3 == 0, user))).alias("attributes"),
            F.when(F.col("event_id") % 5 == 0, hexes(F.col("event_id"), 32)).otherwise("").alias("traceId"), F.lit("").alias("spanId"),
        )
        body = F.array(F.struct(F.struct(F.array(_kv("session_id", F.lit("of the resource"))).alias("attributes")).alias("resource"), F.array(F.struct(F.array(record).alias("logRecords"))).alias("scopeLogs"))).alias("resourceLogs")
    else:
        point = lambda *more: F.array(F.struct(_nanos(F.col("ts")).alias("timeUnixNano"), *more, F.array(_kv("user", user)).alias("attributes")))
        points = lambda *more: F.struct(point(*more).alias("dataPoints"))
        only = lambda t, x: F.when(F.col("event_type") == t, x)
        metric = F.struct(
            F.concat(F.lit("m."), F.col("event_type")).alias("name"), F.lit("ms").alias("unit"),
            only("click", points(F.col("value").alias("asDouble"))).alias("gauge"), only("view", points(F.col("event_id").cast("string").alias("asInt"))).alias("sum"),
            only("error", points(F.lit("3").alias("count"), F.col("value").alias("sum"))).alias("histogram"), only("signup", points(F.lit("2").alias("count"), F.col("value").alias("sum"))).alias("summary"),
            only("purchase", points(F.lit("9").alias("count"))).alias("exponentialHistogram"),
        )
        body = F.array(F.struct(resource, F.array(F.struct(F.array(metric).alias("metrics"))).alias("scopeMetrics"))).alias("resourceMetrics")
    return otlp.parse(e.select(F.to_json(F.struct(body)).alias("value")), kind)


def _us(column: str) -> Column:
    return F.unix_micros(column)


def otlp_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = F.col("attributes")
    return otlp.flatten_spans(_requests(spark, sf_dir, "spans")).select(
        "session_id", "trace_id", "span_id", "parent_span_id", "app_id", "tenant_id", "message_type", "span_kind", _us("timestamp").alias("us"), F.col("end_timestamp").isNull().alias("open"), "status_code", "status_message",
        "http_request_method", "http_request_path", "http_request_body", "http_response_status_code", a["user.id"].alias("user_name"), a["attempt"].alias("attempt"), a["price"].alias("price"), a["ok"].alias("ok"), "record_date",
    )


OTLP_SPANS_SQL = """SELECT lower(printf('%032x', event_id - event_id % 4)) AS session_id, lower(printf('%032x', event_id - event_id % 4)) AS trace_id, lower(printf('%016x', event_id)) AS span_id,
CASE WHEN event_id % 4 <> 0 THEN lower(printf('%016x', event_id - event_id % 4)) END AS parent_span_id, 'app-' || CAST(user_id % 4 AS VARCHAR) AS app_id, 'ten-1' AS tenant_id, event_type AS message_type,
'Server' AS span_kind, epoch_us(ts) AS us, true AS open, CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'OK' END AS status_code, CAST(NULL AS VARCHAR) AS status_message, 'GET' AS http_request_method, '/' || event_type AS http_request_path,
CASE WHEN event_id % 3 = 0 THEN props ELSE 'from the span' END AS http_request_body, CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS http_response_status_code, 'user-' || CAST(user_id AS VARCHAR) AS user_name,
CAST(event_id % 5 AS VARCHAR) AS attempt, CASE WHEN value = floor(value) THEN CAST(CAST(value AS BIGINT) AS VARCHAR) ELSE CAST(value AS VARCHAR) END AS price,
CASE WHEN event_type = 'error' THEN 'false' ELSE 'true' END AS ok, CAST(ts AS DATE) AS record_date FROM events"""


def otlp_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return otlp.flatten_logs(_requests(spark, sf_dir, "logs")).select(
        "session_id", _us("timestamp").alias("us"), "severity_number", "severity_text", "body", F.col("attributes")["n"].alias("n"), F.col("resource_attributes")["session_id"].alias("resource"), "trace_id", "span_id", "record_date"
    )


OTLP_LOGS_SQL = """SELECT CASE WHEN event_id % 3 = 0 THEN 'user-' || CAST(user_id AS VARCHAR) ELSE 'of the resource' END AS session_id, epoch_us(ts) AS us,
CASE event_type WHEN 'error' THEN 17 WHEN 'purchase' THEN 14 ELSE 9 END AS severity_number,
CASE WHEN event_id % 2 <> 0 THEN 'custom' ELSE 'SEVERITY_' || CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'purchase' THEN 'WARN2' ELSE 'INFO' END END AS severity_text, props AS body,
CAST(event_id AS VARCHAR) AS n, 'of the resource' AS resource, CASE WHEN event_id % 5 = 0 THEN lower(printf('%032x', event_id)) END AS trace_id, CAST(NULL AS VARCHAR) AS span_id, CAST(ts AS DATE) AS record_date FROM events"""


def otlp_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = F.col("attributes")
    return otlp.flatten_metrics(_requests(spark, sf_dir, "metrics")).select(
        "metric_name", "description", "unit", "metric_type", _us("timestamp").alias("us"), "value", a["user"].alias("user_name"), a["count"].alias("count"), F.col("resource_attributes")["service.name"].alias("service"), "record_date"
    )


OTLP_METRICS_SQL = """SELECT 'm.' || event_type AS metric_name, '' AS description, 'ms' AS unit, CASE event_type WHEN 'click' THEN 'gauge' WHEN 'view' THEN 'sum' WHEN 'error' THEN 'histogram' ELSE 'summary' END AS metric_type,
epoch_us(ts) AS us, CASE WHEN event_type = 'view' THEN CAST(event_id AS DOUBLE) ELSE value END AS value, 'user-' || CAST(user_id AS VARCHAR) AS user_name,
CASE event_type WHEN 'error' THEN '3' WHEN 'signup' THEN '2' END AS count, 'app-' || CAST(user_id % 4 AS VARCHAR) AS service, CAST(ts AS DATE) AS record_date FROM events WHERE event_type <> 'purchase'"""


def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of requests, streamed into a table in several micro-batches; a second run finds nothing new."""
    scratch = Scratch(spark)
    source, checkpoint = scratch.path("requests"), scratch.path("checkpoint")
    name = "resourceLogs"
    _requests(spark, sf_dir, "logs").select(F.to_json(F.struct(name)).alias("value")).repartition(4).write.text(source)
    table = LakeTable(spark, scratch.path("lake"), "logs")
    for _ in range(2):
        ingest.stream_to_lake(spark, "logs", source, table, checkpoint, trigger={"availableNow": True}, maxFilesPerTrigger="2").awaitTermination()
    return table.read().groupBy("severity_number", "record_date").agg(F.count("*").alias("n"))


# Captures, rules, the value catalog, sessions


def capture_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole JSON document of a capture."""
    rows = fixtures.frame(spark, sf_dir, "spans")
    return capture.export(rows, "ten-2", "cap-5", F.lit("2024-02-01 00:00:00").cast("timestamp"))


_PAIR = """'{"key":"' || k || '","value":{"stringValue":' || CAST(to_json(v) AS VARCHAR) || '}}'"""
CAPTURE_SQL = f"""WITH s AS (SELECT *, coalesce(http_request_path, '') AS p FROM union_spans WHERE attributes['sp.capture.id'] = 'cap-5' AND attributes['sp.tenant.id'] = 'ten-2')
SELECT '{{"version":"1.0.0","caseId":"cap-5","captureId":"cap-5","mode":"capture","createdAt":"2024-02-01T00:00:00.000000Z","traces":[' || string_agg(
'{{"resourceSpans":[{{"scopeSpans":[{{"spans":[{{"traceId":"' || trace_id || '","spanId":"' || span_id || '","parentSpanId":"' || coalesce(parent_span_id, '') || '","name":"sp.extract","attributes":[' ||
array_to_string([{", ".join(_PAIR.replace(" k ", f" {k!r} ").replace("to_json(v)", f"to_json({v})") for k, v in (("sp.span.type", "'extract'"), ("sp.traffic.direction", "'outbound'"), ("http.request.method", "http_request_method"), ("url.path", "p"), ("url.full", "p"), ("http.response.body", "coalesce(http_response_body, '')")))},
'{{"key":"http.response.status_code","value":{{"intValue":' || CAST(http_response_status_code AS VARCHAR) || '}}}}', {_PAIR.replace(" k ", " 'message.type' ").replace("to_json(v)", "to_json(message_type)")}], ',')
|| ']}}]}}]}}]}}', ',' ORDER BY timestamp, span_id) || ']}}' AS document FROM s"""


def _catalog_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalog after two runs: the first saw the spans before the middle of the month, the second the later ones."""
    rows = fixtures.frame(spark, sf_dir, "spans")
    skipped = ("http_request_body", "http_response_body", "http_request_headers", "http_response_headers")
    seen = lambda condition, at: catalog.extract(rows.where(condition), F.lit(at).cast("timestamp"), skipped)
    first = catalog.merge(seen("false", _MIDDLE), seen(f"record_date < DATE '{_MIDDLE}'", _MIDDLE))
    return catalog.merge(first, seen(f"record_date >= DATE '{_MIDDLE}' AND http_request_method = 'GET'", "2024-02-01"))


_SEEN = " UNION ALL ".join(
    f"SELECT tenant_id, '{c}' AS entity_type, CAST({c} AS VARCHAR) AS entity_value, CASE WHEN record_date < DATE '{_MIDDLE}' THEN '{_MIDDLE}' ELSE '2024-02-01' END AS seen FROM union_spans"
    f" WHERE (record_date < DATE '{_MIDDLE}' OR http_request_method = 'GET')"
    for c in ("app_id", "message_type", "span_kind", "status_code", "http_request_method", "http_request_path", "http_response_status_code")
)


def catalog_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _catalog_days(spark, sf_dir).select("tenant_id", "entity_type", "entity_value", F.date_format("last_seen_at", "yyyy-MM-dd").alias("seen"))


def catalog_recent_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenant's values of one column, the last seen first, with their places."""
    found = catalog.entity_values(_catalog_days(spark, sf_dir), "ten-1", "message_type")
    ordered = found.agg(F.transform(F.array_sort(F.collect_list(F.struct(-F.unix_seconds("last_seen_at"), "entity_value"))), lambda x: x["entity_value"]).alias("v"))
    return ordered.select(F.posexplode("v").alias("place", "entity_value")).join(found.select("entity_value", F.date_format("last_seen_at", "yyyy-MM-dd").alias("seen")), "entity_value")


def catalog_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = F.lit("2024-02-01").cast("timestamp")
    return catalog.entity_types(maintenance.prune_catalog(_catalog_days(spark, sf_dir), 7, now), "ten-1", 7, now)


def _lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixtures.frame(spark, sf_dir, "spans")
    given = F.create_map(
        F.lit("sp.span.type"), F.when(F.col("message_type") == "click", "inject"), F.lit("url.host"), F.lit("h"), F.lit("http.method"), F.lit("GET"),
        F.lit("url.path"), F.concat(F.lit("/a/"), F.col("message_type")), F.lit("sp.service.name"), F.when(F.substring("span_id", -1, 1) == "1", " ").otherwise("svc"),
    )
    return inject.requests_of(rows.withColumn("attributes", given))


def inject_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lookups(spark, sf_dir)


_FIRST_CLICK = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY timestamp, span_id) AS n FROM union_spans WHERE message_type = 'click') x WHERE n = 1)"
INJECT_REQUESTS_SQL = f"""SELECT trace_id AS request_id, session_id, '' AS direction, CASE WHEN right(span_id, 1) = '1' THEN app_id ELSE 'svc' END AS service, 'h' AS host, 'GET' AS method, '/a/click' AS path FROM {_FIRST_CLICK} c"""


def inject_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers by rules of three kinds and a strict policy of every third session."""
    users = _events(spark, sf_dir).select("user_id").distinct()
    name = F.concat(F.lit("s-"), F.col("user_id").cast("string"))
    blank = {f: F.lit("") for f in ("direction", "host", "method", "path")}
    kinds = F.when(F.col("user_id") % 4 == 0, "mock").when(F.col("user_id") % 4 == 1, "error").otherwise("passthrough")
    rules = users.where("user_id % 5 <> 0").select(
        name.alias("session_id"), F.lit("r").alias("rule_id"), F.lit(inject.SESSION).alias("layer"), F.lit(1).alias("priority"), F.lit(0).alias("position"), *[v.alias(k) for k, v in blank.items()],
        F.lit("svc").alias("service"), F.lit("/a").alias("path_prefix"), kinds.alias("action"), F.when(F.col("user_id") % 8 == 0, 201).otherwise(0).alias("status"),
        F.lit(None).cast("map<string,string>").alias("headers"), F.when(F.col("user_id") % 3 == 0, '"text"').otherwise('{"a": 1}').alias("body"),
    )
    policies = users.select(name.alias("session_id"), (F.col("user_id") % 3 == 0).alias("strict"), F.lit(0).alias("status"), F.lit("no rule").alias("body"))
    return inject.respond(inject.select_rules(_lookups(spark, sf_dir), inject.with_policies(rules, policies)))


INJECT_RESPONSES_SQL = f"""WITH q AS (SELECT trace_id AS request_id, CAST(substr(session_id, 3) AS BIGINT) AS u, right(span_id, 1) = '1' AS other FROM {_FIRST_CLICK} c),
r AS (SELECT *, u % 5 <> 0 AND NOT other AS ruled, u % 3 = 0 AS strict FROM q)
SELECT request_id, CASE WHEN ruled THEN CASE u % 4 WHEN 0 THEN 'mock' WHEN 1 THEN 'error' ELSE 'passthrough' END WHEN strict THEN 'error' ELSE 'none' END AS outcome,
CAST(CASE WHEN ruled THEN CASE u % 4 WHEN 0 THEN CASE WHEN u % 8 = 0 THEN 201 ELSE 200 END WHEN 1 THEN CASE WHEN u % 8 = 0 THEN 201 ELSE 500 END ELSE 404 END WHEN strict THEN 500 ELSE 404 END AS INTEGER) AS status,
CASE WHEN ruled AND u % 4 < 2 THEN CASE WHEN u % 3 = 0 THEN 'text' ELSE '{{"a": 1}}' END WHEN NOT ruled AND strict THEN 'no rule' END AS body,
CASE WHEN ruled THEN false WHEN strict THEN true END AS strict_miss FROM r"""


def session_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions as documents, events being their changes, and which of them are alive at the end of the month."""
    kind = F.create_map(*[F.lit(x) for x in ("click", "rules", "view", "policy", "purchase", "extracted_spans", "error", "strict_misses", "signup", "close")])
    changes = _events(spark, sf_dir).select(
        F.lit("t").alias("tenant_id"), F.col("user_id").cast("string").alias("session_id"), F.struct("ts", "event_id").alias("at"), kind[F.col("event_type")].alias("kind"), F.col("event_id").cast("string").alias("body"), F.lit(2).alias("amount")
    )
    found = sessions.documents(changes).withColumn("changed_at", F.col("changed_at.ts"))
    alive = sessions.alive(found, F.lit("2024-01-31").cast("timestamp"), tenant_id="t").select("session_id", F.lit(True).alias("alive"))
    return found.join(alive, "session_id", "left").select("session_id", "rules", "policy", "revision", "extracted_spans", "strict_misses", "closed", F.coalesce("alive", F.lit(False)).alias("alive"))


SESSIONS_SQL = """WITH c AS (SELECT user_id, arg_max(CAST(event_id AS VARCHAR), row(ts, event_id)) FILTER (WHERE event_type = 'click') AS rules, arg_max(CAST(event_id AS VARCHAR), row(ts, event_id)) FILTER (WHERE event_type = 'view') AS policy,
count(*) FILTER (WHERE event_type IN ('click', 'view')) AS revision, 2 * count(*) FILTER (WHERE event_type = 'purchase') AS extracted_spans, 2 * count(*) FILTER (WHERE event_type = 'error') AS strict_misses,
arg_max(event_type, row(ts, event_id)) = 'signup' AS closed, max(ts) AS changed FROM events GROUP BY user_id)
SELECT CAST(user_id AS VARCHAR) AS session_id, rules, policy, revision, extracted_spans, strict_misses, closed, NOT closed AND changed > TIMESTAMP '2024-01-30 00:00:00' AS alive FROM c"""


def tenant_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    header = F.when(F.col("user_id") % 3 == 0, F.concat(F.lit("Bearer  k"), (F.col("user_id") % 2).cast("string"))).when(F.col("user_id") % 3 == 1, "Bearer other")
    tokens = spark.createDataFrame([("k0", "even"), ("k1", "odd")], "token string, tenant_id string")
    return sessions.with_tenants(e.select("event_id", header.alias("authorization")), tokens).select("event_id", "tenant_id", "status")


# Derived tables, files, macros


def macro_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A session's spans and logs by a table macro."""
    fixtures.tables(spark, sf_dir)
    sql.query(spark, """CREATE OR REPLACE MACRO verify_session(sid) AS TABLE WITH a AS (SELECT 'trace' AS type, session_id, trace_id, span_id, message_type AS content, timestamp, record_date FROM traces WHERE session_id = sid),
b AS (SELECT 'log' AS type, session_id, trace_id, span_id, body AS content, timestamp, record_date FROM logs WHERE session_id = sid) SELECT * FROM a UNION ALL SELECT * FROM b""")  # fmt: skip
    return sql.query(spark, "SELECT * FROM verify_session('s-7') ORDER BY timestamp, type, content")


MACRO_SQL = """SELECT 'trace' AS type, session_id, trace_id, span_id, message_type AS content, timestamp, record_date FROM traces WHERE session_id = 's-7'
UNION ALL SELECT 'log', session_id, trace_id, span_id, body, timestamp, record_date FROM logs WHERE session_id = 's-7'"""


def table_as_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CREATE OR REPLACE TABLE … AS, INSERT INTO … SELECT and CREATE VIEW, read again."""
    import atexit
    import uuid

    fixtures.tables(spark, sf_dir)
    name = f"wide_{uuid.uuid4().hex[:12]}"
    atexit.register(lambda: spark.getActiveSession() and spark.sql(f"DROP TABLE IF EXISTS {name}"))
    text = "SELECT session_id, json_extract_string(http_request_body, '$.k')::INTEGER AS k FROM traces WHERE http_request_path LIKE '/api/{}%'"
    sql.query(spark, f"CREATE OR REPLACE TABLE {name} AS " + text.format("view"))
    sql.query(spark, f"CREATE OR REPLACE TABLE {name} AS " + text.format("purch"))
    sql.query(spark, f"INSERT INTO {name} " + text.format("err"))
    sql.query(spark, f"CREATE OR REPLACE TEMPORARY VIEW {name}_v AS SELECT session_id, COUNT(*) AS n, SUM(k) AS total FROM {name} GROUP BY session_id")
    return sql.query(spark, f"SELECT * FROM {name}_v")


TABLE_SQL = """SELECT session_id, COUNT(*) AS n, CAST(SUM(CAST(json_extract_string(http_request_body, '$.k') AS INTEGER)) AS BIGINT) AS total FROM traces
WHERE http_request_path LIKE '/api/purch%' OR http_request_path LIKE '/api/err%' GROUP BY session_id"""


def incremental_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The business index, built of the first half of the month and then brought up to date, twice."""
    rows = fixtures.frame(spark, sf_dir, "spans").withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    path = Scratch(spark).path("index")
    for source in (rows.where(f"record_date < DATE '{_MIDDLE}'"), rows, rows):
        etl.append_newer(etl.business_index(source, {"k": "$.k"}), path)
    return etl.read(spark, path).select("session_id", "trace_id", "span_id", "k", F.col("record_date").cast("date").alias("record_date"))


def file_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """COPY … TO in three formats, and the readers on what was written."""
    fixtures.tables(spark, sf_dir)
    scratch = Scratch(spark)
    texts = []
    for kind in ("parquet", "json", "csv"):
        path = scratch.path(kind)
        options = "FORMAT " + kind
        if kind == "csv":
            spark.sql("SELECT event_id, event_type, value FROM events").write.csv(path, header=True)
        else:
            sql.query(spark, f"COPY (SELECT event_id, event_type, value FROM events) TO '{path}' ({options})")
        texts.append(f"SELECT '{kind}' AS kind, COUNT(*) AS n, SUM(event_id)::BIGINT AS ids, ROUND(SUM(value), 2) AS total FROM read_{kind}('{path}')")
    return sql.query(spark, " UNION ALL ".join(texts))


FILES_SQL = "SELECT k.kind, COUNT(*) AS n, CAST(SUM(event_id) AS BIGINT) AS ids, ROUND(SUM(value), 2) AS total FROM events CROSS JOIN (VALUES ('parquet'), ('json'), ('csv')) k(kind) GROUP BY 1"


def dashboard_macros(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .queries import run_text

    return run_text(spark, sf_dir, DASHBOARD)


DASHBOARD = sql.macros(
    "SELECT time_bucket(INTERVAL $__interval, timestamp) AS time, COUNT(*) AS n FROM committed_spans WHERE $__timeFilter(timestamp) AND record_date >= DATE $__timeFrom AND record_date <= DATE $__timeTo"
    " AND app_id = '$app' GROUP BY 1",
    "6 hours", "2024-01-05 00:00:00", "2024-01-12 00:00:00", app="app-1",
)


def approximations_close(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the sketches are within 5 % of the exact counts and 2 % of the exact ranks."""
    from .queries import run_text

    return run_text(
        spark, sf_dir,
        """SELECT event_type, abs(users - exact_users) <= 0.05 * exact_users AS users_close, p95 >= low AND p95 <= high AS p95_close FROM (SELECT event_type, approx_count_distinct(user_id) AS users, COUNT(DISTINCT user_id) AS exact_users,
approx_quantile(value, 0.95) AS p95, quantile_cont(value, 0.93) AS low, quantile_cont(value, 0.97) AS high FROM events GROUP BY event_type) x""",
    )


def p95_latency_approx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dashboard's approximate percentile by day, and whether it lies between the exact ones on either side."""
    from .queries import run_text

    ms = "EXTRACT(EPOCH FROM (end_timestamp - timestamp)) * 1000"
    return run_text(
        spark, sf_dir,
        f"""SELECT time, p95 >= low AND p95 <= high AS close FROM (SELECT time_bucket(INTERVAL '1 day', timestamp) AS time, approx_quantile({ms}, 0.95) AS p95, quantile_disc({ms}, 0.93) AS low, quantile_disc({ms}, 0.97) AS high
FROM committed_spans WHERE end_timestamp IS NOT NULL GROUP BY time) x""",
    )


def asof_hot_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each error with the last purchase of anybody: one key, dealt by slices of time."""
    e = _events(spark, sf_dir).withColumn("k", F.lit(1))
    left = e.where("event_type = 'error'").select("k", "event_id", "ts")
    right = e.where("event_type = 'purchase'").select("k", F.col("ts").alias("bought_at"), F.col("event_id").alias("bought"))
    right = right.groupBy("k", "bought_at").agg(F.max("bought").alias("bought"))
    return joins.asof_join(left, right, ["k"], "ts", "bought_at", slice_width=6 * 3600.0).select("event_id", "bought")


ASOF_HOT_SQL = """SELECT l.event_id, r.bought FROM (SELECT 1 AS k, event_id, ts FROM events WHERE event_type = 'error') l
ASOF LEFT JOIN (SELECT 1 AS k, ts, max(event_id) AS bought FROM events WHERE event_type = 'purchase' GROUP BY ts) r ON l.k = r.k AND l.ts >= r.ts"""


def ids_as_base64(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    return e.select("event_id", hex_to_base64(F.lpad(F.hex("event_id"), 16, "0")).alias("b64"), hex_to_base64(F.col("event_type")).alias("as_is"))


_BY_DAY = "SELECT CAST(ts AS DATE) AS record_date, count(*) AS n FROM events{} GROUP BY 1"
_HALF = f"ts {{}} TIMESTAMP '{_MIDDLE} 00:00:00'"

OPERATORS: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    **{name: (partial(_text, text=text), text) for name, text in LAKE_TEXTS.items()},
    "lake_tiers": (lake_tiers, f"SELECT 'union' AS tier, count(*) AS n FROM events UNION ALL SELECT 'committed', greatest(count(*) - {WAITING}, 0) FROM events UNION ALL SELECT 'buffer', least(count(*), {WAITING}) FROM events UNION ALL SELECT 'staged', 0"),
    "lake_flushed": (lake_flushed, "SELECT 'committed' AS tier, count(*) AS n, count(*) AS d FROM events UNION ALL SELECT 'buffer', 0, 0"),
    "lake_time_travel": (lake_time_travel, _BY_DAY.format(" WHERE " + _HALF.format("<"))),
    "lake_snapshots": (
        lake_snapshots,
        f"SELECT v AS version, 'append' AS operation, CAST(n AS BIGINT) AS rows_added FROM (SELECT 1 AS v, count(*) AS n FROM events WHERE {_HALF.format('<')} AND event_id NOT IN {_NEWEST}"
        f" UNION ALL SELECT 2, count(*) FROM events WHERE {_HALF.format('>=')} AND event_id NOT IN {_NEWEST} UNION ALL SELECT 3, count(*) FROM {_NEWEST} x) y",
    ),
    "lake_files": (lake_files, "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS record_date, count(*) AS n, epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us FROM events GROUP BY 1"),
    "lake_pruned_key": (lake_pruned_key, _BY_DAY.format(" WHERE user_id = 7")),
    "lake_upkeep": (lake_upkeep, "SELECT CAST(ts AS DATE) AS record_date, count(*) AS n, count(*) AS d, 1 AS versions FROM events GROUP BY 1"),
    "lake_retention": (lake_retention, _BY_DAY.format(" WHERE " + _HALF.format(">="))),
    "lake_replayed_batch": (lake_replayed_batch, "SELECT 'app-' || CAST(user_id % 4 AS VARCHAR) AS app_id, count(*) AS n FROM events GROUP BY 1"),
    "lake_delete": (
        partial(_changed, text="DELETE FROM spans WHERE status_code = 'ERROR' AND record_date < DATE '2024-01-20'"),
        "SELECT app_id, status_code, COUNT(*) AS n FROM union_spans WHERE NOT (status_code = 'ERROR' AND record_date < DATE '2024-01-20') GROUP BY 1, 2",
    ),
    "lake_update": (
        partial(_changed, text="UPDATE spans SET app_id = 'merged', status_code = lower(status_code) WHERE app_id IN ('app-0', 'app-1')"),
        "SELECT app_id, status_code, COUNT(*) AS n FROM (SELECT CASE WHEN app_id IN ('app-0', 'app-1') THEN 'merged' ELSE app_id END AS app_id, CASE WHEN app_id IN ('app-0', 'app-1') THEN lower(status_code) ELSE status_code END AS status_code FROM union_spans) u GROUP BY 1, 2",
    ),
    "lake_promoted": (lake_promoted, "SELECT 'user-' || CAST(user_id AS VARCHAR) AS user_name, CAST(sum(event_id % 5) AS BIGINT) AS attempts, round(sum(value), 2) AS price FROM events GROUP BY 1"),
    "otlp_spans": (otlp_spans, OTLP_SPANS_SQL),
    "otlp_logs": (otlp_logs, OTLP_LOGS_SQL),
    "otlp_metrics": (otlp_metrics, OTLP_METRICS_SQL),
    "stream_ingest": (stream_ingest, "SELECT CASE event_type WHEN 'error' THEN 17 WHEN 'purchase' THEN 14 ELSE 9 END AS severity_number, CAST(ts AS DATE) AS record_date, count(*) AS n FROM events GROUP BY 1, 2"),
    "capture_document": (capture_document, CAPTURE_SQL),
    "catalog_upsert": (catalog_upsert, f"SELECT tenant_id, entity_type, entity_value, max(seen) AS seen FROM ({_SEEN}) x WHERE entity_value <> '' GROUP BY 1, 2, 3"),
    "catalog_recent_values": (
        catalog_recent_values,
        f"SELECT CAST(row_number() OVER (ORDER BY seen DESC, entity_value) - 1 AS INTEGER) AS place, entity_value, seen FROM (SELECT entity_value, max(seen) AS seen FROM ({_SEEN}) x WHERE tenant_id = 'ten-1' AND entity_type = 'message_type' GROUP BY 1) y",
    ),
    "catalog_pruned": (catalog_pruned, f"SELECT DISTINCT entity_type FROM ({_SEEN}) x WHERE tenant_id = 'ten-1' AND seen = '2024-02-01' AND entity_value <> ''"),
    "inject_requests": (inject_requests, INJECT_REQUESTS_SQL),
    "inject_responses": (inject_responses, INJECT_RESPONSES_SQL),
    "session_documents": (session_documents, SESSIONS_SQL),
    "tenant_requests": (
        tenant_requests,
        "SELECT event_id, CASE WHEN user_id % 3 = 0 THEN CASE user_id % 2 WHEN 0 THEN 'even' ELSE 'odd' END END AS tenant_id, CASE user_id % 3 WHEN 0 THEN 200 WHEN 1 THEN 403 ELSE 401 END AS status FROM events",
    ),
    "macro_session": (macro_session, MACRO_SQL),
    "table_as_select": (table_as_select, TABLE_SQL),
    "incremental_index": (incremental_index, "SELECT session_id, trace_id, span_id, json_extract_string(http_request_body, '$.k') AS k, record_date FROM traces"),
    "file_formats": (file_formats, FILES_SQL),
    "dashboard_macros": (dashboard_macros, DASHBOARD),
    "approximations_close": (approximations_close, "SELECT DISTINCT event_type, true AS users_close, true AS p95_close FROM events"),
    "p95_latency_approx": (p95_latency_approx, "SELECT DISTINCT date_trunc('day', timestamp) AS time, true AS close FROM committed_spans WHERE end_timestamp IS NOT NULL"),
    "asof_hot_key": (asof_hot_key, ASOF_HOT_SQL),
    "ids_as_base64": (ids_as_base64, "SELECT event_id, to_base64(from_hex(printf('%016X', event_id))) AS b64, event_type AS as_is FROM events"),
}
