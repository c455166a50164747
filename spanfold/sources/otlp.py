"""OTLP requests in JSON, flattened to rows of the three tables by column expressions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import plain_double, strict, strict_int
from ..schema import LOGS, METRICS, TRACES, Promotion, with_promotions

# The wire format. Scalars are declared as text, since senders write numbers both bare and quoted.
_VALUE = "struct<stringValue:string,intValue:string,doubleValue:string,boolValue:string>"
_KEYS = f"array<struct<key:string,value:{_VALUE}>>"
_RESOURCE = f"resource:struct<attributes:{_KEYS}>"
_EVENT = f"struct<timeUnixNano:string,name:string,attributes:{_KEYS}>"
_SPAN = (
    "struct<traceId:string,spanId:string,parentSpanId:string,name:string,kind:string,startTimeUnixNano:string,"
    f"endTimeUnixNano:string,attributes:{_KEYS},events:array<{_EVENT}>,status:struct<code:string,message:string>>"
)
_RECORD = (
    f"struct<timeUnixNano:string,observedTimeUnixNano:string,severityNumber:string,severityText:string,body:{_VALUE},"
    f"attributes:{_KEYS},traceId:string,spanId:string>"
)
_NUMBER = f"array<struct<timeUnixNano:string,asDouble:string,asInt:string,attributes:{_KEYS}>>"
_SUMMED = f"array<struct<timeUnixNano:string,count:string,sum:double,attributes:{_KEYS}>>"
_METRIC = (
    f"struct<name:string,description:string,unit:string,gauge:struct<dataPoints:{_NUMBER}>,sum:struct<dataPoints:{_NUMBER}>,"
    f"histogram:struct<dataPoints:{_SUMMED}>,summary:struct<dataPoints:{_SUMMED}>>"
)
SCHEMAS = {
    "spans": f"resourceSpans array<struct<{_RESOURCE},scopeSpans:array<struct<spans:array<{_SPAN}>>>>>",
    "logs": f"resourceLogs array<struct<{_RESOURCE},scopeLogs:array<struct<logRecords:array<{_RECORD}>>>>>",
    "metrics": f"resourceMetrics array<struct<{_RESOURCE},scopeMetrics:array<struct<metrics:array<{_METRIC}>>>>>",
}
_KINDS = ["Unspecified", "Internal", "Server", "Client", "Producer", "Consumer"]
_KIND_NAMES = ["UNSPECIFIED", "INTERNAL", "SERVER", "CLIENT", "PRODUCER", "CONSUMER"]
_STATUS = ["UNSET", "OK", "ERROR"]
_LEVELS = ["TRACE", "DEBUG", "INFO", "WARN", "ERROR", "FATAL"]


def read(spark: SparkSession, kind: str, path: str) -> DataFrame:
    """Requests of one kind (spans, logs, metrics), a JSON document each; compressed files are read by their suffix."""
    return spark.read.schema(SCHEMAS[kind]).option("mode", "FAILFAST").json(path)


def read_stream(spark: SparkSession, kind: str, path: str, **options: str) -> DataFrame:
    return spark.readStream.schema(SCHEMAS[kind]).options(**options).json(path)


def parse(requests: DataFrame, kind: str, column: str = "value") -> DataFrame:
    """Requests from a text column; malformed ones raise."""
    name = SCHEMAS[kind].split(" ", 1)[0]
    parsed = F.from_json(column, SCHEMAS[kind], {"mode": "FAILFAST"})
    return requests.select(parsed[name].alias(name))


def scalar(value: Column) -> Column:
    """A scalar's text; lists, maps and bytes have none."""
    return F.coalesce(value["stringValue"], value["intValue"], plain_double(value["doubleValue"]), value["boolValue"])


def _named(**fields: Column) -> Column:
    """A struct; inside lambdas, aliases of some expressions are lost."""
    return F.named_struct(*[x for name, value in fields.items() for x in (F.lit(name), value)])


def attribute_map(pairs: Column) -> Column:
    """The scalar attributes; the last of repeated keys counts (the session's LAST_WIN)."""
    entries = F.transform(F.coalesce(pairs, F.array().cast(_KEYS)), lambda p: _named(key=p["key"], value=scalar(p["value"])))
    return F.map_from_entries(F.filter(entries, lambda e: e["key"].isNotNull() & e["value"].isNotNull()))


def _micros(nanos: Column) -> Column:
    return F.timestamp_micros(F.floor(nanos.cast("decimal(20,0)") / 1000).cast("long"))


def _time(nanos: Column, otherwise: Column) -> Column:
    """Nanoseconds since 1970, cut to microseconds; 0 and missing give ``otherwise``."""
    return F.when(F.coalesce(nanos.cast("decimal(20,0)"), F.lit(0)) > 0, _micros(nanos)).otherwise(otherwise)


def _name_of(code: Column, names: list[str], labels: list[str], prefix: str) -> Column:
    """An enum's label from its number or its wire name; null stays null."""
    found = F.lit(None).cast("string")
    for i, (name, label) in enumerate(zip(names, labels, strict=True)):
        found = F.when(code.isin(str(i), name, prefix + name), F.lit(label)).otherwise(found)
    return F.when(code.isNull(), F.lit(None).cast("string")).otherwise(F.coalesce(found, F.lit(labels[0])))


def _blank_null(x: Column) -> Column:
    return F.when(x != "", x)


def _promoted(promotions: list[Promotion], attributes: Column, resource: Column) -> list[Column]:
    return [strict((resource if p.source == "resource_attributes" else attributes)[p.attribute_key], p.data_type).alias(p.column) for p in promotions]


def _is_scalar(p: Column) -> Column:
    return p["value"].isNull() | scalar(p["value"]).isNotNull()


def flatten_spans(requests: DataFrame, promotions: list[Promotion] = (), tenant_id: str | None = None, capture_id: str | None = None) -> DataFrame:
    """Rows of the span table. ``tenant_id`` and ``capture_id`` are added to resources and spans, as a host would.

    The session is ``sp.session.id`` or else the trace. Headers and bodies come from the first ``http.request`` and
    ``http.response`` events, else from the span's attributes. An event with an attribute that is no scalar is dropped.
    """
    added = F.create_map(*[F.lit(x) for k, v in (("sp.capture.id", capture_id), ("sp.tenant.id", tenant_id)) if v for x in (k, v)]) if tenant_id or capture_id else None
    resource = attribute_map(F.col("r.resource.attributes"))
    rows = requests.select(F.explode("resourceSpans").alias("r")).select((F.map_concat(resource, added) if added is not None else resource).alias("res"), F.explode("r.scopeSpans").alias("sc"))
    rows = rows.select("res", F.explode("sc.spans").alias("s"))
    own = attribute_map(F.col("s.attributes"))
    rows = rows.select("res", "s", (F.map_concat(own, added) if added is not None else own).alias("a"), F.lower("s.traceId").alias("trace"))
    now = F.current_timestamp()
    whole = F.filter(F.coalesce("s.events", F.array().cast(f"array<{_EVENT}>")), lambda e: F.forall(F.coalesce(e["attributes"], F.array().cast(_KEYS)), _is_scalar))
    events = F.transform(whole, lambda e: _named(name=F.coalesce(e["name"], F.lit("")), timestamp=_time(e["timeUnixNano"], now), attributes=attribute_map(e["attributes"])))
    rows = rows.withColumn("ev", events)
    a = lambda k: F.col("a")[k]
    event = lambda name, k: F.get(F.filter("ev", lambda e: e["name"] == name), F.lit(0))["attributes"][k]
    http = lambda side, part: F.coalesce(event(f"http.{side}", f"http.{side}.{part}"), a(f"http.{side}.{part}"))
    status = a("http.response.status_code")
    start = _time(F.col("s.startTimeUnixNano"), now)
    columns = {
        "session_id": F.coalesce(a("sp.session.id"), F.col("trace")),
        "trace_id": F.col("trace"),
        "span_id": F.lower("s.spanId"),
        "parent_span_id": _blank_null(F.lower("s.parentSpanId")),
        "app_id": F.coalesce(F.col("res")["sp.app.id"], F.col("res")["service.name"], F.lit("unknown")),
        "organization_id": F.col("res")["sp.organization.id"],
        "tenant_id": F.col("res")["sp.tenant.id"],
        "message_type": F.coalesce("s.name", F.lit("")),
        "span_kind": _name_of(F.coalesce("s.kind", F.lit("0")), _KIND_NAMES, _KINDS, "SPAN_KIND_"),
        "timestamp": start,
        "end_timestamp": _time(F.col("s.endTimeUnixNano"), F.lit(None).cast("timestamp")),
        "attributes": F.col("a"),
        "events": F.col("ev"),
        "status_code": F.when(F.col("s.status").isNotNull(), _name_of(F.coalesce("s.status.code", F.lit("0")), _STATUS, _STATUS, "STATUS_CODE_")),
        "status_message": _blank_null(F.col("s.status.message")),
        "http_request_method": a("http.request.method"),
        "http_request_path": F.coalesce(a("http.request.path"), a("http.target")),
        "http_request_headers": http("request", "headers"),
        "http_request_body": http("request", "body"),
        "http_response_status_code": F.when(status.isNotNull(), strict_int(status)).otherwise(strict_int(a("http.status_code"))),
        "http_response_headers": http("response", "headers"),
        "http_response_body": http("response", "body"),
        "record_date": F.to_date(start),
    }
    assert list(columns) == TRACES.fieldNames()
    return rows.select(*[c.alias(n) for n, c in columns.items()], *_promoted(list(promotions), F.col("a"), F.col("res")))


def flatten_logs(requests: DataFrame, promotions: list[Promotion] = ()) -> DataFrame:
    """Rows of the log table. The session is the record's first ``session.id``, ``session_id`` or ``sp.session.id``
    that is a text, in the record's own order, else the resource's, in that order of names."""
    rows = requests.select(F.explode("resourceLogs").alias("r")).select(F.col("r.resource.attributes").alias("rp"), F.explode("r.scopeLogs").alias("sc"))
    rows = rows.select("rp", F.explode("sc.logRecords").alias("l")).select("rp", "l", attribute_map(F.col("l.attributes")).alias("a"), attribute_map(F.col("rp")).alias("res"))
    names = ["session.id", "session_id", "sp.session.id"]
    text_of = lambda pairs, *keys: F.get(F.filter(F.coalesce(pairs, F.array().cast(_KEYS)), lambda p: p["key"].isin(*keys) & p["value"]["stringValue"].isNotNull()), F.lit(0))["value"]["stringValue"]
    number = F.coalesce(F.col("l.severityNumber").try_cast("int"), F.lit(0))
    level = (number - 1).cast("int")
    label = F.when(number.between(1, 24), F.concat(F.element_at(F.array(*map(F.lit, _LEVELS)), F.floor(level / 4).cast("int") + 1), F.when(level % 4 > 0, (level % 4 + 1).cast("string")).otherwise(""))).otherwise("UNSPECIFIED")
    start = _time(F.col("l.timeUnixNano"), F.current_timestamp())
    columns = {
        "session_id": F.coalesce(text_of(F.col("l.attributes"), *names), *[text_of(F.col("rp"), n) for n in names]),
        "timestamp": start,
        "observed_timestamp": _time(F.col("l.observedTimeUnixNano"), F.lit(None).cast("timestamp")),
        "severity_number": number,
        "severity_text": F.coalesce(_blank_null(F.col("l.severityText")), F.concat(F.lit("SEVERITY_"), label)),
        "body": F.coalesce(scalar(F.col("l.body")), F.lit("")),
        "attributes": F.col("a"),
        "resource_attributes": F.col("res"),
        "trace_id": _blank_null(F.lower("l.traceId")),
        "span_id": _blank_null(F.lower("l.spanId")),
        "record_date": F.to_date(start),
    }
    assert list(columns) == LOGS.fieldNames()
    return rows.select(*[c.alias(n) for n, c in columns.items()], *_promoted(list(promotions), F.col("a"), F.col("res")))


def flatten_metrics(requests: DataFrame, promotions: list[Promotion] = ()) -> DataFrame:
    """Rows of the metric table, one a data point. Histograms and summaries give their sum and a ``count`` attribute;
    points without a value and exponential histograms give none."""
    rows = requests.select(F.explode("resourceMetrics").alias("r")).select(attribute_map(F.col("r.resource.attributes")).alias("res"), F.explode("r.scopeMetrics").alias("sc"))
    rows = rows.select("res", F.explode("sc.metrics").alias("m"))

    def point(kind: str):
        def of(p: Column) -> Column:
            attributes = attribute_map(p["attributes"])
            if kind in ("gauge", "sum"):
                value = F.coalesce(p["asDouble"].try_cast("double"), p["asInt"].try_cast("bigint").cast("double"))
            else:
                value = F.coalesce(p["sum"], F.lit(0.0))
                attributes = F.map_concat(attributes, F.create_map(F.lit("count"), F.coalesce(p["count"], F.lit("0"))))
            return _named(type=F.lit(kind), ts=_time(p["timeUnixNano"], F.current_timestamp()), value=value, a=attributes)

        return of

    kinds = ("gauge", "sum", "histogram", "summary")
    points = [F.coalesce(F.transform(f"m.{k}.dataPoints", point(k)), F.array().cast("array<struct<type:string,ts:timestamp,value:double,a:map<string,string>>>")) for k in kinds]
    rows = rows.select("res", "m", F.explode(F.concat(*points)).alias("p")).where("p.value is not null")
    columns = {
        "metric_name": F.coalesce("m.name", F.lit("")),
        "description": F.coalesce("m.description", F.lit("")),
        "unit": F.coalesce("m.unit", F.lit("")),
        "metric_type": F.col("p.type"),
        "timestamp": F.col("p.ts"),
        "value": F.col("p.value"),
        "attributes": F.col("p.a"),
        "resource_attributes": F.col("res"),
        "record_date": F.to_date("p.ts"),
    }
    assert list(columns) == METRICS.fieldNames()
    return rows.select(*[c.alias(n) for n, c in columns.items()], *_promoted(list(promotions), F.col("p.a"), F.col("res")))


FLATTEN = {"spans": flatten_spans, "logs": flatten_logs, "metrics": flatten_metrics}


def conform(df: DataFrame, kind_schema, promotions: list[Promotion] = ()) -> DataFrame:
    """The columns of a table in order, missing ones as nulls, all of the table's types."""
    schema = with_promotions(kind_schema, list(promotions))
    return df.select(*[(F.col(f"`{f.name}`") if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields])
