"""The driver's ``events`` as telemetry tables, in SQL for both engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

PLAIN = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def _sql(spark: bool) -> dict[str, str]:
    text = "STRING" if spark else "VARCHAR"
    end = "timestampadd(MICROSECOND, CAST(round(value * 1000) AS BIGINT), ts)" if spark else "ts + to_microseconds(CAST(round(value * 1000) AS BIGINT))"
    pairs = {
        "sp.session.id": "'s-' || CAST(user_id AS TEXT)",
        "sp.user.id": "'user-' || CAST(user_id AS TEXT)",
        "sp.tenant.id": "'ten-' || CAST(user_id % 3 AS TEXT)",
        "sp.capture.id": "CASE WHEN user_id % 5 = 0 THEN 'cap-' || CAST(user_id AS TEXT) END",
        "sp.order.id": "CASE WHEN event_type = 'purchase' THEN 'o-' || CAST(event_id AS TEXT) END",
        "duration_ms": "CASE WHEN event_id % 10 <> 9 THEN CAST(CAST(floor(value) AS INTEGER) AS TEXT) END",
    }
    if spark:
        attributes = "map(" + ", ".join(f"'{k}', {v}" for k, v in pairs.items()) + ")"
    else:
        attributes = "MAP {" + ", ".join(f"'{k}': {v}" for k, v in pairs.items()) + "}"
    spans = f"""SELECT 's-' || CAST(user_id AS TEXT) AS session_id, 't-' || CAST(event_id - event_id % 4 AS TEXT) AS trace_id,
  'p-' || CAST(event_id AS TEXT) AS span_id,
  CASE WHEN event_id % 4 <> 0 THEN 'p-' || CAST(event_id - event_id % 4 AS TEXT) END AS parent_span_id,
  'app-' || CAST(user_id % 4 AS TEXT) AS app_id, 'ten-' || CAST(user_id % 3 AS TEXT) AS tenant_id, event_type AS message_type,
  'SERVER' AS span_kind, ts AS timestamp, CASE WHEN event_id % 10 <> 9 THEN {end} END AS end_timestamp, {attributes} AS attributes,
  CASE WHEN event_id % 10 <> 9 THEN value END AS duration_ms, CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'OK' END AS status_code,
  CASE WHEN event_type IN ('click', 'view') THEN 'GET' ELSE 'POST' END AS http_request_method,
  CASE WHEN event_type <> 'view' THEN '/api/' || event_type END AS http_request_path, props AS http_request_body,
  CASE WHEN event_id % 6 = 0 THEN 'accept: ' || event_type END AS http_request_headers, CASE WHEN event_id % 4 = 1 THEN 'age: ' || CAST(event_id AS TEXT) END AS http_response_headers,
  CASE event_type WHEN 'error' THEN 500 WHEN 'signup' THEN 201 ELSE 200 END AS http_response_status_code,
  CASE WHEN event_id % 3 = 0 THEN props END AS http_response_body, CAST(ts AS DATE) AS record_date FROM events"""
    logs = """SELECT CASE WHEN event_id % 7 <> 0 THEN 's-' || CAST(user_id AS TEXT) END AS session_id, ts AS timestamp,
  CASE event_type WHEN 'error' THEN 17 WHEN 'purchase' THEN 13 ELSE 9 END AS severity_number,
  CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'purchase' THEN 'WARN' ELSE 'INFO' END AS severity_text,
  event_type || ' ' || props AS body, CASE WHEN event_id % 5 = 0 THEN 't-' || CAST(event_id - event_id % 4 AS TEXT) END AS trace_id,
  CASE WHEN event_id % 5 = 0 THEN 'p-' || CAST(event_id AS TEXT) END AS span_id, event_id AS log_id, CAST(ts AS DATE) AS record_date
  FROM events"""
    metrics = """SELECT 'app.' || event_type AS metric_name, 'ms' AS unit, 'gauge' AS metric_type, ts AS timestamp, value,
  CAST(ts AS DATE) AS record_date FROM events"""
    return {k: v.replace("AS TEXT", f"AS {text}") for k, v in (("spans", spans), ("logs", logs), ("metrics", metrics))}


DUCK, SPARK = _sql(False), _sql(True)


def tables(spark: SparkSession, sf_dir: str) -> None:
    """Temporary views of the plain tables and, as spans, logs and metrics, of the events."""
    from ..session import prepared
    from .views import register

    prepared(spark)  # buckets and days are those of UTC
    for name in PLAIN:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)
    for kind, text in SPARK.items():
        register(spark, kind, spark.sql(text))


def frame(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    spark.read.parquet(f"{sf_dir}/events.parquet").createOrReplaceTempView("events")
    return spark.sql(SPARK[kind])


def with_tables(text: str) -> str:
    """A DuckDB statement with the telemetry views in front of it."""
    views = []
    for kind, body in DUCK.items():
        views.append(f"union_{kind} AS ({body})")
        views += [f"{name} AS (SELECT * FROM union_{kind})" for name in (f"committed_{kind}", "traces" if kind == "spans" else kind)]
        views.append(f"buffer_{kind} AS (SELECT * FROM union_{kind} WHERE 1 = 0)")
    used = [v for v in views]
    start = text.lstrip()
    recursive = "RECURSIVE " if start.upper().startswith("WITH RECURSIVE") else ""
    body = start[len("WITH RECURSIVE") :] if recursive else start[len("WITH") :] if start.upper().startswith("WITH ") else None
    return f"WITH {recursive}" + ",\n".join(used) + (",\n" + body if body is not None else "\n" + start)
