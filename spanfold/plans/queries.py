"""What the package registers with the driver: the corpus, the families, and operators beyond SQL text."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import sql
from ..operators import capture, catalog, inject, joins
from . import corpus, fixtures, tables

_NOW = "(SELECT max(ts) FROM events)"


def run_text(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """A statement over the driver's tables; the present is the newest event."""
    fixtures.tables(spark, sf_dir)
    as_of = spark.table("events").agg(F.max("ts")).first()[0] if "CURRENT_" in text else None
    return sql.query(spark, text, as_of)


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.frame(spark, sf_dir, "spans")


def capture_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = capture.trace_documents(capture.capture_rows(_spans(spark, sf_dir), "ten-2", "cap-5"))
    span = F.col("trace.resourceSpans")[0]["scopeSpans"][0]["spans"][0]
    value = lambda k: F.get(F.filter(span["attributes"], lambda x: x["key"] == k), F.lit(0))["value"]
    return rows.select(
        "span_id", span["traceId"].alias("trace_b64"), value("http.request.method")["stringValue"].alias("method"), value("url.path")["stringValue"].alias("path"),
        value("http.response.status_code")["intValue"].alias("status"), value("http.response.body")["stringValue"].alias("body"),
    )


def _catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = catalog.extract(_spans(spark, sf_dir), F.lit("2024-02-01").cast("timestamp"), ("http_request_body", "http_response_body"))
    return catalog.merge(seen.limit(0), seen)


#: Columns of the spans whose values are choices, but for bodies.
_CHOICES = "app_id message_type span_kind status_code http_request_method http_request_path http_request_headers http_response_status_code http_response_headers".split()


def catalog_entity_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.entity_types(_catalog(spark, sf_dir), "ten-1")


def catalog_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.entity_values(_catalog(spark, sf_dir), "ten-1", "message_type").select("entity_value")


_RULES = """SELECT 's-' || CAST(u AS {text}) AS session_id, 'r' || CAST(k AS {text}) AS rule_id, 1 + k % 2 AS layer, k % 3 AS priority, k AS position,
CASE k WHEN 1 THEN 'POST' ELSE '' END AS method, CASE k WHEN 2 THEN '/api/e' WHEN 3 THEN '/api/' ELSE '' END AS path_prefix
FROM (SELECT DISTINCT user_id AS u FROM events) us CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3) ks"""


def inject_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = _spans(spark, sf_dir).where("http_request_path is not null")
    blank = F.lit("")
    requests = spans.select(
        F.col("span_id").alias("request_id"), "session_id", blank.alias("direction"), F.col("app_id").alias("service"), blank.alias("host"),
        F.col("http_request_method").alias("method"), F.col("http_request_path").alias("path"),
    )
    rules = spark.sql(_RULES.format(text="STRING"))
    for name in ("direction", "service", "host", "path", "action"):
        rules = rules.withColumn(name, blank)
    rules = rules.withColumn("status", F.lit(200)).withColumn("body", blank)
    return inject.select_rules(requests, rules).select("request_id", F.col("rule.rule_id").alias("rule_id"))


INJECT_SQL = f"""WITH rules AS ({_RULES.format(text="VARCHAR")}) SELECT request_id, rule_id FROM (
  SELECT s.span_id AS request_id, r.rule_id, row_number() OVER (PARTITION BY s.span_id ORDER BY r.priority DESC, r.layer DESC, r.position DESC) AS n
  FROM union_spans s LEFT JOIN rules r ON r.session_id = s.session_id AND (r.method = '' OR r.method = s.http_request_method)
    AND starts_with(s.http_request_path, r.path_prefix) WHERE s.http_request_path IS NOT NULL) x WHERE n = 1"""


def asof_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each error with the user's last purchase before it."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    left = e.where("event_type = 'error'").select("user_id", "event_id", "ts")
    right = e.where("event_type = 'purchase'").select("user_id", F.col("ts").alias("bought_at"), F.col("value").alias("paid"))
    return joins.asof_join(left, right, ["user_id"], "ts", "bought_at")


ASOF_SQL = """SELECT l.user_id, l.event_id, l.ts, r.ts AS bought_at, r.value AS paid FROM (SELECT * FROM events WHERE event_type = 'error') l
ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') r ON l.user_id = r.user_id AND l.ts >= r.ts"""


def range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items by the price band of 5000 that holds their price."""
    points = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_extendedprice")
    bands = spark.range(40).selectExpr("id as band", "id * 5000.0D as low", "id * 5000.0D + 5000.0D as high")
    joined = joins.range_join(points, bands, "l_extendedprice", "low", "high", 5000.0)
    return joined.groupBy("band").agg(F.count("*").alias("n"))


RANGE_SQL = """SELECT band, count(*) AS n FROM lineitem JOIN (SELECT range AS band, range * 5000.0 AS low, range * 5000.0 + 5000.0 AS high FROM range(40)) b
ON l_extendedprice >= low AND l_extendedprice < high GROUP BY band"""


def session_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visits of a user: events with no gap of six hours between them."""
    from ..streaming.ingest import sessions

    e = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    return sessions(e, "ts", "6 hours", ("user_id",)).agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").cast("timestamp_ntz").alias("began"), "n")


SESSION_SQL = """SELECT user_id, min(ts) AS began, count(*) AS n FROM (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS visit FROM (
  SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOURS THEN 0 ELSE 1 END AS fresh FROM events) a) b GROUP BY user_id, visit"""


def sliding_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..streaming.ingest import windowed

    e = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    found = windowed(e, "ts", "2 hours", "1 hour", keys=("event_type",)).agg(F.count("*").alias("n"))
    return found.select(F.col("window.start").cast("timestamp_ntz").alias("began"), "event_type", "n")


SLIDING_SQL = """SELECT began, event_type, count(*) AS n FROM (SELECT date_trunc('hour', ts) AS began, event_type FROM events
UNION ALL SELECT date_trunc('hour', ts) - INTERVAL 1 HOUR, event_type FROM events) x GROUP BY 1, 2"""


def approximations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketches; another engine's differ in their last digits, so there is no SQL to compare with."""
    text = "SELECT event_type, approx_count_distinct(user_id) AS users, approx_quantile(value, 0.95) AS p95 FROM events GROUP BY event_type"
    return run_text(spark, sf_dir, text)


OPERATORS: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "capture_export": (
        capture_export,
        """SELECT span_id, trace_id AS trace_b64, http_request_method AS method, coalesce(http_request_path, '') AS path, CAST(http_response_status_code AS BIGINT) AS status,
coalesce(http_response_body, '') AS body FROM union_spans WHERE attributes['sp.capture.id'] = 'cap-5' AND attributes['sp.tenant.id'] = 'ten-2'""",
    ),
    "catalog_entity_types": (
        catalog_entity_types,
        "SELECT DISTINCT k AS entity_type FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS k, CAST({c} AS VARCHAR) AS v, tenant_id FROM union_spans" for c in _CHOICES) + ") x WHERE tenant_id = 'ten-1' AND v <> ''",
    ),
    "catalog_values": (catalog_values, "SELECT DISTINCT message_type AS entity_value FROM union_spans WHERE tenant_id = 'ten-1'"),
    "inject_select": (inject_select, INJECT_SQL),
    "asof_join": (asof_join, ASOF_SQL),
    "range_join": (range_join, RANGE_SQL),
    "session_windows": (session_windows, SESSION_SQL),
    "sliding_windows": (sliding_windows, SLIDING_SQL),
    "approximations": (approximations, None),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    texts = corpus.TELEMETRY | corpus.FAMILIES
    return {name: partial(run_text, text=text) for name, text in texts.items()} | {name: f for name, (f, _) in _operators().items()}


def _operators() -> dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]]:
    return OPERATORS | tables.OPERATORS


def oracle_sql() -> dict[str, str]:
    texts = corpus.TELEMETRY | corpus.FAMILIES | {name: text for name, (_, text) in _operators().items() if text}
    found = {}
    for name, text in texts.items():
        text = text.replace("CAST(CURRENT_TIMESTAMP AS TIMESTAMP)", _NOW).replace("CURRENT_DATE", f"CAST({_NOW} AS DATE)")
        uses = any(f"{t}{k}" in text for t in ("union_", "committed_", "buffer_") for k in fixtures.DUCK) or any(f" {k}" in text for k in ("traces", "logs"))
        found[name] = fixtures.with_tables(text) if uses else text
    return found
