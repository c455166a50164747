"""The named queries, in the embedded engine's dialect.

The same text is translated for Spark and given to DuckDB. Where a query speaks of the present, its text says
CURRENT_TIMESTAMP, which stands for the newest span. Top lists have a last key that makes them definite.
"""

from __future__ import annotations

_ERROR = "(http_response_status_code >= 500 OR status_code = 'ERROR')"
_LATENCY = "(EXTRACT(EPOCH FROM end_timestamp) - EXTRACT(EPOCH FROM timestamp)) * 1000.0"
_SESSION = "'s-7'"


def _since(n: str) -> str:
    return f"timestamp >= (CAST(CURRENT_TIMESTAMP AS TIMESTAMP) - INTERVAL '{n}')"


TELEMETRY = {
    # Spans
    **{
        f"span_error_rate_{name}": f"SELECT COUNT(*) AS errors FROM union_spans WHERE {_since(width)} AND {_ERROR}"
        for name, width in (("5m", "5 minutes"), ("24h", "24 hours"))
    },
    **{
        f"span_top_5xx_paths_{name}": f"""SELECT http_request_path, COUNT(*) AS errors FROM union_spans
WHERE {_since(width)} AND http_response_status_code >= 500 AND http_request_path IS NOT NULL
GROUP BY 1 ORDER BY errors DESC, http_request_path LIMIT 10"""
        for name, width in (("15m", "15 minutes"), ("30d", "30 days"))
    },
    **{
        f"span_p95_latency_by_path_{name}": f"""SELECT http_request_path, ROUND(quantile_cont({_LATENCY}, 0.95), 2) AS p95_ms FROM union_spans
WHERE {_since(width)} AND end_timestamp IS NOT NULL AND http_request_path IS NOT NULL
GROUP BY 1 ORDER BY p95_ms DESC, http_request_path LIMIT 10"""
        for name, width in (("5m", "5 minutes"), ("30d", "30 days"))
    },
    "span_session_recent": f"""SELECT trace_id, span_id, timestamp, http_request_path, http_response_status_code FROM union_spans
WHERE session_id = {_SESSION} ORDER BY timestamp DESC, span_id LIMIT 50""",
    # Logs
    "log_error_rate_5m": f"SELECT COUNT(*) AS errors FROM union_logs WHERE {_since('5 minutes')} AND severity_number >= 17",
    "log_error_rate_24h": f"SELECT COUNT(*) AS errors FROM union_logs WHERE {_since('24 hours')} AND severity_number >= 17",
    "log_recent_errors_sample": f"""SELECT timestamp, severity_text, body FROM union_logs WHERE {_since('7 days')} AND severity_number >= 17
ORDER BY timestamp DESC, body, log_id LIMIT 50""",
    "log_session_recent": f"SELECT timestamp, severity_text, body FROM union_logs WHERE session_id = {_SESSION} ORDER BY timestamp DESC, log_id LIMIT 50",
    # Metrics
    **{
        f"metric_latency_timeseries_{name}": f"""SELECT date_trunc('minute', timestamp) AS t, ROUND(AVG(value), 4) AS avg_latency_ms FROM union_metrics
WHERE {_since(width)} AND metric_name = 'app.click' GROUP BY 1 ORDER BY 1"""
        for name, width in (("10m", "10 minutes"), ("24h", "24 hours"))
    },
    "metric_latency_max_5m": f"SELECT MAX(value) AS max_latency_ms FROM union_metrics WHERE {_since('5 minutes')} AND metric_name = 'app.click'",
    "metric_count_sum": "SELECT metric_name, COUNT(*) AS n, ROUND(SUM(value), 2) AS total FROM union_metrics GROUP BY metric_name",
    # Dashboards
    "request_rate_timeseries": """SELECT time_bucket(INTERVAL '1 hour', timestamp) AS time, COUNT(*) / EXTRACT(EPOCH FROM INTERVAL '1 hour') AS requests_per_sec
FROM committed_spans WHERE timestamp BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-12 00:00:00'
AND record_date >= DATE '2024-01-05' AND record_date <= DATE '2024-01-12' GROUP BY time ORDER BY time""",
    "request_rate_per_minute": "SELECT date_trunc('minute', timestamp) AS time, COUNT(*) / 60.0 AS requests_per_sec FROM committed_spans GROUP BY 1 ORDER BY 1",
    "request_rate_odd_bucket": "SELECT time_bucket(INTERVAL '7 minutes', timestamp) AS time, COUNT(*) AS n FROM committed_spans GROUP BY 1",
    "error_rate_pct_timeseries": """SELECT time_bucket(INTERVAL '6 hours', timestamp) AS time,
ROUND(COUNT(*) FILTER (WHERE status_code = 'ERROR') * 100.0 / COUNT(*), 4) AS error_rate FROM committed_spans GROUP BY time ORDER BY time""",
    "p95_latency_timeseries": """SELECT time_bucket(INTERVAL '1 day', timestamp) AS time,
ROUND(quantile_cont(EXTRACT(EPOCH FROM (end_timestamp - timestamp)) * 1000, 0.95), 2) AS p95_latency_ms
FROM committed_spans WHERE end_timestamp IS NOT NULL GROUP BY time ORDER BY time""",
    "active_sessions": f"SELECT COUNT(DISTINCT session_id) AS active_sessions FROM committed_spans WHERE {_since('1 day')}",
    "top_endpoints": """SELECT http_request_path AS endpoint, COUNT(*) AS request_count, COUNT(*) FILTER (WHERE status_code = 'ERROR') AS error_count,
ROUND(quantile_cont(EXTRACT(EPOCH FROM (end_timestamp - timestamp)) * 1000, 0.95), 2) AS p95_ms
FROM committed_spans WHERE http_request_path IS NOT NULL GROUP BY endpoint ORDER BY request_count DESC, endpoint LIMIT 20""",
    "session_explorer": f"""SELECT timestamp, trace_id, span_id, message_type, http_request_path, http_response_status_code, status_code
FROM committed_spans WHERE session_id = {_SESSION} AND record_date >= DATE '2024-01-02' ORDER BY timestamp, span_id""",
    "logs_correlated": """SELECT l.timestamp, l.severity_text, l.body, t.http_request_path FROM committed_logs l
JOIN committed_spans t ON l.trace_id = t.trace_id AND l.span_id = t.span_id
WHERE l.severity_number >= 17 ORDER BY l.timestamp DESC, l.log_id LIMIT 100""",
    "service_selector": "SELECT DISTINCT app_id FROM committed_spans WHERE record_date >= DATE '2024-01-20' ORDER BY app_id",
    "unified_timeline": f"""SELECT timestamp, 'trace' AS type, message_type AS event FROM committed_spans WHERE session_id = {_SESSION}
UNION ALL SELECT timestamp, 'log' AS type, body AS event FROM committed_logs WHERE session_id = {_SESSION} ORDER BY timestamp, type, event""",
    # Checks of the tables
    "total_spans": "SELECT COUNT(*) AS total_spans FROM traces",
    "total_logs": "SELECT COUNT(*) AS total_logs FROM logs",
    "spans_by_session": """SELECT session_id, COUNT(*) AS span_count, MIN(timestamp) AS first_span, MAX(timestamp) AS last_span FROM traces
GROUP BY session_id ORDER BY span_count DESC, session_id LIMIT 10""",
    "spans_by_app": "SELECT app_id, COUNT(*) AS span_count FROM traces GROUP BY app_id ORDER BY span_count DESC, app_id",
    "recent_spans": "SELECT session_id, trace_id, span_id, message_type, timestamp, record_date FROM traces ORDER BY timestamp DESC, span_id LIMIT 10",
    "partition_distribution": "SELECT record_date, COUNT(*) AS span_count FROM traces GROUP BY record_date ORDER BY record_date DESC",
    "logs_by_session": """SELECT session_id, COUNT(*) AS log_count, MIN(timestamp) AS first_log, MAX(timestamp) AS last_log FROM logs
GROUP BY session_id ORDER BY log_count DESC, session_id LIMIT 10""",
    "logs_by_severity": "SELECT severity_text, COUNT(*) AS log_count FROM logs GROUP BY severity_text ORDER BY log_count DESC, severity_text",
    "recent_logs": "SELECT session_id, severity_text, body, timestamp, trace_id, span_id FROM logs ORDER BY timestamp DESC, log_id LIMIT 10",
    "log_correlation_stats": "SELECT COUNT(*) AS correlated_logs, COUNT(DISTINCT trace_id) AS unique_traces FROM logs WHERE trace_id IS NOT NULL",
    "session_correlation": """SELECT COALESCE(t.session_id, l.session_id) AS session_id, COUNT(DISTINCT t.span_id) AS span_count, COUNT(DISTINCT l.body) AS log_count
FROM traces t FULL OUTER JOIN logs l ON t.session_id = l.session_id WHERE COALESCE(t.session_id, l.session_id) IS NOT NULL
GROUP BY COALESCE(t.session_id, l.session_id) ORDER BY span_count + log_count DESC, 1 LIMIT 10""",
    "sessions_with_logs": """SELECT t.session_id, COUNT(DISTINCT t.span_id) AS spans, COUNT(DISTINCT l.body) AS logs FROM traces t
LEFT JOIN logs l ON t.session_id = l.session_id GROUP BY t.session_id HAVING COUNT(DISTINCT l.body) > 0 ORDER BY spans + logs DESC""",
    # Demonstrations
    "session_overview": """SELECT LEFT(session_id, 40) || '...' AS session, COUNT(*) AS total_requests, MIN(timestamp)::VARCHAR AS first_seen,
MAX(timestamp)::VARCHAR AS last_seen, COUNT(DISTINCT http_request_path) AS unique_endpoints FROM traces GROUP BY session_id ORDER BY total_requests DESC""",
    "session_requests": f"""SELECT timestamp AS time, http_request_method || ' ' || http_request_path AS request, http_response_status_code AS status,
attributes['duration_ms'] AS duration_ms, attributes['sp.user.id'] AS user_id FROM traces WHERE session_id = {_SESSION} ORDER BY timestamp""",
    "endpoint_stats": """SELECT http_request_path AS endpoint, COUNT(*) AS requests, ROUND(AVG(CAST(attributes['duration_ms'] AS INTEGER)), 2) AS avg_duration_ms,
MIN(CAST(attributes['duration_ms'] AS INTEGER)) AS min_duration_ms, MAX(CAST(attributes['duration_ms'] AS INTEGER)) AS max_duration_ms,
COUNT(DISTINCT session_id) AS unique_sessions FROM traces WHERE http_request_path IS NOT NULL GROUP BY http_request_path ORDER BY requests DESC""",
    "session_error_analysis": """SELECT LEFT(session_id, 40) || '...' AS session, COUNT(*) AS total_requests,
COUNT(*) FILTER (WHERE http_response_status_code >= 500) AS errors,
ROUND(COUNT(*) FILTER (WHERE http_response_status_code >= 500) * 100.0 / COUNT(*), 2) AS error_rate_pct FROM traces GROUP BY session_id
HAVING COUNT(*) FILTER (WHERE http_response_status_code >= 500) > 0 ORDER BY error_rate_pct DESC""",
    "session_journey": """SELECT LEFT(session_id, 40) || '...' AS session, STRING_AGG(http_request_path, ' → ' ORDER BY timestamp, span_id) AS journey
FROM traces WHERE http_request_path IS NOT NULL GROUP BY session_id""",
    "attr_coverage": """SELECT 'Rows with sp.order.id' AS metric, COUNT(*)::VARCHAR AS count FROM traces WHERE attributes['sp.order.id'] IS NOT NULL
UNION ALL SELECT 'Total rows', COUNT(*)::VARCHAR FROM traces
UNION ALL SELECT 'Coverage (%)', ROUND(COUNT(*) FILTER (WHERE attributes['sp.order.id'] IS NOT NULL) * 100.0 / COUNT(*), 2)::VARCHAR || '%' FROM traces""",
    "kpi_report": """SELECT 'Total Spans' AS metric, COUNT(*)::VARCHAR AS value FROM traces UNION ALL SELECT 'Unique Sessions', COUNT(DISTINCT session_id)::VARCHAR FROM traces
UNION ALL SELECT 'Unique Endpoints', COUNT(DISTINCT http_request_path)::VARCHAR FROM traces UNION ALL SELECT 'Date Partitions', COUNT(DISTINCT record_date)::VARCHAR FROM traces""",
    "sample_sessions": """SELECT session_id, COUNT(*) AS requests, MIN(http_request_path) AS sample_endpoint FROM traces GROUP BY session_id
ORDER BY requests DESC, session_id LIMIT 5""",
    "sample_requests": """SELECT http_request_method || ' ' || http_request_path AS request, http_response_status_code AS status, attributes['duration_ms'] AS duration_ms,
LEFT(session_id, 20) || '...' AS session FROM traces ORDER BY timestamp DESC, span_id LIMIT 5""",
    # Attributes and bodies
    "attr_lookup": "SELECT session_id, trace_id, span_id, timestamp, http_request_path FROM traces WHERE attributes['sp.user.id'] = 'user-12' ORDER BY timestamp DESC",
    "order_bodies": """SELECT attributes['sp.order.id'] AS order_id, http_request_body, http_response_body, timestamp FROM traces
WHERE attributes['sp.order.id'] IS NOT NULL AND http_response_status_code = 200 ORDER BY timestamp DESC""",
    "session_context": """SELECT span_id, message_type, http_request_method, http_request_path, http_request_body, http_response_body, timestamp FROM traces
WHERE attributes['sp.session.id'] = 's-9' ORDER BY timestamp ASC""",
    "promoted_lookup": """SELECT span_id, timestamp FROM (SELECT span_id, timestamp, attributes['sp.user.id'] AS promoted_user_id FROM traces) p
WHERE promoted_user_id = 'user-12'""",
    "http_fields_by_session": """SELECT session_id, arg_min(http_request_method, n) AS method, arg_min(http_request_path, n) AS path, arg_min(http_request_headers, n) AS request_headers,
arg_min(http_request_body, n) AS request_body, arg_min(http_response_status_code, n) AS status, arg_min(http_response_headers, n) AS response_headers, arg_min(http_response_body, n) AS response_body
FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY timestamp, span_id) AS n FROM traces) t GROUP BY session_id""",
    "recent_partitions": "SELECT record_date, COUNT(*) AS n FROM traces WHERE record_date >= CURRENT_DATE - 7 GROUP BY record_date",
    "key_with_dots": """SELECT span_id, json_extract_string('{"user.id": ' || json_extract_string(http_request_body, '$.k') || '}', '$."user.id"') AS user_id FROM traces
WHERE http_request_body IS NOT NULL""",
    "business_index": """SELECT session_id, trace_id, span_id, timestamp, json_extract_string(http_request_body, '$.k') AS k, record_date FROM traces
WHERE timestamp >= (SELECT COALESCE(MAX(timestamp), TIMESTAMP '1970-01-01') FROM traces WHERE record_date < DATE '2024-01-25') AND app_id = 'app-1'""",
    "orders_wide": """SELECT session_id, json_extract_string(http_request_body, '$.k') AS k, timestamp FROM traces WHERE http_request_path LIKE '/api/purch%'""",
    "two_hop_lookup": """SELECT span_id, session_id, timestamp FROM traces WHERE session_id IN
(SELECT session_id FROM traces WHERE json_extract_string(http_request_body, '$.k') = '7' AND message_type = 'signup')""",
    # Tiers
    "tier_counts": "SELECT 'union' AS tier, COUNT(*) AS n FROM union_spans UNION ALL SELECT 'committed', COUNT(*) FROM committed_spans UNION ALL SELECT 'buffer', COUNT(*) FROM buffer_spans",
}

#: Families that reach the embedded engine only by passing through.
FAMILIES = {
    "win_ranking": """SELECT event_id, row_number() OVER w AS rn, rank() OVER w AS rk, dense_rank() OVER w AS dr, ntile(4) OVER w AS quarter
FROM events WINDOW w AS (PARTITION BY event_type ORDER BY value, event_id)""",
    "win_distribution": """SELECT event_id, ROUND(percent_rank() OVER w, 6) AS pr, ROUND(cume_dist() OVER w, 6) AS cd
FROM events WINDOW w AS (PARTITION BY event_type ORDER BY value, event_id)""",
    "win_analytic": """SELECT event_id, lag(value) OVER w AS before, lead(value, 2) OVER w AS after, first_value(value) OVER w AS first,
last_value(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last,
nth_value(value, 2) OVER w AS second FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""",
    "win_rows_frame": """SELECT event_id, ROUND(SUM(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), 4) AS moving,
COUNT(*) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS running FROM events""",
    "win_range_frame": """SELECT event_id, COUNT(*) OVER (PARTITION BY event_type ORDER BY ts RANGE BETWEEN INTERVAL '1' HOUR PRECEDING AND CURRENT ROW) AS last_hour FROM events""",
    "win_qualify": "SELECT user_id, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) <= 3",
    "agg_cube": "SELECT l_returnflag, l_linestatus, COUNT(*) AS n, ROUND(SUM(l_quantity), 2) AS q FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)",
    "agg_rollup": "SELECT o_orderstatus, o_orderpriority, COUNT(*) AS n, grouping(o_orderpriority) AS g FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)",
    "agg_grouping_sets": "SELECT event_type, user_id % 5 AS u, COUNT(*) AS n FROM events GROUP BY GROUPING SETS ((event_type), (user_id % 5), ())",
    "agg_group_by_all": "SELECT l_returnflag, l_linestatus, ROUND(AVG(l_discount), 6) AS d FROM lineitem GROUP BY ALL",
    "agg_statistics": """SELECT event_type, ROUND(median(value), 4) AS med, ROUND(stddev_samp(value), 4) AS sd, ROUND(var_pop(value), 4) AS vp,
ROUND(skewness(value), 2) AS sk FROM (SELECT event_type, value FROM events) e GROUP BY event_type""",
    "agg_regression": """SELECT ROUND(regr_slope(o_totalprice, o_custkey), 6) AS slope, ROUND(regr_intercept(o_totalprice, o_custkey), 3) AS icept,
ROUND(corr(o_totalprice, o_custkey), 6) AS r, ROUND(covar_pop(o_totalprice, o_custkey), 1) AS cp FROM orders""",
    "agg_boolean": "SELECT user_id, bool_or(event_type = 'error') AS any_error, bool_and(value > 1) AS all_over_one FROM events GROUP BY user_id",
    "agg_arg_extremes": "SELECT event_type, arg_max(event_id, value * 1000000 + event_id) AS top, arg_min(event_id, value * 1000000 + event_id) AS low FROM events GROUP BY event_type",
    "agg_list": "SELECT user_id, array_to_string(list(event_type ORDER BY event_id DESC), '|') AS types FROM events GROUP BY user_id",
    "agg_mode": "SELECT user_id % 7 AS u, mode(CASE WHEN event_id % 4 < 3 THEN 'often' ELSE event_type END) AS most FROM events GROUP BY 1",
    "agg_percentiles": "SELECT l_returnflag, ROUND(quantile_cont(l_extendedprice, 0.5), 3) AS p50, ROUND(quantile_cont(l_extendedprice, 0.99), 3) AS p99 FROM lineitem GROUP BY l_returnflag",
    "agg_distinct_several": "SELECT COUNT(DISTINCT user_id) AS users, COUNT(DISTINCT event_type) AS types, COUNT(DISTINCT CAST(ts AS DATE)) AS days FROM events",
    "agg_having": "SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey HAVING COUNT(*) > 15",
    "join_right": "SELECT n_name, COUNT(s_suppkey) AS suppliers FROM supplier RIGHT JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name",
    "join_semi": "SELECT c_custkey, c_name FROM customer SEMI JOIN orders ON c_custkey = o_custkey AND o_totalprice > 300000",
    "join_anti": "SELECT c_custkey FROM customer ANTI JOIN orders ON c_custkey = o_custkey",
    "join_natural": "SELECT COUNT(*) AS n FROM (SELECT o_orderkey AS k FROM orders) a NATURAL JOIN (SELECT l_orderkey AS k FROM lineitem) b",
    "join_using": "SELECT COUNT(*) AS n FROM (SELECT o_orderkey AS k FROM orders) a JOIN (SELECT l_orderkey AS k FROM lineitem) b USING (k)",
    "join_small_cross": "SELECT r_name, COUNT(*) AS n FROM region CROSS JOIN nation GROUP BY r_name",
    "join_inequality": """SELECT a.n_name AS a, COUNT(*) AS later FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey GROUP BY a.n_name""",
    "join_parent_child": """SELECT p.message_type AS parent, c.message_type AS child, COUNT(*) AS n FROM union_spans c JOIN union_spans p ON c.parent_span_id = p.span_id
GROUP BY 1, 2""",
    "join_five_tables": """SELECT n_name, ROUND(SUM(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey
JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
WHERE r_regionkey = 1 GROUP BY n_name""",
    "lateral_join": "SELECT r_name, x.n FROM region, LATERAL (SELECT COUNT(*) AS n FROM nation WHERE n_regionkey = r_regionkey) x",
    "set_union_distinct": "SELECT user_id FROM events WHERE event_type = 'error' UNION SELECT user_id FROM events WHERE event_type = 'signup'",
    "set_intersect": "SELECT o_custkey AS k FROM orders INTERSECT SELECT c_custkey FROM customer WHERE c_acctbal < 0",
    "set_intersect_all": "SELECT user_id FROM events WHERE event_type = 'click' INTERSECT ALL SELECT user_id FROM events WHERE event_type = 'view'",
    "set_except": "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders",
    "set_except_all": "SELECT user_id FROM events WHERE event_type = 'click' EXCEPT ALL SELECT user_id FROM events WHERE event_type = 'view'",
    "cte_chain": """WITH per_user AS (SELECT user_id, COUNT(*) AS n FROM events GROUP BY user_id), big AS (SELECT * FROM per_user WHERE n > 50)
SELECT COUNT(*) AS users, MAX(n) AS most FROM big""",
    "cte_recursive": "WITH RECURSIVE t(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM t WHERE n < 20) SELECT n, n * n AS square FROM t",
    "select_exclude": "SELECT * EXCLUDE (props, ts) FROM events",
    "pivot_counts": "SELECT * FROM (PIVOT (SELECT user_id % 10 AS u, event_type FROM events) ON event_type IN ('click', 'error') USING count(*) GROUP BY u)",
    "pivot_values": "SELECT * FROM (PIVOT (SELECT user_id % 10 AS u, event_type, value FROM events) ON event_type USING max(value) AS top)",
    "unpivot_rows": "SELECT * FROM (UNPIVOT (SELECT l_orderkey, l_linenumber, l_tax AS tax, l_discount AS discount FROM lineitem) ON tax, discount INTO NAME name VALUE v)",
    "union_by_name": """SELECT user_id, value FROM events WHERE event_type = 'error'
UNION ALL BY NAME SELECT event_id, user_id FROM events WHERE event_type = 'signup'""",
    "distinct_on": "SELECT DISTINCT ON (user_id) user_id, event_id, value FROM events ORDER BY user_id, value DESC, event_id",
    "sample_all": "SELECT COUNT(*) AS n, COUNT(DISTINCT event_id) AS d FROM events USING SAMPLE 100%",
    "sample_rows": "SELECT COUNT(*) AS n FROM (SELECT event_id FROM events USING SAMPLE 200 ROWS) s",
    "asof_sql": """SELECT l.user_id, l.event_id, r.value AS paid FROM (SELECT * FROM events WHERE event_type = 'error') l
ASOF LEFT JOIN (SELECT user_id AS buyer, ts AS bought_at, value FROM events WHERE event_type = 'purchase') r ON l.user_id = r.buyer AND l.ts >= r.bought_at""",
    "unnest_list": "SELECT event_id, unnest([event_type, upper(event_type)]) AS v FROM events",
    "series_join": "SELECT g.v AS bucket, COUNT(e.event_id) AS n FROM generate_series(0, 9) g(v) LEFT JOIN events e ON e.user_id % 10 = g.v GROUP BY 1",
    "select_replace": "SELECT * REPLACE (upper(event_type) AS event_type, value * 2 AS value) FROM events",
    "scalar_subquery": "SELECT COUNT(*) AS n FROM orders WHERE o_totalprice > (SELECT AVG(o_totalprice) FROM orders)",
    "exists_subquery": "SELECT COUNT(*) AS n FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'F')",
    "order_limit_offset": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 OFFSET 5",
    "order_nulls": "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN value END AS v FROM events ORDER BY v DESC, event_id",
    "filter_predicates": """SELECT event_id FROM events WHERE event_type IN ('click', 'view') AND value BETWEEN 10 AND 40 AND event_type LIKE 'c%' AND NOT (user_id % 2 = 0)
AND props IS NOT NULL""",
    "fn_strings": """SELECT c_custkey, upper(c_name) AS u, substr(c_name, 1, 4) AS s, replace(c_name, '#', '-') AS r, lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS p,
length(c_name) AS n, LEFT(c_mktsegment, 3) || '/' || RIGHT(c_mktsegment, 2) AS ends, starts_with(c_name, 'Cust') AS cust FROM customer""",
    "fn_regex": r"""SELECT c_custkey, regexp_extract(c_name, '[0-9]+') AS digits, regexp_replace(c_name, '[0-9]+', 'N', 'g') AS masked,
regexp_matches(c_name, '7$') AS seven FROM customer""",
    "fn_dates": """SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M') AS minute, date_part('hour', ts) AS h, EXTRACT(DOW FROM ts) AS dow, date_trunc('hour', ts) AS hour FROM events""",
    "fn_math": "SELECT l_orderkey, l_linenumber, ROUND(sqrt(l_quantity), 6) AS q, CAST(floor(l_extendedprice / 1000) AS BIGINT) AS k, greatest(l_tax, l_discount) AS g, abs(l_tax - l_discount) AS a, l_orderkey // 7 AS d FROM lineitem",
    "fn_json": "SELECT event_id, props ->> 'k' AS k, CAST(json_extract_string(props, '$.k') AS INTEGER) AS n FROM events",
    "fn_hashes": "SELECT event_id, md5(event_type) AS m, sha256(CAST(event_id AS VARCHAR)) AS s FROM events",
    "fn_conditional": "SELECT event_id, COALESCE(NULLIF(event_type, 'click'), 'was click') AS t, CASE WHEN value > 50 THEN 'high' ELSE 'low' END AS band FROM events",
    "try_cast_text": "SELECT event_id, TRY_CAST(event_type AS INTEGER) AS n, TRY_CAST(props ->> 'k' AS DOUBLE) AS d FROM events",
    # Functions whose meaning differs between the dialects
    "fn_cast_rounding": """SELECT l_orderkey, l_linenumber, CAST(l_extendedprice / 7 AS INTEGER) AS a, CAST(l_quantity / 2 AS BIGINT) AS b, (l_discount * 100)::INTEGER AS c,
CAST('2.5' AS INTEGER) AS d, TRY_CAST(l_returnflag AS INTEGER) AS e FROM lineitem""",
    "fn_concat_nulls": "SELECT event_id, concat(event_type, NULLIF(user_id % 3, 0), '-') AS c, event_type || NULLIF(props, '{\"k\": 1}') AS p, concat_ws('/', event_type, NULL, 'x') AS w FROM events",
    "fn_date_parts": """SELECT event_id, EXTRACT(DOW FROM ts) AS dow, dayofweek(ts) AS d, isodow(ts) AS iso, dayname(ts) AS name, monthname(ts) AS month, EXTRACT(SECOND FROM ts) AS s,
EXTRACT(WEEK FROM ts) AS w, date_part('doy', ts) AS doy, EXTRACT(QUARTER FROM ts) AS q, epoch_ms(ts) AS ms, CAST(last_day(CAST(ts AS DATE)) AS VARCHAR) AS l FROM events""",
    "fn_date_diff": """SELECT event_id, date_diff('day', TIMESTAMP '2024-01-15 12:00:00', ts) AS d, date_diff('hour', TIMESTAMP '2024-01-15 12:00:00', ts) AS h,
date_diff('minute', TIMESTAMP '2024-01-15 12:00:30', ts) AS m, date_diff('month', TIMESTAMP '2023-11-30 00:00:00', ts) AS mo, date_sub('day', TIMESTAMP '2023-12-15 12:00:00', ts) AS whole FROM events""",
    "fn_text_positions": """SELECT c_custkey, substr(c_name, 0, 4) AS zero, substr(c_name, -3, 2) AS back, strpos(c_name, '#') AS at, split_part(c_name, '#', 2) AS part,
string_split(c_name, '#')[1] AS head, ltrim(c_name, 'Cu') AS l, rtrim(c_name, '0123456789') AS r, left(c_name, -2) AS short, suffix(c_name, '7') AS seven, unicode(c_mktsegment) AS u,
format('{}-{}', c_custkey, c_mktsegment) AS f FROM customer""",
    "fn_powers": """SELECT event_id, ROUND(log(value + 1), 6) AS lg, ROUND(log(2, value + 1), 6) AS l2, ROUND(value ^ 2, 4) AS sq, ROUND(value ** 0.5, 6) AS root, trunc(value - 50) AS t, xor(user_id, 5) AS x,
CASE WHEN (value + 1) / (user_id % 3) > 1e300 THEN 'infinite' ELSE 'finite' END AS by_zero FROM events""",
    "fn_lists": """SELECT event_id, [user_id, event_id, 7][2] AS second, list_sum(list_transform([user_id, 2], lambda x: x * 2))::BIGINT AS s, len(list_filter([1, 2, user_id], lambda x: x > 1)) AS n,
array_to_string([event_type, 'x', props][1:2], '+') AS joined, list_contains([1, 2, 3], user_id) AS has, list_extract([event_type], 1) AS first, list_position([4, 5], 5) AS at FROM events""",
    "fn_structs": "SELECT event_id, {'t': event_type, 'n': {'v': value}}.n.v AS v, struct_pack(a := user_id).a AS a, struct_extract({'k': event_type}, 'k') AS k FROM events",
    "fn_maps": """SELECT event_id, map {'t': event_type, 'p': props}['t'] AS t, cardinality(map {'a': user_id}) AS n, array_to_string(map_keys(map {'x': 1, 'y': 2}), ',') AS keys,
map {'a': user_id}['b'] AS missing FROM events""",
    "fn_json_paths": """SELECT event_id, props -> 'k' ->> '$' AS k, json_extract('{"a": ["x", ' || user_id::VARCHAR || ']}', '$.a[0]') AS quoted, '{"a": {"b": "t"}}' -> 'a' ->> 'b' AS deep,
json_array_length('[1, 2]') AS n, json_valid(event_type) AS bad FROM events""",
    "fn_patterns": """SELECT c_custkey, c_name SIMILAR TO 'Customer.*1' AS s, c_mktsegment GLOB 'A*' AS g, regexp_full_match(c_mktsegment, '[A-Z]+') AS f,
regexp_replace(c_name, '0(0+)', '<\\1>') AS once, c_name ILIKE 'customer%' AS i FROM customer""",
    "agg_shape": """SELECT event_type, ROUND(skewness(value), 3) AS sk, ROUND(kurtosis(value), 3) AS ku, ROUND(kurtosis_pop(value), 3) AS kp, quantile_disc(value, 0.3) AS q,
ROUND(sem(value), 6) AS se, ROUND(geomean(value + 1), 6) AS g, ROUND(kurtosis(value) FILTER (WHERE user_id % 2 = 0), 3) AS even FROM events GROUP BY event_type""",
    "agg_histogram": """SELECT user_id % 4 AS u, histogram(event_type)['click'] AS clicks, histogram(event_id % 3)[2] AS twos, ROUND(entropy(event_type), 6) AS e,
ROUND(product(1 + value / 1000000), 6) AS p FROM events GROUP BY 1""",
    "agg_first_last": "SELECT user_id, first(event_type ORDER BY event_id) AS f, last(event_type ORDER BY event_id) AS l, arg_max(NULLIF(event_type, 'click'), event_id) AS known FROM events GROUP BY user_id",
}
