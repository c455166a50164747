"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one line of JSON.

Each query runs once unmeasured and then three times; the middle time counts. ``value`` is the sum over all queries.
``mix`` tells the mean and the nearest-rank 95th percentile, in ms, of the interleaved schedule of eleven telemetry
queries, which is what the reference's own load tool reports.
"""

import json
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

MIX = (
    "span_error_rate_5m log_error_rate_5m span_session_recent metric_latency_timeseries_10m span_top_5xx_paths_15m log_session_recent span_error_rate_5m"
    " span_p95_latency_by_path_5m metric_latency_max_5m log_recent_errors_sample span_session_recent span_error_rate_24h log_error_rate_5m log_session_recent"
    " metric_latency_timeseries_24h span_session_recent span_top_5xx_paths_15m metric_latency_timeseries_10m"
).split()
HEADLINE = "top_endpoints session_correlation logs_correlated request_rate_timeseries p95_latency_timeseries session_journey join_five_tables agg_cube win_rows_frame asof_join".split()


def main() -> None:
    from pyspark.sql import SparkSession

    from spanfold.plans import corpus, fixtures, queries
    from spanfold.session import prepared
    from spanfold.sql import query

    sf, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = prepared(
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    fixtures.tables(spark, sf)
    as_of = spark.table("events").selectExpr("max(ts)").first()[0]
    texts = corpus.TELEMETRY | corpus.FAMILIES
    operators = queries.queries()

    def run(name: str) -> float:
        began = time.perf_counter()
        (query(spark, texts[name], as_of) if name in texts else operators[name](spark, sf)).toArrow()
        return time.perf_counter() - began

    seconds = {}
    for name in sorted({*MIX, *HEADLINE}):
        run(name)
        seconds[name] = round(sorted(run(name) for _ in range(3))[1], 4)
    mix = sorted(run(name) * 1000 for _ in range(3) for name in MIX)
    summary = {"mean_ms": round(sum(mix) / len(mix), 1), "p95_ms": round(mix[math.ceil(0.95 * len(mix)) - 1], 1)}
    print(json.dumps({"metric": "sum of median query times", "value": round(sum(seconds.values()), 4), "unit": "sec", "queries": seconds, "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf"), "mix": summary}))


if __name__ == "__main__":
    main()
