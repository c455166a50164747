"""Tables derived from telemetry, kept up to date by what is newer than all they hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.lake import Files


def append_newer(source: DataFrame, path: str, time_column: str = "timestamp", day_column: str = "record_date", late: Column | None = None) -> None:
    """Appends the rows of ``source`` that are later than the newest row of the table at ``path``, a folder a day.

    The newest time is an aggregate over the table's own files, of which only the footers and one column are read, and
    it reaches the source's scan as a literal. ``late`` may let other rows in.
    """
    spark = source.sparkSession
    rows = source
    if (known := read(spark, path)) is not None:
        newest = known.agg(F.max(time_column)).first()[0]
        if newest is not None:
            fresh = F.col(time_column) > F.lit(newest).cast(source.schema[time_column].dataType)
            rows = source.where(fresh | late if late is not None else fresh)
    rows.hint("rebalance", F.col(day_column)).sortWithinPartitions(time_column).write.mode("append").partitionBy(day_column).parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at ``path``; none if nothing was written there."""
    files = Files(spark, path)
    return spark.read.parquet(path) if files.fs.exists(files.path(path)) and any(p.endswith(".parquet") for p, _, _ in files.list(path, deep=True)) else None


def business_index(spans: DataFrame, fields: dict[str, str]) -> DataFrame:
    """Spans with fields of their request bodies as columns: {column: JSON path}."""
    picked = [F.get_json_object("http_request_body", p).alias(c) for c, p in fields.items()]
    return spans.select("session_id", "trace_id", "span_id", "timestamp", *picked, "record_date")
