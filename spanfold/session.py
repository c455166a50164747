"""Sessions with the settings that the engine's semantics need."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: UTC days, the last of repeated map keys, and plans that adapt to what the shuffles hold.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def session(app: str = "spanfold", **conf: str) -> SparkSession:
    """A session with the settings above; ``conf`` has dots written as double underscores."""
    builder = SparkSession.builder.appName(app).config("spark.scheduler.mode", "FAIR")  # callers share the executors
    for k, v in (SETTINGS | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def prepared(spark: SparkSession) -> SparkSession:
    """The given session with the settings; all of them may be set at run time."""
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    return spark
