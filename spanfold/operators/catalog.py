"""The catalog of filter values: which values of which columns a tenant's spans have, and when they were last seen."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Columns whose values are no choices, and how many values a list has by default and at most.
SKIPPED = ("trace_id", "span_id", "parent_span_id", "session_id", "tenant_id", "attributes", "events", "record_date")
DEFAULT_LIMIT, MOST = 500, 10_000


def extract(spans: DataFrame, seen_at, skipped: tuple[str, ...] = ()) -> DataFrame:
    """(tenant_id, entity_type, entity_value, last_seen_at): the non-empty values of text and 32-bit columns.

    Rows are unpivoted inside each task and made distinct with a partial pass before the shuffle.
    """
    names = [f.name for f in spans.schema.fields if isinstance(f.dataType, (T.StringType, T.IntegerType)) and f.name not in (*SKIPPED, *skipped)]
    pairs = F.array(*[F.struct(F.lit(n).alias("entity_type"), F.col(n).cast("string").alias("entity_value")) for n in names])
    rows = spans.select("tenant_id", F.explode(pairs).alias("x")).select("tenant_id", "x.*").where("tenant_id is not null and entity_value is not null and entity_value != ''")
    return rows.distinct().withColumn("last_seen_at", seen_at)


def one_tenant(batch: DataFrame) -> str | None:
    """The tenant that all rows with one share, if it is the same."""
    r = batch.agg(F.min("tenant_id").alias("a"), F.max("tenant_id").alias("b")).first()
    return r["a"] if r["a"] == r["b"] else None


def merge(catalog: DataFrame, seen: DataFrame) -> DataFrame:
    """Both, with the latest time of each value."""
    both = catalog.unionByName(seen)
    return both.groupBy("tenant_id", "entity_type", "entity_value").agg(F.max("last_seen_at").alias("last_seen_at"))


def entity_types(catalog: DataFrame, tenant_id: str, days: int | None = None, now=None) -> DataFrame:
    rows = catalog.where(F.col("tenant_id") == tenant_id)
    if days is not None:
        rows = rows.where(F.col("last_seen_at") >= now - F.expr(f"INTERVAL {int(days)} DAYS"))
    return rows.select("entity_type").distinct().orderBy("entity_type")


def entity_values(catalog: DataFrame, tenant_id: str, entity_type: str, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """Values by the time they were last seen, newest first; ties by value."""
    rows = catalog.where((F.col("tenant_id") == tenant_id) & (F.col("entity_type") == entity_type))
    latest = rows.groupBy("entity_value").agg(F.max("last_seen_at").alias("last_seen_at"))
    return latest.orderBy(F.desc("last_seen_at"), "entity_value").limit(max(1, min(MOST, limit)))
