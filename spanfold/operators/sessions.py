"""Session documents as a table: the state after a log of changes, with revisions, counters and expiry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A document lives this long after its last change.
TTL_S = 24 * 3600
# Changes of a document, and its counters.
PARTS = ("loaded_case", "policy", "rules", "fixtures_auth")
COUNTERS = ("injected_spans", "extracted_spans", "strict_misses")


def documents(changes: DataFrame) -> DataFrame:
    """One row a session: its parts as they were last set, revision, counters, closed, and when it changed last.

    ``changes`` has session_id, tenant_id, at, kind (``create``, ``close``, a part or a counter), body (text of a part)
    and amount (of a counter). A new document has revision 0 and each part that is set adds one; counters add none. The
    state is aggregates with partial sums, so a busy session is no hot spot, and the same log gives the same state
    however often it is replayed in another order.
    """
    kind = F.col("kind")
    part = lambda p: F.max_by(F.when(kind == p, F.col("body")), F.when(kind == p, F.col("at"))).alias(p)
    counter = lambda c: F.coalesce(F.sum(F.when(kind == c, F.coalesce("amount", F.lit(1)))), F.lit(0)).cast("long").alias(c)
    return changes.groupBy("tenant_id", "session_id").agg(
        *[part(p) for p in PARTS],
        F.count(F.when(kind.isin(*PARTS), 1)).alias("revision"),
        *[counter(c) for c in COUNTERS],
        F.coalesce(F.max(F.when(kind == "close", F.col("at"))) >= F.max(F.when(kind != "close", F.col("at"))), F.lit(False)).alias("closed"),
        F.max("at").alias("changed_at"),
    )


def alive(found: DataFrame, now: Column, ttl_s: int = TTL_S, tenant_id: str | None = None) -> DataFrame:
    """The documents that are neither closed nor older than the time to live, which each change starts anew."""
    rows = found.where(~F.col("closed") & (F.unix_micros(F.col("changed_at").cast("timestamp")) > F.unix_micros(now.cast("timestamp")) - ttl_s * 1_000_000))
    return rows if tenant_id is None else rows.where(F.col("tenant_id") == tenant_id)


def bearer(header: str | None) -> str | None:
    """The token of an Authorization header, or null."""
    name, _, token = (header or "").strip().partition(" ")
    return token.strip() or None if name == "Bearer" else None


def with_tenants(requests: DataFrame, tokens: DataFrame) -> DataFrame:
    """Requests with ``authorization`` get tenant_id and status: 200, 401 without a token, 403 for one that is unknown.

    ``tokens`` has token and tenant_id, each token once.
    """
    token = F.nullif(F.trim(F.regexp_extract("authorization", r"^\s*Bearer (.*)$", 1)), F.lit(""))
    joined = requests.drop("tenant_id").withColumn("__token", token).join(tokens.select(F.col("token").alias("__token"), "tenant_id"), "__token", "left")
    status = F.when(F.col("__token").isNull(), 401).when(F.col("tenant_id").isNull(), 403).otherwise(200)
    return joined.withColumn("status", status).drop("__token")
