"""Incremental blob ledger: every distinct text is scanned once for each version of the rules.

A text is addressed by its SHA-256. The ledger is a table of (blob, rules, spans). An increment scans the blobs of which
the ledger has no row for the present rules and adds their rows; findings are joined back to every document with a text.
Which blobs are new is asked with hashes alone; only the texts of new ones go on to be scanned.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, table

# The kinds of secret, in order, with the group and the least length that a finding needs.
RULES = (
    ("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
)
_PREFILTER = {"access": "AKIA"}
#: What is compiled: patterns and flags. A run of 24 characters that starts where a run starts is the whole run: the same
#: matches, fewer of them.
_COMPILED = tuple(
    (r"(?<![0-9a-f])[0-9a-f]{24,}" if kind == "hex" else pattern, int(re.ASCII | (re.IGNORECASE if kind == "assign" else 0))) for kind, pattern, _, _ in RULES
)
RULES_VERSION = hashlib.sha256(repr((RULES, _COMPILED, sorted(_PREFILTER.items()))).encode()).hexdigest()[:16]
_LEDGER = "blob string, rules string, spans string"


def scanner():
    """A function from a text to its findings, (start, kind's place, end) in code points, ordered."""
    compiled = [re.compile(pattern, flags) for pattern, flags in _COMPILED]

    def scan(text: str) -> list[tuple[int, int, int]]:
        found = []
        for k, (kind, _, group, least) in enumerate(RULES):
            if (must := _PREFILTER.get(kind)) and must not in text:
                continue
            found += [(m.start(), k, m.end()) for m in compiled[k].finditer(text) if m.end(group) - m.start(group) >= least]
        return sorted(found)

    return scan


def _blob(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def scan_blobs(docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """New rows of the ledger, (blob, rules, spans): a blob's spans are ``kind:start:end``, comma-joined.

    ``known`` is the ledger so far. Its hashes meet those of the documents, of which each partition sends one on, and
    the texts of new blobs are fetched by the hashes that are left. Each input partition sends a blob's text on once, so
    the copies of a hot text meet as a few rows; after the shuffle each blob is scanned once.
    """
    blobs = docs.select(_blob(F.col("text")).alias("blob"), F.coalesce("text", F.lit("")).alias("text"))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            keep = []
            for i, blob in enumerate(batch["blob"].to_pylist()):
                if (key := bytes.fromhex(blob)[:16]) not in seen:
                    seen.add(key)
                    keep.append(i)
            yield batch.take(pa.array(keep, pa.int64()))

    def scan_new(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan, seen = scanner(), set()
        for batch in batches:
            ids, spans = [], []
            for blob, text in zip(batch["blob"].to_pylist(), batch["text"], strict=True):
                if (key := bytes.fromhex(blob)[:16]) not in seen:
                    seen.add(key)
                    ids.append(blob)
                    spans.append(",".join(f"{RULES[k][0]}:{a}:{b}" for a, k, b in scan(text.as_py())))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array([RULES_VERSION] * len(ids), pa.string()), pa.array(spans, pa.string())], names=["blob", "rules", "spans"])

    once = blobs.mapInArrow(first, "blob string, text string")
    if known is not None:
        seen = known.where(F.col("rules") == RULES_VERSION).select("blob")
        fresh = blobs.select("blob").distinct().join(seen, "blob", "left_anti")
        once = once.join(fresh, "blob", "left_semi")
    return once.repartition("blob").mapInArrow(scan_new, _LEDGER)


def ledger_at(spark: SparkSession, path: str) -> DataFrame | None:
    """The ledger at a path; none if nothing was written there."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
    return spark.read.schema(_LEDGER).parquet(path) if there else None


def add_to_ledger(docs: DataFrame, path: str) -> None:
    """One increment: the blobs of ``docs`` that the ledger does not know by the present rules are scanned and added."""
    scan_blobs(docs, ledger_at(docs.sparkSession, path)).write.mode("append").parquet(path)


def findings(docs: DataFrame, path: str) -> DataFrame:
    """All rows and columns of ``docs`` and ``secret_spans`` from the ledger; a column of that name is replaced."""
    found = docs.sparkSession.read.schema(_LEDGER).parquet(path)
    # Most blobs have no finding; a rule version may have been scanned by two runs at once.
    found = found.where((F.col("rules") == RULES_VERSION) & (F.col("spans") != "")).groupBy("blob").agg(F.min("spans").alias("secret_spans"))
    columns = [c for c in docs.columns if c != "secret_spans"]
    key = f"__blob_{uuid.uuid4().hex[:12]}"  # no column of the documents
    rows = docs.select(*[F.col(f"`{c}`") for c in columns], _blob(F.col("text")).alias(key)).join(found.withColumnRenamed("blob", key), key, "left")
    return rows.select(*[F.col(f"`{c}`") for c in columns], F.coalesce("secret_spans", F.lit("")).alias("secret_spans"))


def scan_documents(docs: DataFrame, ledger: str | None = None) -> DataFrame:
    """All rows and columns of ``docs`` and ``secret_spans``, its findings, by way of the ledger at the path ``ledger``.

    The ledger is read and new rows are appended; without a path it lasts for this run. Null and empty texts have no
    findings (an empty string). Copies and repeated rows all get their text's findings; null ids, other columns and
    empty tables do no harm, and a column named ``secret_spans`` is replaced.
    """
    path = ledger or Scratch(docs.sparkSession).path("ledger")
    add_to_ledger(docs, path)
    return findings(docs, path)


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every finding's characters replaced by ``mark``, overlapping ones by one; drops secret_spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, spans = batch["text"].to_pylist(), batch["secret_spans"].to_pylist()
            for i, found in enumerate(spans):
                if found:
                    texts[i] = masked(texts[i], found, mark)
            at = batch.schema.get_field_index("text")
            kept = batch.set_column(at, "text", pa.array(texts, pa.string()))
            yield kept.select([c for c in kept.schema.names if c != "secret_spans"])

    return docs.mapInArrow(run, docs.drop("secret_spans").schema)


def masked(text: str, spans: str, mark: str) -> str:
    parts, at = [], 0
    for a, b in sorted(tuple(map(int, s.split(":")[1:])) for s in spans.split(",")):
        if b <= at:
            continue
        if a >= at:
            parts += [text[at:a], mark]
        at = b
    return "".join(parts) + text[at:]


def op9_blob_ledger_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, in two increments over one ledger: the second scans only what the first has not seen."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    path = Scratch(spark).path("ledger")
    second = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 1
    add_to_ledger(docs.where(~second), path)
    add_to_ledger(docs.where(second), path)
    found = F.filter(F.split("secret_spans", ","), lambda s: s != "")
    count = lambda kind: F.size(F.filter("found", lambda s: F.startswith(s, F.lit(f"{kind}:")))).cast("long")
    return (
        findings(docs, path)
        .withColumn("found", found)
        .select(
            "doc_id",
            *[count(kind).alias(f"n_{kind}") for kind, *_ in RULES],
            F.sha2("secret_spans", 256).alias("base_sha256"),
            F.col("secret_spans").alias("spans"),
        )
    )
