"""Ingest: rows wait in a hot buffer or come by Structured Streaming, and are committed in batches."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..schema import Promotion
from ..sources import otlp, protobuf
from ..sources.lake import LakeTable


class HotBuffer:
    """Rows that are not committed yet, on the driver, up to a number of rows, request bytes or an age.

    A batch is taken whole before the limits are looked at, so a flush may hold more than they say. Readers take rows
    and the table's version under one lock (:meth:`state`), and a flush moves rows under it, so that each row is seen
    in one of the two places. A flush that fails keeps its rows.
    """

    def __init__(self, table: LakeTable, max_rows: int = 10_000, max_bytes: int = 128 << 20, max_age_s: float = 60.0, before_commit: Callable[[DataFrame], None] | None = None, clock: Callable[[], float] = time.monotonic):
        self.table, self.max_rows, self.max_bytes, self.max_age_s = table, max_rows, max_bytes, max_age_s
        self.before_commit, self.clock = before_commit, clock
        self._lock = threading.RLock()
        self._rows: list = []
        self._bytes = 0
        self._last = clock()
        self.generation = 0  # changes with every append and flush

    def __len__(self) -> int:
        return len(self._rows)

    def append(self, rows: DataFrame, request_bytes: int = 0) -> bool:
        """Adds rows; true if that filled the buffer and it was flushed."""
        return self.add(otlp.conform(rows, self.table.layout.schema, self.table.promotions).collect(), request_bytes)

    def add(self, new: list, request_bytes: int = 0) -> bool:
        """Adds rows of the table's columns that the caller holds already."""
        with self._lock:
            self._rows += new
            self._bytes += request_bytes if new else 0
            self.generation += bool(new)
            full = bool(self._rows) and (len(self._rows) >= self.max_rows or self._bytes >= self.max_bytes)
            if full:
                self.flush()
            return full

    def flush_if_old(self) -> bool:
        with self._lock:
            if self._rows and self.clock() - self._last >= self.max_age_s:
                self.flush()
                return True
            return False

    def flush(self) -> int:
        """Commits what waits; the table sorts it and splits it by day."""
        with self._lock:
            n = len(self._rows)
            if n:
                rows = self.frame()
                if self.before_commit:
                    try:
                        self.before_commit(rows)
                    except Exception:  # noqa: BLE001 - the value catalog never holds up the rows themselves
                        pass
                self.table.append(rows, batch_id=uuid.uuid4().hex)
                self._rows, self._bytes = [], 0
                self.generation += 1
            self._last = self.clock()
            return n

    def frame(self) -> DataFrame:
        with self._lock:
            return self.table.spark.createDataFrame(list(self._rows), self.table.schema)

    def state(self) -> tuple[int, int, DataFrame, DataFrame]:
        """(version, buffer generation, committed rows, waiting rows) of one moment."""
        with self._lock:
            return self.table.generation(), self.generation, self.table.read(), self.frame()

    def ticker(self, stop: threading.Event) -> threading.Thread:
        def loop() -> None:
            while not stop.wait(max(1.0, self.max_age_s / 2)):
                self.flush_if_old()

        thread = threading.Thread(target=loop, daemon=True)
        thread.start()
        return thread


#: The most that a request's body may hold once it is unpacked.
MOST_BYTES = 100 << 20


def unpacked(payload: bytes, encoding: str | None, most: int = MOST_BYTES) -> bytes:
    """A request's body by its Content-Encoding (gzip, deflate, br, zstd or several, last first); a ValueError tells of
    a bad or too large one. No more than ``most`` bytes are ever unpacked."""
    for name in reversed([e.strip().lower() for e in (encoding or "").split(",") if e.strip()]):
        try:
            if name in ("gzip", "x-gzip", "deflate"):
                import zlib

                reader = zlib.decompressobj(31 if name != "deflate" else 15 if payload[:1] and payload[0] & 15 == 8 else -15)
                payload = reader.decompress(payload, most + 1)
            elif name == "zstd":
                import zstandard

                with zstandard.ZstdDecompressor().stream_reader(payload) as stream:
                    payload = stream.read(most + 1)
            elif name == "br":
                import brotli

                payload = brotli.decompress(payload)
            elif name != "identity":
                raise ValueError(f"no encoding named {name}")
        except ImportError as e:
            raise ValueError(f"{name} needs a package that is not installed") from e
        except ValueError:
            raise
        except Exception as e:
            raise ValueError(f"the body is no {name}") from e
    if len(payload) > most:
        raise ValueError("the body is too large")
    return payload


def ingest(buffer: HotBuffer, payload: str | bytes, encoding: str | None = None) -> dict:
    """Takes a request, text in JSON or bytes in Protobuf or JSON, into the buffer; a ValueError tells of a bad one.

    Answers {success, ingested_count, message}, as the service does. One job flattens the request.
    """
    spark, table = buffer.table.spark, buffer.table
    if isinstance(payload, bytes):
        payload = unpacked(payload, encoding)
    text = protobuf.to_json(payload, table.kind) if isinstance(payload, bytes) else payload
    requests = otlp.parse(spark.createDataFrame([(text,)], "value string"), table.kind)
    rows = otlp.conform(otlp.FLATTEN[table.kind](requests, table.promotions), table.layout.schema, table.promotions)
    try:
        found = rows.collect()
    except Exception as e:
        if "MALFORMED_RECORD" in str(e) or "FAILFAST" in str(e):
            raise ValueError("the request is no valid JSON of this kind") from e
        raise
    buffer.add(found, len(payload))
    return {"success": True, "ingested_count": len(found), "message": f"{len(found)} {table.kind} ingested"}


def stream_to_lake(
    spark: SparkSession, kind: str, path: str, table: LakeTable, checkpoint: str, promotions: list[Promotion] = (), trigger: dict | None = None, on_batch: Callable[[DataFrame, int], None] | None = None, **options: str
) -> StreamingQuery:
    """A query that flattens OTLP files as they come and commits each micro-batch once, under the query's own id.

    Late rows are taken and land in the day of their own timestamp; nothing is dropped as a duplicate. ``options`` may
    set maxFilesPerTrigger or maxBytesPerTrigger. The default trigger is the age limit of 60 seconds.
    """
    rows = otlp.FLATTEN[kind](otlp.read_stream(spark, kind, path, **options), list(promotions))

    def commit(batch: DataFrame, number: int) -> None:
        if on_batch:
            on_batch(batch, number)
        table.append(batch, batch_id=f"{checkpoint}#{number}")

    return rows.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "60 seconds"})).start()


def windowed(rows: DataFrame, time_column: str, width: str, slide: str | None = None, late: str | None = None, keys: tuple[str, ...] = ()):
    """Rows grouped by tumbling or sliding event-time windows and keys, with a watermark for late ones if asked."""
    from pyspark.sql import functions as F

    if late:
        rows = rows.withWatermark(time_column, late)
    return rows.groupBy(F.window(time_column, width, slide or width), *keys)


def sessions(rows: DataFrame, time_column: str, gap: str, keys: tuple[str, ...], late: str | None = None):
    """Rows grouped by key and by sessions that end after a gap."""
    from pyspark.sql import functions as F

    if late:
        rows = rows.withWatermark(time_column, late)
    return rows.groupBy(*keys, F.session_window(time_column, gap))


def deduplicated(rows: DataFrame, keys: list[str], time_column: str, late: str) -> DataFrame:
    """An option for senders that repeat themselves: the first row of each key within the watermark."""
    return rows.withWatermark(time_column, late).dropDuplicatesWithinWatermark(keys)


def session_counters(events: DataFrame) -> DataFrame:
    """Of each session: how many lookups were injected, spans extracted, and strict misses; works on streams too."""
    from pyspark.sql import functions as F

    count = lambda kind: F.sum((F.col("kind") == kind).cast("long")).alias(kind)
    return events.groupBy("session_id").agg(count("injected"), count("extracted"), count("strict_miss"))
