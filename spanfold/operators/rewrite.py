"""DELETE and UPDATE of a table: the files that hold matching rows are written anew and take the old ones' place."""

from __future__ import annotations

import time

from pyspark.sql import functions as F

from ..sources.lake import Conflict, LakeTable


def rewrite(table: LakeTable, condition: str, changes: dict[str, str] | None = None, attempts: int = 3) -> int:
    """How many rows were deleted or, with ``changes`` (column: expression), changed. A null condition matches nothing.

    Files without a match are not touched, and one commit swaps the others, so that readers see all of it or nothing.
    A row whose time changes moves to its new day. If others changed the same files, it is done again on the new state.
    """
    tail = lambda path: path.rpartition("/batch=")[2]
    hit = F.coalesce(F.expr(condition).cast("boolean"), F.lit(False))
    for attempt in range(attempts):
        files = {tail(f["path"]): f for f in table.live_files()}
        if not files:
            return 0
        rows = table.load(list(files.values()))
        held = rows.select("*", F.regexp_extract("_metadata.file_path", r"/batch=(.*)$", 1).alias("__file")).where(hit)
        found = {r["__file"]: r["n"] for r in held.groupBy("__file").agg(F.count("*").alias("n")).collect()}
        if not found:
            return 0
        old = [files[t] for t in found]
        rows = table.load(old)
        if changes is None:
            rows = rows.where(~hit)
        else:
            new = rows.withColumn("__hit", hit)
            rows = new.select(*[F.when(F.col("__hit"), F.expr(changes[c])).otherwise(F.col(f"`{c}`")).alias(c) if c in changes else F.col(f"`{c}`") for c in rows.columns])
            if "timestamp" in changes:
                rows = rows.withColumn("record_date", F.to_date("timestamp"))
        try:
            if table.commit("delete" if changes is None else "update", table.write_files(rows), [f["path"] for f in old]):
                return sum(found.values())
        except Conflict:
            pass
        time.sleep(0.15 * 2**attempt)
    raise Conflict(table.root)
