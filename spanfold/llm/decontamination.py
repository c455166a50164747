"""Benchmark decontamination by greedy string tiling.

Every run of ``min_match`` tokens of a test item is a seed; of a shorter item, the whole of it. A document meets the items
whose seeds it shares, and each such pair is tiled: again and again the longest match of unmarked tokens is marked, the
first in the item and then in the document among equals, and marked tokens match no more. How long it is, a search by
halves tells, with Karp-Rabin hashes of all windows from running sums. An item leaks if the tiles cover enough of it. As
tiles may stand in any order in the document, passages that were reordered are caught.

All matches of one length are marked in one pass: an item's window takes the next free window of its hash, and what was
passed over as marked stays so. Lengths fall and add up to the item's length at most, so that a text of nothing but
repeated words costs some dozens of passes over its hashes, not a comparison of all pairs.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mix64, table

MIN_MATCH, COVERAGE = 5, 0.5
#: Bytes of test texts that one pass over the documents holds; more are taken in further passes.
BLOCK_BYTES = 8 << 20
_TOKEN = re.compile(r"[^\W_]+")
_BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2^64
_INVERSE = pow(_BASE, -1, 1 << 64)


def tokens(text: str | None) -> list[str]:
    """Runs of letters and digits, lower-cased: punctuation and spacing do not count."""
    return _TOKEN.findall(text.lower()) if text else []


def _powers(x: int, n: int) -> np.ndarray:
    found = np.full(n, x, np.uint64)
    found[:1] = 1
    return np.cumprod(found, dtype=np.uint64)


class _Windows:
    """A token sequence, which of its tokens are marked, and the Karp-Rabin hashes of its windows of any length."""

    def __init__(self, ids: list[int] | np.ndarray):
        self.ids = np.asarray(ids, np.int64)
        n = len(self.ids)
        powers, self.back = _powers(_BASE, n), _powers(_INVERSE, n)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix64(self.ids.astype(np.uint64)) * powers)])
        self.marked = self.ids <= 0

    def free(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts, ascending, and hashes of the windows without a marked token."""
        taken = np.concatenate([[0], np.cumsum(self.marked)])
        starts = np.flatnonzero(taken[size:] == taken[: len(taken) - size])
        return starts, (self.sums[starts + size] - self.sums[starts]) * self.back[starts]


def tiling(item: list[int], doc: list[int], min_match: int = MIN_MATCH) -> list[tuple[int, int, int]]:
    """Tiles (start in item, start in document, length) of two token sequences; ids of 0 or less match nothing.

    They are those of plain greedy tiling: always the longest match that is left, ties by place in the item, then in the
    document.
    """
    a, b = _Windows(item), _Windows(doc)
    tiles: list[tuple[int, int, int]] = []

    def shared(size: int) -> bool:
        mine, theirs = np.sort(a.free(size)[1]), b.free(size)[1]
        if not len(mine) or not len(theirs):
            return False
        return bool((mine[np.minimum(np.searchsorted(mine, theirs), len(mine) - 1)] == theirs).any())

    most = min(len(a.ids), len(b.ids))
    while most >= min_match and shared(min_match):
        low, high = min_match, most  # the longest match is at least low and at most high
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if shared(middle) else (low, middle - 1)
        size = low
        starts, hashes = a.free(size)
        places, found = b.free(size)
        known = np.isin(found, hashes)
        by_hash: dict[int, list[int]] = {}
        for t, h in zip(places[known].tolist(), found[known].tolist(), strict=True):
            by_hash.setdefault(h, []).append(t)
        passed = dict.fromkeys(by_hash, 0)
        for p, h in zip(starts.tolist(), hashes.tolist(), strict=True):
            if h not in by_hash or a.marked[p : p + size].any():
                continue
            row, at = by_hash[h], passed[h]
            while at < len(row) and b.marked[row[at] : row[at] + size].any():
                at += 1
            passed[h] = at
            for t in row[at:]:  # the first one, unless hashes of different windows are equal
                if not b.marked[t : t + size].any() and np.array_equal(a.ids[p : p + size], b.ids[t : t + size]):
                    a.marked[p : p + size] = b.marked[t : t + size] = True
                    tiles.append((p, t, size))
                    break
        most = size - 1
    return tiles


class Items:
    """Test items with their seeds, for one pass over documents."""

    def __init__(self, rows: list[tuple[int, str | None]], min_match: int = MIN_MATCH):
        self.min_match = min_match
        self.vocabulary: dict[str, int] = {}
        self.items: list[tuple[int, list[int]]] = []
        for item_id, text in rows:
            ids = [self.vocabulary.setdefault(t, len(self.vocabulary) + 1) for t in tokens(text)]
            if ids:
                self.items.append((item_id, ids))
        #: By the width of seeds: items by seed, and the seeds ascending.
        self.seeds: dict[int, tuple[dict[int, set[int]], np.ndarray]] = {}
        for k, (_, ids) in enumerate(self.items):
            width = min(min_match, len(ids))
            held = self.seeds.setdefault(width, ({}, np.zeros(0, np.uint64)))[0]
            for seed in self._hashes(np.array(ids, np.uint64), np.arange(len(ids) - width + 1), width).tolist():
                held.setdefault(seed, set()).add(k)
        self.seeds = {width: (held, np.array(sorted(held), np.uint64)) for width, (held, _) in self.seeds.items()}

    @staticmethod
    def _hashes(ids: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
        total = np.zeros(len(starts), np.uint64)
        for i in range(width):
            total = mix64(total + ids[starts + i])
        return total

    def overlaps(self, text: str | None, coverage: float = 0.0) -> list[tuple[int, int, int, int]]:
        """(item's place, its tokens, tokens covered, tiles) of each item that shares a seed with the text.

        Items of which the shared runs have fewer tokens than ``coverage`` asks for are left out untiled.
        """
        words = tokens(text)
        get = self.vocabulary.get
        ids = np.fromiter((get(w, 0) for w in words), np.int64, len(words))
        unknown = np.concatenate(([0], np.cumsum(ids == 0)))
        places: dict[int, list[int]] = {}
        for width, (held, ordered) in self.seeds.items():
            if len(ids) < width:
                continue
            starts = np.flatnonzero(unknown[width:] == unknown[: len(unknown) - width])
            if not len(starts):
                continue
            hashes = self._hashes(ids.astype(np.uint64), starts, width)
            at = np.searchsorted(ordered, hashes)
            hit = ordered[np.minimum(at, len(ordered) - 1)] == hashes
            for start, seed in zip(starts[hit].tolist(), hashes[hit].tolist(), strict=True):
                for k in held[seed]:
                    places.setdefault(k, []).append(start)
        found = []
        for k, hits in sorted(places.items()):
            # No tile can hold a token outside the shared seeds: the rest of the document is left out.
            item = self.items[k][1]
            width = min(self.min_match, len(item))
            part, end, gaps = [], -1, 0
            for start in hits:
                if start > end:
                    part.append(0)
                    gaps += 1
                part += ids[max(start, end) : start + width].tolist()
                end = start + width
            if len(part) - gaps < coverage * len(item):
                continue
            tiles = tiling(item, part, width)
            found.append((k, len(item), sum(t[2] for t in tiles), len(tiles)))
        return found


#: Of this worker: the items of the last blocks, by the block's name.
_LAST: dict[str, Items] = {}


def _items(name: str, rows: list[tuple[int, str | None]], min_match: int) -> Items:
    """A block's items, which a worker prepares once for all of its tasks."""
    if name not in _LAST:
        while len(_LAST) > 1:
            _LAST.pop(next(iter(_LAST)))
        _LAST[name] = Items(rows, min_match)
    return _LAST[name]


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The test items in blocks of bounded size, one at a time on the driver."""
    rows = benchmark.selectExpr("cast(item_id as long) as item_id", "cast(text as string) as text").where("text is not null")
    size = rows.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    count = -(-size // BLOCK_BYTES)
    for k in range(count):
        part = rows if count == 1 else rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == k)
        yield sorted((r["item_id"] if r["item_id"] is not None else -1, r["text"]) for r in part.collect())


def leaks(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, min_match: int = MIN_MATCH) -> DataFrame:
    """doc_id, item_id, item_tokens, covered_tokens, coverage, n_tiles of the pairs with at least that coverage.

    An item of fewer than ``min_match`` tokens leaks where it stands as a whole. Items without a token, and null or empty
    texts, match nothing. Equal items are reported each by
    its own id (a null id as -1); repeated documents give repeated rows; an empty table on either side gives none;
    other columns are ignored. The documents are read once for each block of test items and never shuffled.
    """
    spark = docs.sparkSession
    rows = docs.selectExpr("cast(doc_id as long) as doc_id", "cast(text as string) as text")
    schema = "doc_id long, item_id long, item_tokens long, covered_tokens long, coverage double, n_tiles long"
    arrow = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("item_tokens", pa.int64()), ("covered_tokens", pa.int64()), ("coverage", pa.float64()), ("n_tiles", pa.int64())])
    out = None
    for block in _blocks(benchmark):
        held, name = spark.sparkContext.broadcast(block), uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch], held=held, name=name) -> Iterator[pa.RecordBatch]:
            items = _items(name, held.value, min_match)
            for batch in batches:
                found = []
                for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"], strict=True):
                    found += [(doc_id, items.items[k][0], n, c, c / n, t) for k, n, c, t in items.overlaps(text.as_py(), coverage) if c >= coverage * n]
                yield pa.RecordBatch.from_pylist([dict(zip(arrow.names, r, strict=True)) for r in found], schema=arrow)

        part = rows.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], schema)


def decontaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, min_match: int = MIN_MATCH) -> DataFrame:
    """The rows of ``docs`` without a leak, all columns as they are. The rules are those of :func:`leaks`."""
    for block in _blocks(benchmark):
        held, name = docs.sparkSession.sparkContext.broadcast(block), uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch], held=held, name=name) -> Iterator[pa.RecordBatch]:
            items = _items(name, held.value, min_match)
            for batch in batches:
                clean = [not any(c >= coverage * n for _, n, c, _ in items.overlaps(t.as_py(), coverage)) for t in batch["text"]]
                yield batch.filter(pa.array(clean, pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op3_string_tiling_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
