"""Embedding near-dedup: spherical k-means cells, blocked cosine products inside cells, one vector kept of each group.

The cells find every link. Let x and y be unit vectors with cosine of at least t, so |x - y| <= d = sqrt(2 - 2t), and let
y lie in cell c (no centre is nearer to y). Then for the centre b of x's own cell, x.b - x.c <= |b - c| d. A vector is
compared in its own cell and, as a visitor, in each cell that meets this bound and whose radius it is within reach of. A
pair in two cells is compared once, in the cell with the larger number. So the centres, which are fitted on a bounded
sample, decide the cost and never the result. How many cells a vector visits depends on how clustered the data are: in
the worst case, evenly spread vectors, it visits them all and the cost is quadratic, with one copy of a vector for each
block's worth of vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, connected_components, table

THRESHOLD = 0.95
#: Vectors of a width that the centres are fitted on, at least, and for each cell (a documented sample of the index).
SAMPLE, SAMPLE_A_CELL = 20_000, 8
#: Vectors of a block at most, and their bytes in double precision, and bytes of the sample.
BLOCK, BLOCK_BYTES, SAMPLE_BYTES = 16_384, 32 << 20, 64 << 20
MOST_CELLS = 4_096
_SLACK = 1e-5


def block_rows(width: int) -> int:
    return max(1, min(BLOCK, BLOCK_BYTES // (8 * width)))


def fit_centres(x: np.ndarray, cells: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """Unit centres of spherical k-means: the mean direction of the vectors with the largest cosine to it."""
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(cells, len(x)), replace=False)]
    for _ in range(rounds):
        own = np.concatenate([(x[lo : lo + 4096] @ centres.T).argmax(1) for lo in range(0, len(x), 4096)])
        total = np.zeros_like(centres)
        np.add.at(total, own, x)
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        centres = np.where(norm > 1e-9, total / np.maximum(norm, 1e-9), centres)
    return centres


def _usable(rows: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, str]:
    """id and data (components as bytes) of the vectors that can link, and the type of the components."""
    kind = "<f4" if rows.schema[vector_col].dataType.elementType.typeName() == "float" else "<f8"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, data = [], []
            for i, v in zip(b["id"].to_pylist(), b["v"], strict=True):
                if i is None or not v.is_valid:
                    continue
                values = v.values
                if not len(values) or values.null_count:
                    continue
                x = values.to_numpy(zero_copy_only=False).astype(kind)
                if np.isfinite(x).all() and x.any():
                    ids.append(i)
                    data.append(x.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(data, pa.binary())], names=["id", "data"])

    picked = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<float>" if kind == "<f4" else "array<double>").alias("v"))
    return picked.mapInArrow(run, "id long, data binary"), kind


def _matrix(data: list[bytes], kind: str) -> np.ndarray:
    """Unit vectors of one width, in double precision. They are scaled first, so that no square is too large or small."""
    x = np.frombuffer(b"".join(data), kind).reshape(len(data), -1).astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _of_width(data: list[bytes]) -> dict[int, np.ndarray]:
    """By size in bytes, the places of the vectors: vectors of several widths may come together and never link."""
    size = np.fromiter(map(len, data), np.int64, len(data))
    return {int(n): np.flatnonzero(size == n) for n in np.unique(size)}


#: By size in bytes: the number of the first cell, and the centres.
Cells = dict[int, tuple[int, np.ndarray]]


def _assigned(reps: DataFrame, cells: Cells, kind: str) -> DataFrame:
    """The vectors with their cell, that of the nearest centre, and angle to it."""
    held = reps.sparkSession.sparkContext.broadcast(cells)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 2048):
                part = b.slice(at, 2048)
                data = part["data"].to_pylist()
                cell, angle = np.empty(len(data), np.int32), np.empty(len(data))
                for size, some in _of_width(data).items():
                    first, centres = held.value[size]
                    s = _matrix([data[i] for i in some], kind) @ centres.T
                    own = s.argmax(1)
                    cell[some], angle[some] = first + own, np.arccos(np.clip(s[np.arange(len(s)), own], -1, 1))
                yield pa.RecordBatch.from_arrays([part["id"], part["key"], part["weight"], part["data"], pa.array(cell), pa.array(angle)], names=["id", "key", "weight", "data", "cell", "angle"])

    return reps.select("id", "key", "weight", "data").mapInArrow(run, "id long, key string, weight long, data binary, cell int, angle double")


def _tasks(homes: DataFrame, cells: Cells, radii: np.ndarray, blocks: np.ndarray, t: float, kind: str) -> DataFrame:
    """cell, block, visitor, id, weight, data: each block of a cell's own vectors, and those that are compared with it.

    They are the cell's vectors in later blocks and the visitors from cells with smaller numbers. Vectors travel as they
    came, in single precision if they came so.
    """
    d, reach = np.sqrt(max(0.0, 2 - 2 * t)), float(np.arccos(min(1.0, t)))
    held = homes.sparkSession.sparkContext.broadcast((cells, radii, blocks))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, radii, blocks = held.value
        between = {size: (np.sqrt(np.maximum(0.0, 2 - 2 * (c @ c.T))) + 1e-6).astype(np.float32) for size, (_, c) in cells.items()}
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                data, own, block = part["data"].to_pylist(), part["cell"].to_numpy(), part["block"].to_numpy()
                for size, some in _of_width(data).items():
                    first, c = cells[size]
                    r, counts = radii[first : first + len(c)], blocks[first : first + len(c)]
                    s = _matrix([data[i] for i in some], kind) @ c.T
                    home = own[some] - first
                    near = (s[np.arange(len(s)), home][:, None] - s <= between[size][home] * d + _SLACK) & (np.arccos(np.clip(s, -1, 1)) <= r + reach + _SLACK)
                    near &= (np.arange(len(c))[None, :] > home[:, None]) & (counts > 0)
                    row, cell = np.nonzero(near)
                    # A cell's own later blocks come as visitors of its earlier ones, and once as members of their own.
                    row, cell = np.concatenate([np.arange(len(some)), row]), np.concatenate([home, cell])
                    times = np.concatenate([block[some] + 1, counts[cell[len(some) :]]]).astype(np.int64)
                    to = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                    row, cell = np.repeat(row, times), np.repeat(cell, times)
                    visitor = (cell != home[row]) | (to != block[some][row])
                    for lo in range(0, len(row), 4096):
                        cut = slice(lo, lo + 4096)
                        picked = part.take(pa.array(some[row[cut]], pa.int64()))
                        yield pa.RecordBatch.from_arrays(
                            [pa.array((first + cell[cut]).astype(np.int32)), pa.array(to[cut].astype(np.int32)), pa.array(visitor[cut]), picked["id"], picked["weight"], picked["data"]],
                            names=["cell", "block", "visitor", "id", "weight", "data"],
                        )

    return homes.mapInArrow(run, "cell int, block int, visitor boolean, id long, weight long, data binary")


class Block:
    """A block of a cell's own vectors, the links found so far, and which of its vectors they connect."""

    def __init__(self, ids: np.ndarray, weights: np.ndarray, x: np.ndarray, t: float):
        self.ids, self.weights, self.x, self.t = ids, weights, x, t
        self.low = x.astype(np.float32)
        self.links = np.zeros(len(ids), np.int64)
        self.group = np.arange(len(ids))

    def linked(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows of ``x`` with a link, and which vectors they link to, by cosine in double precision."""
        some = np.flatnonzero((x.astype(np.float32) @ self.low.T >= self.t - 1e-4).any(1))
        found = x[some] @ self.x.T >= self.t
        keep = found.any(1)
        return some[keep], found[keep]

    def connect(self, found: np.ndarray) -> None:
        """Each row's vectors become one group. Groups merge fewer times than the block has vectors."""
        top = len(self.ids)
        while len(found):
            least = np.where(found, self.group, top).min(1)
            apart = np.flatnonzero(np.where(found, self.group, -1).max(1) != least)
            if not len(apart):
                return
            merged = np.unique(self.group[found[apart[0]]])
            self.group[np.isin(self.group, merged)] = merged[0]
            found = found[apart]

    def within(self) -> None:
        for lo in range(0, len(self.ids), 256):
            some, found = self.linked(self.x[lo : lo + 256])
            self.links[lo + some] += found @ self.weights - self.weights[lo + some]  # less itself
            self.connect(found)

    def meet(self, ids: np.ndarray, weights: np.ndarray, x: np.ndarray) -> list[tuple[int, int, int]]:
        """(id, links, a linked id of this block) of visitors with links."""
        some, found = self.linked(x)
        if not len(some):
            return []
        self.links += weights[some] @ found
        self.connect(found)
        return list(zip(ids[some].tolist(), (found @ self.weights).tolist(), self.ids[found.argmax(1)].tolist(), strict=True))

    def result(self) -> list[tuple[int, int, int]]:
        """(id, links, an id of its group) of the block's own vectors with links."""
        some = np.flatnonzero(self.links)
        return list(zip(self.ids[some].tolist(), self.links[some].tolist(), self.ids[self.group[some]].tolist(), strict=True))


def _links(tasks: DataFrame, t: float, kind: str) -> DataFrame:
    """id, links (a part of the sum) and other (one linked or grouped vector)."""
    arrow = pa.schema([("id", pa.int64()), ("links", pa.int64()), ("other", pa.int64())])

    def batch_of(rows: list[tuple[int, int, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], pa.int64()) for j in range(3)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, own, block = None, [], None
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                cell, number, visitor = (part[n].to_numpy(zero_copy_only=False) for n in ("cell", "block", "visitor"))
                edges = np.flatnonzero((np.diff(cell) != 0) | (np.diff(number) != 0) | (np.diff(visitor.astype(int)) != 0)) + 1
                for lo, hi in zip([0, *edges.tolist()], [*edges.tolist(), part.num_rows], strict=True):
                    rows = part.slice(lo, hi - lo)
                    now = (int(cell[lo]), int(number[lo]))
                    if now != key:
                        if own:
                            block = _block(own, t, kind)
                        if block:
                            yield batch_of(block.result())
                        key, own, block = now, [], None
                    if not visitor[lo]:
                        own.append(rows)
                        continue
                    if own:
                        block, own = _block(own, t, kind), []
                    if block:
                        yield batch_of(block.meet(rows["id"].to_numpy(), rows["weight"].to_numpy(), _matrix(rows["data"].to_pylist(), kind)))
        if own:
            block = _block(own, t, kind)
        if block:
            yield batch_of(block.result())

    dealt = tasks.repartition("cell", "block").sortWithinPartitions("cell", "block", "visitor")
    return dealt.mapInArrow(run, "id long, links long, other long")


def _block(parts: list[pa.RecordBatch], t: float, kind: str) -> Block:
    ids, weights = (np.concatenate([p[n].to_numpy() for p in parts]) for n in ("id", "weight"))
    made = Block(ids, weights, _matrix([x for p in parts for x in p["data"].to_pylist()], kind), t)
    made.within()
    return made


def near_duplicates(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", t: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """id_col, n_links, component_id and kept of every row: the vectors with a cosine of at least ``t`` to it.

    Vectors that are null, empty or zero, or hold null or non-finite components, link with nothing; so do rows without
    an id, which are kept and have a null component. Vectors link with others of their own width only; a table may hold
    several. Equal vectors are compared once and counted with their number. Repeated ids are rows of their own that
    share a component. Further columns are ignored; an empty table gives no rows. ``t`` is over 0.

    A task holds one block of vectors and streams past it what it is compared with, so that a hot cell is more tasks,
    not a larger one; it sends back sums and a spanning set of links, never all pairs. There is a cell for each block's
    worth of vectors, up to a bound; beyond it cells have more blocks.
    """
    spark = rows.sparkSession
    scratch = Scratch(spark)
    usable, kind = _usable(rows, id_col, vector_col)
    vectors = scratch.write(usable.withColumn("key", F.md5("data")), "vectors")
    alone = rows.select(F.col(id_col).cast("long").alias(id_col))
    same = vectors.groupBy("key").agg(F.min("id").alias("id"), F.count("*").alias("weight"))
    reps = scratch.write(vectors.dropDuplicates(["id", "key"]).join(same, ["id", "key"]), "reps")
    sizes = {r["size"]: r["n"] for r in reps.groupBy(F.octet_length("data").alias("size")).agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return alone.select(id_col, F.lit(0).cast("long").alias("n_links"), F.col(id_col).alias("component_id"), F.lit(True).alias("kept"))
    bytes_each = np.dtype(kind).itemsize
    wanted = {size: max(1, min(MOST_CELLS, -(-n // block_rows(size // bytes_each)))) for size, n in sizes.items()}
    share = lambda size, n: min(1.0, min(max(sample, SAMPLE_A_CELL * wanted[size]), SAMPLE_BYTES // size) / n)
    limit = F.element_at(F.create_map(*[F.lit(x) for size, n in sizes.items() for x in (size, int(share(size, n) * 1_000_000) + 1)]), F.octet_length("data"))
    drawn: dict[int, list[bytes]] = {}
    for r in reps.where(F.pmod(F.xxhash64("key"), F.lit(1_000_000)) < limit).select("data").toLocalIterator():
        held = drawn.setdefault(len(r["data"]), [])
        if len(held) < 2 * max(sample, SAMPLE_A_CELL * wanted[len(r["data"])]):  # hashes hardly deal so unevenly
            held.append(bytes(r["data"]))
    cells: Cells = {}
    many = 0
    for size in sorted(sizes):
        fitted = fit_centres(_matrix(sorted(drawn[size]), kind), wanted[size]) if size in drawn else np.eye(1, size // bytes_each)
        cells[size] = (many, fitted)
        many += len(fitted)
    placed = scratch.write(_assigned(reps, cells, kind), "cells")
    scratch.drop(reps)
    filled = {r["cell"]: r for r in placed.groupBy("cell").agg(F.max("angle").alias("radius"), F.count("*").alias("n")).collect()}
    radii, blocks = np.zeros(many), np.zeros(many, np.int64)
    for size, (first, centres) in cells.items():
        for k in range(first, first + len(centres)):
            if k in filled:
                radii[k], blocks[k] = filled[k]["radius"], -(-filled[k]["n"] // block_rows(size // bytes_each))
    split = {int(k): int(n) for k, n in enumerate(blocks) if n > 1}
    count = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in split.items() for x in kv]), F.col("cell")), F.lit(1)) if split else F.lit(1)
    homes = placed.withColumn("block", F.pmod(F.xxhash64("id", "key"), count).cast("int"))
    found = scratch.write(_links(_tasks(homes, cells, radii, blocks, t, kind), t, kind), "links")
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    groups = connected_components(scratch, found.select(F.col("id").alias("a"), F.col("other").alias("b")))
    classes = placed.select("key", "id", "weight").join(links, "id", "left").join(groups, F.col("id") == F.col("node"), "left")
    # Equal vectors share a key, and rows with one id are one node: the class of a row is the least id among them.
    classes = classes.select("key", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    known = vectors.select("id", "key").join(classes, "key").select("id", "n_links", "component_id")
    rest = alone.join(vectors.select(F.col("id").alias(id_col)).distinct(), id_col, "left_anti")
    rest = rest.select(id_col, F.lit(0).cast("long").alias("n_links"), F.col(id_col).alias("component_id"))
    every = known.select(F.col("id").alias(id_col), "n_links", "component_id").unionByName(rest)
    return every.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))


def op1_spherical_kmeans_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


OP1_SQL = """
WITH RECURSIVE e AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.v, b.v) >= 0.95
), reached AS (
  SELECT a AS node, b AS other FROM links
  UNION SELECT r.node, l.b FROM reached r JOIN links l ON r.other = l.a
), component AS (SELECT node, min(other) AS least FROM reached GROUP BY node),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(least, vec_id)) AS component_id,
  vec_id = least(vec_id, coalesce(least, vec_id)) AS kept
FROM embeddings LEFT JOIN counts ON vec_id = a LEFT JOIN component ON vec_id = node
"""
