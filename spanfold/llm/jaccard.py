"""N-gram Jaccard join by a token-group matrix.

Tokens are hashed word shingles. All documents order them alike, frequent ones last, and a document's prefix is the part
of which a partner must hold at least one token (of n tokens, the first n - ceil(0.75 n) + 1). Then:

1. Partition. A token's documents are compared with the one before them, by size, and with the most central of their
   size band, the one that has the fewest tokens ahead of this one: as many comparisons as there are documents. The links
   found connect similar documents to groups.
2. Matrix. Each group's token union is kept over the prefixes: (token, group), with the range of its documents' sizes
   and the most tokens that any of them has left after this one.
3. Bound. A document queries the matrix by its prefix. The bound on what it can share with any document of a group is
   the shared token and the lesser of what is left on both sides. Only a group that can reach the threshold qualifies.
4. Open. The documents of qualifying groups that hold the token are compared with the query, exactly.

Every pair at the threshold shares its first common token in both prefixes, so it is in one group or meets in step 4.
Pairs inside a group are connected already; components() does not compare them again, and linked() compares them all.

Before texts are compared, so are bitmaps, of which bit h is the parity of the number of tokens with that hash. Two
bitmaps differ in no more bits than the sets differ in tokens, so a pair whose bitmaps differ too much is no link.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import Scratch, WordIds, as_int64, connected_components, mix64, shingles, split_words, table

#: A partner has at least 75 of 100 tokens of the union.
PERCENT = 75
#: Documents whose tokens are held at once, and bits of each of two hashes by which tokens are ranked. Any order gives the
#: same result; this one keeps common passages out of prefixes. The ranks take 2^22 bytes whatever the number of tokens.
SLICE, RANK_BITS = 1024, 21
#: From this power of two on, by the ranks, a token's documents are dealt to several tasks; copies always are.
HOT_RANK, COPY_SALTS = 15, 64
_PER_HUB = 1024
#: Sets of a group that a task holds at once, and their tokens, on average.
BLOCK, BLOCK_TOKENS = 1024, 1 << 20


def _sets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[list, list[np.ndarray]]]:
    """Ids and token sets of slices of documents."""
    ids = WordIds()
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            part = batch.slice(at, SLICE)
            yield part["doc_id"].to_pylist(), [shingles(ids.array(split_words(t.as_py())), width) for t in part["text"]]


def _fingerprint(tokens: np.ndarray) -> tuple[int, int]:
    a = np.bitwise_xor.reduce(mix64(tokens + np.uint64(1)))
    b = np.add.reduce(mix64(tokens ^ np.uint64(0x5555555555555555)))
    return int(as_int64(a.reshape(1))[0]), int(as_int64(b.reshape(1))[0])


def _bitmap(tokens: np.ndarray) -> bytes:
    """Parities by hash: a power of two of bits, four for each token or more, 2^17 at most."""
    bits = 1 << min(17, max(6, (4 * len(tokens) - 1).bit_length()))
    at = (tokens >> np.uint64(20)).astype(np.int64) & (bits - 1)
    return np.packbits(np.bincount(at, minlength=bits).astype(np.uint8) & 1).tobytes()


def _differences(a: bytes, b: bytes) -> int:
    """Bits in which two bitmaps differ, the longer one folded to the length of the other: at most |A - B| + |B - A|."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    n = min(len(x), len(y))
    x, y = (np.bitwise_xor.reduce(v.reshape(-1, n)) for v in (x, y))
    return int(np.bitwise_count(x ^ y).sum())


def _profiles(docs: DataFrame, width: int) -> DataFrame:
    """Rows of documents (doc_id, n, a 128-bit fingerprint f1 and f2 of the set, and its bitmap) and rows of tokens
    (token, times) that come again within a slice of documents, each set counted once a slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, sets in _sets(batches, width):
            prints = [_fingerprint(s) if len(s) else (0, 0) for s in sets]
            once = {p: s for p, s in zip(prints, sets, strict=True) if len(s)}
            tokens, times = np.unique(np.concatenate([*once.values(), np.zeros(0, np.uint64)]), return_counts=True)
            again = times > 1
            d, t = len(ids), int(again.sum())
            null = lambda n, kind: pa.nulls(n, kind)
            both = lambda x, y: pa.concat_arrays([x, y])
            yield pa.RecordBatch.from_arrays(
                [
                    both(pa.array(ids, pa.int64()), null(t, pa.int64())),
                    both(pa.array([len(s) for s in sets], pa.int64()), null(t, pa.int64())),
                    *[both(pa.array([p[i] for p in prints], pa.int64()), null(t, pa.int64())) for i in (0, 1)],
                    both(pa.array([_bitmap(s) if len(s) else None for s in sets], pa.binary()), null(t, pa.binary())),
                    both(null(d, pa.int64()), pa.array(as_int64(tokens[again]))),
                    both(null(d, pa.int64()), pa.array(times[again].astype(np.int64))),
                ],
                names=["doc_id", "n", "f1", "f2", "bits", "token", "times"],
            )

    return docs.mapInArrow(run, "doc_id long, n long, f1 long, f2 long, bits binary, token long, times long")


def _bucket(tokens: np.ndarray, row: int) -> np.ndarray:
    return (tokens >> np.uint64(64 - RANK_BITS * (row + 1))).astype(np.int64) & ((1 << RANK_BITS) - 1)


def _ranks(profiles: DataFrame) -> np.ndarray:
    """By hash bucket, the logarithm of how often its most frequent token was counted; 0 if none came again.

    A token's rank is the lesser of those of its two buckets, so that a rare one is seldom taken for a frequent one that
    it shares a bucket with; if it is, all documents put it late alike.
    """
    buckets = F.array(
        *[(F.expr(f"shiftrightunsigned(token, {64 - RANK_BITS * (row + 1)}) & {(1 << RANK_BITS) - 1}") + (row << RANK_BITS)).cast("int") for row in (0, 1)]
    )
    counted = profiles.where("token is not null").groupBy("token").agg(F.sum("times").alias("n"))
    found = counted.select(F.explode(buckets).alias("bucket"), F.log2("n").cast("int").alias("rank")).groupBy("bucket").agg(F.max("rank").alias("rank")).toPandas()
    ranks = np.zeros(2 << RANK_BITS, np.uint8)
    ranks[found["bucket"].to_numpy()] = found["rank"].to_numpy()
    return ranks.reshape(2, -1)


def _rank_of(tokens: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    return np.minimum(ranks[0][_bucket(tokens, 0)], ranks[1][_bucket(tokens, 1)])


def _postings(docs: DataFrame, ranks: np.ndarray, width: int) -> DataFrame:
    """token, doc, n, pos (the token's place in the document's order) and salt of prefixes.

    An input partition sends each set on once, so that the copies of a hot text come as a few documents. The salt deals
    the documents of a frequent token to slices; it is -1 for all others.
    """
    held = docs.sparkSession.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = held.value
        seen: set[tuple[int, int]] = set()
        for ids, sets in _sets(batches, width):
            tokens, doc, size, place, salt = [], [], [], [], []
            for i, s in zip(ids, sets, strict=True):
                if i is None or not len(s) or (key := _fingerprint(s)) in seen:
                    continue
                seen.add(key)
                n = len(s)
                keep = n - -(-PERCENT * n // 100) + 1
                rank = _rank_of(s, ranks)
                order = np.argsort(rank, kind="stable")[:keep]
                slices = np.int64(1) << np.maximum(rank[order].astype(np.int64) - HOT_RANK, 0)
                tokens.append(s[order])
                mixed = int(mix64(np.array([i & (2**64 - 1)], np.uint64))[0] >> np.uint64(1))
                salt.append(np.where(slices > 1, mixed & (slices - 1), -1).astype(np.int32))
                doc.append(np.full(keep, i, np.int64))
                size.append(np.full(keep, n, np.int32))
                place.append(np.arange(keep, dtype=np.int32))
            if tokens:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(as_int64(np.concatenate(tokens))), *[pa.array(np.concatenate(x)) for x in (doc, size, place, salt)]], names=["token", "doc", "n", "pos", "salt"]
                )

    return docs.mapInArrow(run, "token long, doc long, n int, pos int, salt int")


def _may_link(n: Column, pos: Column, m: Column, at: Column) -> Column:
    """Whether documents of n and m tokens can link if this token, at these places, is their first in common."""
    fits = F.least(n, m) * 100 >= F.greatest(n, m) * PERCENT
    most = F.least(n - pos, m - at)
    return fits & (most * (100 + PERCENT) >= (n + m) * PERCENT)


def _shared(scratch: Scratch, postings: DataFrame) -> DataFrame:
    """The postings of tokens that several documents have, with the document before and the most central of the band.

    A slice of a frequent token stands for the token, so that no task gets all of its documents.
    """
    rows = postings.withColumn("band", (F.log("n") / float(np.log(100 / PERCENT))).cast("int"))
    by_size = Window.partitionBy("token", "salt").orderBy("band", "n", "doc")
    rows = rows.withColumn("before", F.lag(F.struct("doc", "n", "pos")).over(by_size)).withColumn("after", F.lead("doc").over(by_size))
    rows = rows.where("before is not null or after is not null or salt >= 0")  # a slice may hold one document of many
    central = F.min(F.struct("pos", "doc", "n")).over(Window.partitionBy("token", "salt", "band"))
    return scratch.write(rows.withColumn("first", central).drop("after"), "shared")


def _star(shared: DataFrame) -> DataFrame:
    """Pairs (a, b): each document with the one before it and the central one of its slice, and those of the slices of
    one token with the most central of them all."""
    near = lambda other: shared.where(F.col(f"{other}.doc") != F.col("doc")).where(
        _may_link(F.col("n"), F.col("pos"), F.col(f"{other}.n"), F.col(f"{other}.pos"))
    ).select(F.col(f"{other}.doc").alias("a"), F.col("doc").alias("b"))
    heads = shared.where("salt >= 0").select("token", "band", "first").distinct()  # one a slice
    heads = heads.withColumn("most", F.min("first").over(Window.partitionBy("token", "band"))).where("first.doc != most.doc")
    return near("first").unionByName(near("before")).unionByName(heads.select(F.col("most.doc").alias("a"), F.col("first.doc").alias("b"))).distinct()


def _candidates(pairs: DataFrame, sizes: DataFrame) -> DataFrame:
    """The pairs (a, b) whose bitmaps allow a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, x, y = batch["n"].to_pylist(), batch["x"], batch["y"]
            keep = [_differences(x[i].as_py(), y[i].as_py()) * (100 + PERCENT) <= n[i] * (100 - PERCENT) for i in range(batch.num_rows)]
            yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    a = sizes.select(F.col("doc_id").alias("a"), F.col("n").alias("na"), F.col("bits").alias("x"))
    b = sizes.select(F.col("doc_id").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("y"))
    rows = pairs.join(a, "a").join(b, "b").select("a", "b", (F.col("na") + F.col("nb")).alias("n"), "x", "y")
    return rows.mapInArrow(run, "a long, b long").distinct()


def _verified(scratch: Scratch, texts: DataFrame, sizes: DataFrame, pairs: DataFrame, width: int) -> DataFrame:
    """The pairs (a, b) whose sets reach the threshold.

    The texts of ``a`` are hubs: a hub's partners are streamed past it. A hub with many partners is dealt to several
    tasks, each with its own copy of the hub's text.
    """
    near = scratch.write(_candidates(pairs, sizes), "candidates")
    held = near.join(near.groupBy("a").agg(F.ceil(F.count("*") / _PER_HUB).cast("long").alias("parts")), "a")
    held = scratch.write(held.select("a", "b", F.pmod(F.xxhash64("b"), F.col("parts")).alias("salt")), "pairs")
    hubs = held.select("a", "salt").distinct().join(texts.withColumnRenamed("doc", "a"), "a").select("a", "salt", F.lit(None).cast("long").alias("b"), "text")
    partners = held.join(texts.withColumnRenamed("doc", "b"), "b").select("a", "salt", "b", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, hub, sets = WordIds(), None, []
        for batch in batches:
            found = []
            for a, salt, b, text in zip(batch["a"].to_pylist(), batch["salt"].to_pylist(), batch["b"].to_pylist(), batch["text"], strict=True):
                own = shingles(ids.array(split_words(text.as_py())), width)
                if (a, salt) != hub:
                    hub, sets = (a, salt), []
                if b is None:
                    sets.append(own)  # more than one if rows share an id
                    continue
                for s in sets:
                    both = len(np.intersect1d(s, own, assume_unique=True))
                    if both and 100 * both >= PERCENT * (len(s) + len(own) - both):
                        found.append((a, b))
                        break
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], names=["a", "b"])

    dealt = hubs.unionByName(partners).repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())
    links = scratch.write(dealt.mapInArrow(run, "a long, b long"), "links")
    scratch.drop(near)
    scratch.drop(held)
    return links


def _open(matrix: DataFrame) -> DataFrame:
    """Pairs of a query and a document of a group that it qualifies for. ``matrix`` has token, doc, n, pos and g."""
    spread = matrix.groupBy("token").agg(F.min("g").alias("low"), F.max("g").alias("high")).where("low != high").select("token")
    matrix = matrix.join(spread, "token", "left_semi")
    groups = matrix.groupBy("token", "g").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.max(F.col("n") - F.col("pos")).alias("rest"))
    q, u, m = matrix.alias("q"), groups.alias("u"), matrix.alias("m")
    reach = F.greatest(F.col("u.least"), F.ceil(F.col("q.n") * PERCENT / 100))  # the smallest partner there could be
    qualifies = (
        (F.col("q.token") == F.col("u.token"))
        & (F.col("u.g") < F.col("q.g"))
        & (reach <= F.col("u.most"))
        & (reach * PERCENT <= F.col("q.n") * 100)
        & (F.least(F.col("q.n") - F.col("q.pos"), F.col("u.rest")) * (100 + PERCENT) >= (F.col("q.n") + reach) * PERCENT)
    )
    opened = q.join(u, qualifies).select("q.token", F.col("u.g").alias("g"), F.col("q.doc").alias("doc"), F.col("q.n").alias("n"), F.col("q.pos").alias("pos")).alias("o")
    meets = (F.col("o.token") == F.col("m.token")) & (F.col("o.g") == F.col("m.g")) & _may_link(F.col("o.n"), F.col("o.pos"), F.col("m.n"), F.col("m.pos"))
    return opened.join(m, meets).select(F.col("m.doc").alias("a"), F.col("o.doc").alias("b")).distinct()


def _copies(known: DataFrame) -> DataFrame:
    """Pairs (a, b) that connect equal sets: each with the first of its slice, and those with the first of all."""
    salted = known.select("n", "f1", "f2", "doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(COPY_SALTS)).alias("salt"))
    slices = salted.withColumn("b", F.min("doc_id").over(Window.partitionBy("n", "f1", "f2", "salt")))
    heads = slices.where("doc_id = b").select("n", "f1", "f2", "b").distinct()
    heads = heads.withColumn("first", F.min("b").over(Window.partitionBy("n", "f1", "f2"))).where("b != first")
    return slices.where("doc_id != b").select(F.col("doc_id").alias("a"), "b").unionByName(heads.select(F.col("b").alias("a"), F.col("first").alias("b")))


def _grouped(docs: DataFrame, width: int) -> tuple[Scratch, DataFrame, DataFrame, DataFrame]:
    """Scratch, texts (doc, text), sizes (doc_id, n, f1, f2, bits) of every row, and groups (node, component)."""
    scratch = Scratch(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    profiles = scratch.write(_profiles(docs, width), "profiles")
    sizes = profiles.where("f1 is not null").select("doc_id", "n", "f1", "f2", "bits")
    known = sizes.where("n > 0 and doc_id is not null")
    copies = _copies(known)
    shared = _shared(scratch, _postings(docs, _ranks(profiles), width))
    texts = docs.select(F.col("doc_id").alias("doc"), "text").where("text is not null")
    texts = scratch.write(texts.join(shared.select("doc").distinct(), "doc", "left_semi"), "texts")
    groups = connected_components(scratch, copies.unionByName(_verified(scratch, texts, known, _star(shared), width)))
    matrix = shared.select("token", "doc", "n", "pos").join(groups, F.col("doc") == F.col("node"), "left")
    matrix = scratch.write(matrix.select("token", "doc", "n", "pos", F.coalesce("component", "doc").alias("g")), "matrix")
    scratch.drop(shared)
    more = _verified(scratch, texts, known, _open(matrix), width)
    scratch.drop(matrix)
    scratch.drop(texts)
    if not more.isEmpty():
        # the groups stand for the links that made them
        stars = groups.select(F.col("node").alias("a"), F.col("component").alias("b"))
        groups = connected_components(scratch, stars.unionByName(more))
    return scratch, docs.select(F.col("doc_id").alias("doc"), "text"), sizes, groups


def _overlaps(tokens: np.ndarray, owner: np.ndarray, many: int, s: np.ndarray) -> np.ndarray:
    """How many tokens ``s`` shares with each of ``many`` sets, given as sorted tokens and whose they are."""
    lo = np.searchsorted(tokens, s, "left")
    times = np.searchsorted(tokens, s, "right") - lo
    at = np.repeat(lo - np.concatenate([[0], np.cumsum(times)[:-1]]), times) + np.arange(times.sum())
    return np.bincount(owner[at], minlength=many)


def _partial_links(tasks: DataFrame, width: int) -> DataFrame:
    """f1, f2 and links (a part of the sum) of sets with links, weighted by copies.

    A task holds one block of a group's sets and streams past it those of the group's later blocks.
    """
    arrow = pa.schema([("f1", pa.int64()), ("f2", pa.int64()), ("links", pa.int64())])

    def batch_of(rows: list[tuple[int, int, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], pa.int64()) for j in range(3)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, key, last = WordIds(), None, None
        own: list[tuple[tuple[int, int], int, np.ndarray]] = []
        tokens = owner = size = weights = links = None

        def build() -> None:
            nonlocal tokens, owner, size, weights, links
            size = np.array([len(s) for _, _, s in own])
            weights = np.array([w for _, w, _ in own], np.int64)
            links = np.zeros(len(own), np.int64)
            tokens, owner = np.concatenate([s for _, _, s in own]), np.repeat(np.arange(len(own)), size)
            order = np.argsort(tokens, kind="stable")
            tokens, owner = tokens[order], owner[order]
            for i, (_, _, s) in enumerate(own):
                links[i] = weights[linked_to(s)].sum() - weights[i]  # less itself

        def linked_to(s: np.ndarray) -> np.ndarray:
            both = _overlaps(tokens, owner, len(own), s)
            return 100 * both >= PERCENT * (size + len(s) - both)

        def done() -> list[tuple[int, int, int]]:
            if own and tokens is None:
                build()
            return [(*f, int(n)) for (f, _, _), n in zip(own, links, strict=True) if n] if own else []

        for batch in batches:
            found = []
            columns = [batch[c].to_pylist() for c in ("component", "to", "visitor", "f1", "f2", "weight")]
            for component, to, visitor, f1, f2, weight, text in zip(*columns, batch["text"], strict=True):
                if (component, to) != key:
                    found += done()
                    key, own, tokens, last = (component, to), [], None, None
                s = shingles(ids.array(split_words(text.as_py())), width)
                if not len(s) or _fingerprint(s) != (f1, f2):
                    continue  # another row of the same id
                if last == (f1, f2):
                    continue  # rows of one set and id come one after the other
                last = f1, f2
                if not visitor:
                    own.append(((f1, f2), weight, s))
                    continue
                if not own:
                    continue
                if tokens is None:
                    build()
                to_these = linked_to(s)
                if to_these.any():
                    links[to_these] += weight
                    found.append((f1, f2, int(weights[to_these].sum())))
            if found:
                yield batch_of(found)
        if found := done():
            yield batch_of(found)

    dealt = tasks.repartition("component", "to").sortWithinPartitions("component", "to", "visitor", "f1", "f2")
    return dealt.mapInArrow(run, "f1 long, f2 long, links long")


def linked(docs: DataFrame, width: int = 5) -> DataFrame:
    """What components() gives and n_links: the number of other rows with an id whose sets reach the threshold.

    Every link is inside a component, so the distinct sets of a component are all compared, exactly, and counted with
    their copies. A component of many sets is dealt in blocks, as op1's cells are; sums leave a task, never pairs.
    """
    scratch, texts, sizes, groups = _grouped(docs, width)
    known = sizes.where("n > 0 and doc_id is not null").join(groups, F.col("doc_id") == F.col("node"), "left")
    sets = known.groupBy("n", "f1", "f2").agg(F.min("doc_id").alias("doc"), F.min(F.coalesce("component", "doc_id")).alias("component"), F.count("*").alias("weight"))
    sets = scratch.write(sets, "sets")
    blocks = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / BLOCK_TOKENS)).cast("int")
    spread = scratch.write(sets.groupBy("component").agg(F.count("*").alias("many"), blocks.alias("blocks")).where("many > 1").drop("many"), "spread")
    # Components of several blocks are few; without them, no component is hot.
    large = F.broadcast(spread.where("blocks > 1"))
    members = sets.join(large, "component").unionByName(sets.join(large.drop("blocks"), "component", "left_anti").join(spread.where("blocks = 1"), "component"))
    members = members.withColumn("block", F.pmod(F.xxhash64("f1", "f2"), F.col("blocks")).cast("int")).drop("n", "blocks")
    members = members.join(texts.where("text is not null"), "doc")
    tasks = members.withColumn("to", F.explode(F.sequence(F.lit(0), "block"))).withColumn("visitor", F.col("to") != F.col("block")).drop("doc", "block")
    links = scratch.write(_partial_links(tasks, width).groupBy("f1", "f2").agg(F.sum("links").alias("links")), "links")
    counts = sets.join(links, ["f1", "f2"], "left").select("n", "f1", "f2", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    every = sizes.join(counts, ["n", "f1", "f2"], "left").join(groups, F.col("doc_id") == F.col("node"), "left")
    n_links = F.when(F.col("doc_id").isNotNull(), F.col("n_links"))
    return every.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"), F.coalesce(n_links, F.lit(0)).cast("long").alias("n_links"))


def components(docs: DataFrame, width: int = 5) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of ``docs``.

    n_shingles counts the distinct shingles of ``width`` words; a text with fewer words is one shingle; a null or empty
    text, or one of white space, has none and links with nothing. component_id is the smallest doc_id that links reach.
    Rows that share an id count as one document with several texts; a row without an id has no component. Further
    columns are ignored; an empty table gives no rows. Shingles are told apart by 64-bit hashes.
    """
    _, _, sizes, groups = _grouped(docs, width)
    return sizes.join(groups, F.col("doc_id") == F.col("node"), "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def deduplicated(docs: DataFrame, width: int = 5) -> DataFrame:
    """The rows of ``docs``, all columns, one document of each group: the first by id.

    Of rows that repeat (one id, one set of shingles) one stays, the least as a text of all its columns. A row without
    an id goes if a row with one has its set, else one of the rows with its set stays. Rows without any shingle are no
    copies of each other, but of those that share id and text one stays. Only rows that share an id or have none are
    grouped with their texts, with partial aggregates, so that a row that comes again and again is no hot spot.
    """
    scratch, _, sizes, groups = _grouped(docs, width)
    tag = uuid.uuid4().hex[:12]  # for names that no column of the documents has
    own, gone_id = F.col("doc_id").cast("long"), f"__gone_{tag}"
    gone = groups.where("node != component").select(F.col("node").alias(gone_id))
    rows = docs.join(gone, own == F.col(gone_id), "left_anti")
    again = sizes.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("many")).where("many > 1").select(F.col("doc_id").alias(gone_id))
    if sizes.where("doc_id is null").isEmpty() and again.isEmpty():
        return rows
    again = scratch.write(again, "again")
    single = rows.where(own.isNotNull()).join(again, own == F.col(gone_id), "left_anti")
    several = rows.join(again, own == F.col(gone_id), "left_semi").unionByName(rows.where(own.isNull()))

    names = [f"__{c}_{tag}" for c in ("n", "f1", "f2")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = WordIds()
        for batch in batches:
            sets = [shingles(ids.array(split_words(t.as_py())), width) for t in batch["text"]]
            prints = [(len(x), *_fingerprint(x)) if len(x) else (0, 0, 0) for x in sets]
            for k, name in enumerate(names):
                batch = batch.append_column(name, pa.array([p[k] for p in prints], pa.int64()))
            yield batch

    schema = StructType([*several.schema.fields, *[StructField(name, LongType()) for name in names]])
    marked = several.mapInArrow(run, schema)
    with_id = sizes.where("n > 0 and doc_id is not null").select(*[F.col(c).alias(name) for c, name in zip(("n", "f1", "f2"), names, strict=True)]).distinct()
    nameless = marked.where(own.isNull()).join(with_id, names, "left_anti")
    key = [own.alias(gone_id), *names, F.when(F.col(names[0]) == 0, F.sha2(F.col("text").cast("string"), 256)).alias(f"__text_{tag}")]
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    kept = marked.where(own.isNotNull()).unionByName(nameless).groupBy(*key).agg(F.min_by(whole, F.to_json(whole)).alias("row"))
    return single.unionByName(kept.select("row.*"))


def op4_token_group_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(table(spark, sf_dir, "documents"))


def op4_token_group_jaccard_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(table(spark, sf_dir, "documents"))


OP4_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
  FROM documents
), s AS (
  SELECT doc_id, unnest(list_distinct(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
    ELSE list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i : i + 4], ' ')) END)) AS shingle
  FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
  JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 75 * (x.n + y.n - count(*))
), reached AS (
  SELECT a AS node, b AS other FROM links
  UNION SELECT r.node, l.b FROM reached r JOIN links l ON r.other = l.a
), component AS (SELECT node, min(other) AS least FROM reached GROUP BY node)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(c.least, d.doc_id)) AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN component c ON c.node = d.doc_id
"""
OP4_LINKS_SQL = OP4_SQL.replace("AS component_id\nFROM", "AS component_id,\n  (SELECT count(*) FROM links WHERE links.a = d.doc_id) AS n_links\nFROM")
