"""Variable-capacity best-fit: pieces of documents into sequences of several permitted lengths.

Pieces are placed in descending length. A piece goes to the open bin that it leaves least room in. Where none has room,
a bin is opened: for each permitted length the pieces that are still to come are filled in greedily, and the length with
the least cost for a packed token wins, the cost being that of the least length which the contents would be downsized
to. At the end every bin is downsized to the least permitted length that holds its contents.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .tokens import Counter, counter

CAPACITIES = (512, 1024, 2048, 4096, 8192)
#: What a sequence costs besides its length, in tokens.
OVERHEAD = 32
#: Documents that are packed together, and bytes of their texts. A task holds one block; each wastes a few bins.
BLOCK, BLOCK_BYTES = 8192, 32 << 20
#: Pieces that an estimate looks ahead.
_AHEAD = 64


def cost(capacity: int) -> int:
    return capacity + OVERHEAD


def best_fit(lengths: Sequence[int], capacities: Sequence[int] = CAPACITIES) -> tuple[list[int], list[int]]:
    """The bin of each piece, and the capacity of each bin. Pieces are no longer than the largest capacity."""
    capacities = sorted(capacities)
    order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    left: dict[int, int] = {}
    for n in lengths:
        left[n] = left.get(n, 0) + 1
    distinct = sorted(left)
    room: dict[int, list[int]] = {}  # bins by the room in them
    rooms: list[int] = []
    bin_of, used, size = [0] * len(lengths), [], []

    def take(n: int) -> None:
        left[n] -= 1
        if not left[n]:
            del left[n]
            distinct.pop(bisect.bisect_left(distinct, n))

    def filled(space: int) -> int:
        """Tokens that the coming pieces, longest first, would put into the space."""
        start, gone = space, {}
        at = bisect.bisect_right(distinct, space)
        for _ in range(_AHEAD):
            at = min(at, bisect.bisect_right(distinct, space))
            while at and gone.get(distinct[at - 1], 0) >= left[distinct[at - 1]]:
                at -= 1
            if not at:
                break
            n = distinct[at - 1]
            copies = min(space // n, left[n] - gone.get(n, 0))
            gone[n] = gone.get(n, 0) + copies
            space -= copies * n
        return start - space

    def open_bin(n: int) -> int:
        best = None
        for c in capacities[bisect.bisect_left(capacities, n) :]:
            tokens = n + filled(c - n)
            price = cost(capacities[bisect.bisect_left(capacities, tokens)]) / tokens
            if best is None or price < best[0]:
                best = (price, c)
        return best[1]

    for i in order:
        n = lengths[i]
        take(n)
        at = bisect.bisect_left(rooms, n)
        if at < len(rooms):
            free = rooms[at]
            b = room[free].pop()
            if not room[free]:
                del room[free]
                rooms.pop(at)
        else:
            b, free = len(used), open_bin(n)
            used.append(0)
            size.append(free)
        bin_of[i] = b
        used[b] += n
        if free > n:
            if free - n not in room:
                room[free - n] = []
                bisect.insort(rooms, free - n)
            room[free - n].append(b)
    return bin_of, [capacities[bisect.bisect_left(capacities, u)] for u in used]


_RUN = re.compile(r"[^\x20\x09-\x0D]+")


def cut(text: str, largest: int, count: Counter | None = None, total: int | None = None) -> tuple[list[int], list[int]]:
    """The lengths of a text's pieces, the end token included, and the places (code points) where they begin and end.

    Lengths are tokens of ``count``, or words without one; ``total`` tells them if they are known. A long text is cut
    where a run between white space begins, so that the pieces have just the tokens of the whole; only a run that is
    longer than the largest sequence is cut inside, between two of its tokens.
    """
    if total is None:
        total = count.by_runs([text])[0] if count else len(text.encode("utf-8", "surrogatepass").split())
    if total < largest:
        return [total + 1], [0, len(text)]
    starts = [m.start() for m in _RUN.finditer(text)]
    runs = count.by_run(text) if count else [1] * len(starts)
    sizes, cuts, held = [], [0], 0
    for k, (at, n) in enumerate(zip(starts, runs, strict=True)):
        if held + n > largest:
            if held:
                sizes.append(held)
                cuts.append(at)
                held = 0
            if n > largest:
                inner = count.offsets(text[at : starts[k + 1] if k + 1 < len(starts) else len(text)])
                for first in range(largest, n, largest):
                    sizes.append(largest)
                    cuts.append(at + inner[first][1])
                    n -= largest
        held += n
    if held == largest:  # no room for the end
        sizes.append(held)
        cuts.append(len(text))
        held = 0
    return [*sizes, held + 1], [*cuts, len(text)]


def pack(docs: DataFrame, capacities: Sequence[int] = CAPACITIES, block: int = BLOCK, with_text: bool = False, tokenizer: str | None = None) -> DataFrame:
    """One row a sequence: seq_id, capacity, n_tokens, pieces and, if asked for, text.

    ``pieces`` lists (doc_id, piece, start, n_tokens), start being the piece's first token. A document's tokens are
    those of the tokenizer file ``tokenizer``, or its words ``[^\\x20\\x09-\\x0D]+`` without one, and an end token, so null
    and empty texts have one. What is longer than the largest capacity is cut (see :func:`cut`). Repeated rows are
    packed one by one, null ids as they are, and an empty table gives no sequence; other columns are ignored.

    Rows are dealt out by a hash, sorted, and packed in blocks of a number of documents and of bytes: a task holds one
    block however many rows reach it, and a run on the same rows and settings gives the same sequences. Only ids and
    lengths are shuffled unless texts are asked for.
    """
    largest = max(capacities)

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(tokenizer) if tokenizer else None
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                texts = b["text"].to_pylist()
                totals = count.by_runs(texts) if count else [len(t.encode("utf-8", "surrogatepass").split()) for t in texts]
                parts = [cut(t, largest, count, n) for t, n in zip(texts, totals, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [b["doc_id"], pa.array([p[0] for p in parts], pa.list_(pa.int64())), pa.array([p[1] for p in parts], pa.list_(pa.int64())), b["key"], *([b["text"]] if with_text else [])],
                    names=["doc_id", "sizes", "cuts", "key", *(["text"] if with_text else [])],
                )

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first, done = TaskContext.get().partitionId() << 32, 0
        for rows in _blocks(batches, block):
            items = []  # (document, piece, start, tokens)
            for d, sizes in enumerate(rows["sizes"]):
                start = 0
                for p, n in enumerate(sizes):
                    items.append((d, p, start, n))
                    start += n
            bin_of, size = best_fit([x[3] for x in items], capacities)
            contents: list[list[int]] = [[] for _ in size]
            for i, b in enumerate(bin_of):
                contents[b].append(i)
            ids = rows["doc_id"]
            for lo in range(0, len(size), 256):
                some = range(lo, min(len(size), lo + 256))
                out = {
                    "seq_id": [first + done + b for b in some],
                    "capacity": [size[b] for b in some],
                    "n_tokens": [sum(items[i][3] for i in contents[b]) for b in some],
                    "pieces": [[{"doc_id": ids[items[i][0]], "piece": items[i][1], "start": items[i][2], "n_tokens": items[i][3]} for i in contents[b]] for b in some],
                }
                if with_text:
                    part = lambda d, p: rows["text"][d][rows["cuts"][d][p] : rows["cuts"][d][p + 1]]  # noqa: E731, B023
                    out["text"] = ["\n".join(part(items[i][0], items[i][1]) for i in contents[b]) for b in some]
                yield pa.RecordBatch.from_pydict(out, schema=arrow)
            done += len(size)

    schema = "seq_id long, capacity long, n_tokens long, pieces array<struct<doc_id:long,piece:long,start:long,n_tokens:long>>" + ", text string" * with_text
    piece = pa.struct([("doc_id", pa.int64()), ("piece", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
    arrow = pa.schema([("seq_id", pa.int64()), ("capacity", pa.int64()), ("n_tokens", pa.int64()), ("pieces", pa.list_(piece)), *([("text", pa.string())] if with_text else [])])
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64("doc_id", text).alias("key"))
    total = rows.agg(F.count("*").alias("n"), F.sum(F.octet_length("text") if with_text else F.lit(0)).alias("bytes")).first()
    parts = max(1, -(-total["n"] // (2 * block)), -(-(total["bytes"] or 0) // (2 * BLOCK_BYTES)))
    found = rows.mapInArrow(lengths, "doc_id long, sizes array<long>, cuts array<long>, key long" + ", text string" * with_text)
    return found.repartition(parts, "key").sortWithinPartitions("doc_id", "key").mapInArrow(packed, schema)


def _blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[dict[str, list]]:
    """Rows in blocks of ``size``, or fewer where their texts or lists fill the bytes of a block."""
    held: dict[str, list] = {}
    used = 0
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            part = batch.slice(at, 64)
            rows = part.to_pydict()
            for k in range(part.num_rows):
                for name, values in rows.items():
                    held.setdefault(name, []).append(values[k])
                used += 64 + 16 * len(rows["sizes"][k]) + (len(rows["text"][k]) if "text" in rows else 0)
                if len(held["sizes"]) >= size or used >= BLOCK_BYTES:
                    yield held
                    held, used = {}, 0
    if held:
        yield held


def op7_variable_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    packed = pack(table(spark, sf_dir, "documents"), tokenizer=public_tokenizers.path("word_bpe_49k.json"))
    placed = packed.select("seq_id", "capacity", F.col("n_tokens").alias("seq_tokens"), F.posexplode("pieces").alias("position", "x"))
    return placed.select(
        "x.doc_id", "x.piece", "x.start", "x.n_tokens", "seq_id", F.col("position").cast("long").alias("position"), "capacity", "seq_tokens"
    )
