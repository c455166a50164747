"""Hidden Markov language model, trained by Baum-Welch over all training texts.

A token emits a symbol: one of the most frequent words has its own, any other word that of its class (what it ends in),
and a text ends with the end symbol. A word of a class has a share of its class by its count, and each class keeps a
share for words that training never saw. So the model gives every sequence of words a probability, and

    log P(text) = log P(its symbols), by the scaled forward recursion, + sum over words of log P(word | its symbol).

The E step runs where the texts are: each task sums the expected counts of its texts by forward and backward recursions
that take many texts at a time, long ones in pieces side by side, and the counts of all tasks are summed by symbol. Texts are encoded once, and the rounds
read their symbols. The model has a fixed size; the word counts have not, so they stay a table, and the texts' rare words
are joined with it.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, as_int64, split_words, table

STATES, ROUNDS = 8, 3
#: Words with a symbol of their own, and words whose counts every task holds: bounds of what is broadcast.
SYMBOLS, HELD = 8_192, 1 << 18
_BITS = 9
CLASSES = 1 << _BITS
END = SYMBOLS + CLASSES  # its number among the symbols
WIDTH = END + 1
#: Tokens that one pair of recursions holds, the longest text that goes through one of its lanes as a whole, and the
#: pieces of longer ones.
_CHUNK, _WHOLE, _PIECE = 300_000, 32_768, 4_096
#: Words that a worker remembers, and the bytes of the longest of them.
_CACHED_WORDS, _CACHED_BYTES = 1 << 18, 64
_ALPHA = 0.1  # added to every count of the base and inside a class


class Ids(dict):
    """Of each word 55 bits of hash, then 9 bits of class: a hash of its last two letters and whether a mark follows."""

    def __missing__(self, word: bytes) -> int:
        core = word.rstrip(b".,;:!?\"')]}")
        kind = (zlib.crc32(core.decode("utf-8", "replace")[-2:].encode("utf-8")) & 255) << 1 | (len(core) < len(word))
        found = (xxhash.xxh3_64_intdigest(word) >> _BITS << _BITS) | kind
        if len(word) <= _CACHED_BYTES:
            if len(self) >= _CACHED_WORDS:
                self.clear()
            self[word] = found
        return found

    def array(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def in_training(doc_id):
    """False for a tenth of the ids, by a checksum of the id as text, and for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 10 != 0, F.lit(False))


@dataclass
class Parameters:
    """``emit`` has a row for each symbol; the columns of each state sum to 1."""

    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray


def _time_major(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For sequences in descending length: how many are alive at each step, and where each step's tokens begin."""
    alive = np.searchsorted(-lengths, -np.arange(lengths[0]), side="left") if len(lengths) else np.zeros(0, np.int64)
    return alive, np.concatenate(([0], np.cumsum(alive)))


def _arranged(sequences: list[np.ndarray], alive: np.ndarray, begin: np.ndarray) -> np.ndarray:
    out = np.empty(begin[-1], np.int64)
    for i, s in enumerate(sequences):
        out[begin[: len(s)] + i] = s
    return out


def forward(p: Parameters, sequences: list[np.ndarray], keep: bool = False, first: np.ndarray | None = None):
    """Natural-log likelihoods of symbol sequences in descending length, and the states' shares at their ends.

    ``first`` has the states' shares before each sequence's first symbol, those of a text's start by default. Only the
    likelihoods come back without it; with ``keep`` also what backward needs.
    """
    lengths = np.array([len(s) for s in sequences])
    alive, begin = _time_major(lengths)
    symbols = _arranged(sequences, alive, begin)
    e = p.emit[symbols]
    alpha = np.empty_like(e) if keep else None
    scale = np.empty(len(symbols))
    a = np.broadcast_to(p.start, (len(sequences), len(p.start))) if first is None else first
    last = np.empty((len(sequences), len(p.start)))
    for t, m in enumerate(alive):
        lo, hi = begin[t], begin[t + 1]
        a = (a if t == 0 else a[:m] @ p.move) * e[lo:hi]
        c = a.sum(1)
        a = a / c[:, None]
        scale[lo:hi] = c
        last[:m] = a
        if keep:
            alpha[lo:hi] = a
    logs = np.log(scale)
    total = np.zeros(len(sequences))
    for t, m in enumerate(alive):
        total[:m] += logs[begin[t] : begin[t + 1]]
    if keep:
        return total, symbols, e, alpha, scale, alive, begin, last
    return total if first is None else (total, last)


@dataclass
class Pieces:
    """Texts in pieces that go through the recursions side by side, and what each piece has to know of the others.

    Of a long text's pieces, one pass gives the matrix from the states before a piece to those at its end; a product
    of these along the text gives each piece the states before its first symbol (``first``), and one against it what
    follows its last (``after``). So a text of any length takes as many steps as a piece, and the result is exact.
    """

    parts: list[np.ndarray]
    text: np.ndarray
    first: np.ndarray
    after: np.ndarray


def pieces(p: Parameters, sequences: list[np.ndarray], backward: bool = True) -> Pieces:
    parts, text, states = [], [], len(p.start)
    for k, s in enumerate(sequences):
        step = _PIECE if len(s) > _WHOLE else len(s)
        for at in range(0, len(s), step):
            parts.append(s[at : at + step])
            text.append(k)
    first, after = np.tile(p.start, (len(parts), 1)), np.ones((len(parts), states))
    owner = np.array(text, np.int64)
    long = np.flatnonzero(np.bincount(owner, minlength=1)[owner] > 1) if len(owner) else owner
    if not len(long):
        return Pieces(parts, owner, first, after)
    # By piece of a long text: row i is the states' shares at its end, by likelihood, if it begins after state i.
    through = np.empty((len(parts), states, states))
    unit = np.eye(states)
    order = sorted(long.tolist(), key=lambda i: -len(parts[i]))
    step = max(1, _CHUNK // (_PIECE * states))
    for lo in range(0, len(order), step):
        some = order[lo : lo + step]
        log, end = forward(p, [parts[i] for i in some for _ in range(states)], first=np.tile(unit, (len(some), 1)))
        log, end = log.reshape(len(some), states), end.reshape(len(some), states, states)
        through[some] = np.exp(log - log.max(1, keepdims=True))[:, :, None] * end
    for at, i in enumerate(long):
        if at and owner[long[at - 1]] == owner[i]:
            end = first[i - 1] @ through[i - 1]
            first[i] = end / end.sum() @ p.move
    for at in range(len(long) - 2, -1, -1) if backward else ():
        i = long[at]
        if owner[long[at + 1]] == owner[i]:
            # At the end of this piece, by state: the likelihood of the rest, to a factor.
            rest = p.move @ (through[i + 1] @ after[i + 1])
            after[i] = rest / rest.max()
    return Pieces(parts, owner, first, after)


@dataclass
class Counts:
    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray
    log_likelihood: float = 0.0

    @classmethod
    def zero(cls, states: int) -> Counts:
        return cls(np.zeros(states), np.zeros((states, states)), np.zeros((WIDTH, states)))


def expect(p: Parameters, sequences: list[np.ndarray], into: Counts, known: Pieces | None = None, picked: list[int] | None = None) -> tuple[np.ndarray, np.ndarray] | None:
    """Adds the expected counts of symbol sequences in descending length, which are whole texts or pieces of ``known``.

    Of pieces it returns the states' shares at their ends and the weights of their first symbols, of which
    :func:`joints` makes the counts of moves between pieces.
    """
    first = None if known is None else known.first[picked]
    total, symbols, e, alpha, scale, alive, begin, last = forward(p, sequences, keep=True, first=first)
    after = np.ones_like(last) if known is None else known.after[picked]
    after = after / (last * after).sum(1, keepdims=True)
    beta = np.ones((0, len(p.start)))
    gamma = alpha  # overwritten step by step, from the last
    for t in range(len(alive) - 1, -1, -1):
        lo, hi = begin[t], begin[t + 1]
        m, going = alive[t], len(beta)
        here = after[:m].copy()  # the others end at this step
        if going:
            nxt = slice(begin[t + 1], begin[t + 2])
            w = e[nxt] * beta / scale[nxt, None]
            into.move += (alpha[lo : lo + going].T @ w) * p.move
            here[:going] = w @ p.move.T
        beta = here
        gamma[lo:hi] = alpha[lo:hi] * here
    opening = np.ones(alive[0], bool) if known is None else np.array([i == 0 or known.text[i - 1] != known.text[i] for i in picked])
    into.start += gamma[: alive[0]][opening].sum(0)
    for k in range(len(p.start)):
        into.emit[:, k] += np.bincount(symbols, gamma[:, k], WIDTH)
    into.log_likelihood += float(total.sum())
    return None if known is None else (last, e[: alive[0]] * beta / scale[: alive[0], None])


def joints(p: Parameters, known: Pieces, last: np.ndarray, weight: np.ndarray, into: Counts) -> None:
    """Adds the expected moves from the last symbol of a piece to the first of the next one of the same text."""
    at = np.flatnonzero(known.text[1:] == known.text[:-1])
    if len(at):
        into.move += (last[at].T @ weight[at + 1]) * p.move


def expect_all(p: Parameters, sequences: list[np.ndarray], into: Counts) -> None:
    """Adds the expected counts of whole texts of any length, in any order."""
    known = pieces(p, sequences)
    last, weight = np.empty_like(known.first), np.empty_like(known.first)
    for part in _chunks(known.parts):
        last[part], weight[part] = expect(p, [known.parts[i] for i in part], into, known, part)
    joints(p, known, last, weight, into)


def likelihoods(p: Parameters, sequences: list[np.ndarray]) -> np.ndarray:
    """Natural-log likelihoods of whole texts of any length, in any order."""
    known = pieces(p, sequences, backward=False)
    total = np.zeros(len(sequences))
    for part in _chunks(known.parts):
        log, _ = forward(p, [known.parts[i] for i in part], first=known.first[part])
        np.add.at(total, known.text[part], log)
    return total


def maximised(c: Counts, prior: np.ndarray) -> Parameters:
    """The parameters of the expected counts. ``prior`` is the symbols' share of all tokens, over 0 everywhere."""
    emit = c.emit + prior[:, None]
    move = c.move + 0.1
    start = c.start + 0.1
    return Parameters(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0))


def initial(pairs: np.ndarray, class_share: np.ndarray, prior: np.ndarray, classes: np.ndarray, states: int) -> Parameters:
    """States from which classes follow and precede alike: k-means over the classes' neighbours in all training texts,
    then :func:`follow`.

    ``pairs`` counts which class follows which, ``classes`` gives each symbol's class.
    """
    after = pairs + 1e-3
    profile = np.sqrt(np.concatenate([after / after.sum(1, keepdims=True), (after / after.sum(0)).T], 1))
    weight = class_share + 1e-12
    order = np.argsort(-weight)
    centres = profile[order[:1]]
    for _ in range(states - 1):  # each next centre is the class farthest from the others, by weight
        far = ((profile[:, None] - centres[None]) ** 2).sum(2).min(1) * np.sqrt(weight)
        centres = np.concatenate([centres, profile[[far.argmax()]]])
    for _ in range(30):
        own = ((profile[:, None] - centres[None]) ** 2).sum(2).argmin(1)
        for k in range(states):
            if weight[own == k].sum() > 0:
                centres[k] = np.average(profile[own == k], axis=0, weights=weight[own == k])
    member = np.full((len(profile), states), 0.2 / states)
    member[np.arange(len(profile)), own] += 0.8
    share = class_share + 1e-9
    emit, joint = follow(pairs, member.T * share, member.T @ pairs @ member + 0.1)
    start = joint.sum(1) + 1e-3
    emit = prior[:, None] * (emit / (share / share.sum())).T[classes]
    return Parameters(start / start.sum(), joint / joint.sum(1, keepdims=True), emit / emit.sum(0))


def follow(pairs: np.ndarray, emit: np.ndarray, joint: np.ndarray, least: float = 1e-5, most: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """Expectation maximisation of the pairs alone: P(a, b) = sum over states k, l of joint[k, l] emit[k, a] emit[l, b].

    Rounds end when the log-likelihood gains less than a share ``least`` of itself, or after ``most``. They take a matrix
    of fixed size whatever the texts, so that the rounds over all texts start close to their goal.
    """
    emit, joint = emit / emit.sum(1, keepdims=True), joint / joint.sum()
    floor, before = emit.mean(0), -np.inf
    for _ in range(most if pairs.sum() else 0):
        share = emit.T @ joint @ emit
        now = float((pairs * np.log(share, where=pairs > 0, out=np.zeros_like(share))).sum())
        if now - before < least * abs(now):
            break
        before, ratio = now, np.divide(pairs, share, where=pairs > 0, out=np.zeros_like(share))
        seen = emit * (joint @ emit @ ratio.T + joint.T @ emit @ ratio) + floor
        joint = joint * (emit @ ratio @ emit.T) + 0.1
        emit, joint = seen / seen.sum(1, keepdims=True), joint / joint.sum()
    return emit, joint


def _chunks(sequences: list[np.ndarray]) -> Iterator[list[int]]:
    """Places of sequences, in descending length, so many that their tokens fit."""
    part, n = [], 0
    for i in sorted(range(len(sequences)), key=lambda i: -len(sequences[i])):
        if part and n + len(sequences[i]) > _CHUNK:
            yield part
            part, n = [], 0
        part.append(i)
        n += len(sequences[i])
    if part:
        yield part


def _symbols(ids: np.ndarray, top: np.ndarray) -> np.ndarray:
    """The symbols of a text's words, then the end. ``top``: the ids with a symbol of their own, ascending."""
    out = np.empty(len(ids) + 1, np.int32)
    out[:-1] = SYMBOLS + (ids & np.uint64(CLASSES - 1)).astype(np.int32)
    if len(top):
        at = np.minimum(np.searchsorted(top, ids), len(top) - 1)
        out[:-1] = np.where(top[at] == ids, at, out[:-1])
    out[-1] = END
    return out


@dataclass
class Vocabulary:
    """``words`` is the table of counts (id, n); the most frequent ids, ``held``, and their counts are arrays too."""

    words: DataFrame
    held: np.ndarray
    held_counts: np.ndarray
    top: np.ndarray
    prior: np.ndarray
    classes: np.ndarray
    class_total: np.ndarray
    class_share: np.ndarray
    pairs: np.ndarray
    tokens: int
    types: int
    ends: int


def count_words(docs: DataFrame) -> DataFrame:
    """kind, id, n: how often (0) each word, (1) each pair of classes and (2) the end (id 0) comes in ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Ids()
        for b in batches:
            found, pairs = [], np.zeros(CLASSES * CLASSES, np.int64)
            for text in b["text"]:
                ids = words.array(split_words(text.as_py()))
                found.append(ids)
                kind = (ids & np.uint64(CLASSES - 1)).astype(np.int64)
                if len(kind) > 1:
                    np.add.at(pairs, kind[:-1] * CLASSES + kind[1:], 1)
            ids, n = np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.uint64), np.zeros(0))
            some = np.flatnonzero(pairs)
            for kind, key, count in ((0, as_int64(ids), n), (1, some, pairs[some]), (2, np.zeros(1, np.int64), np.array([b.num_rows]))):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(key), kind, np.int32)), pa.array(key.astype(np.int64)), pa.array(np.asarray(count).astype(np.int64))], names=["kind", "id", "n"]
                )

    counted = docs.select("text").mapInArrow(run, "kind int, id long, n long")
    return counted.groupBy("kind", "id").agg(F.sum("n").alias("n"))


def vocabulary(docs: DataFrame, scratch: Scratch) -> Vocabulary:
    """The counts of the texts of ``docs`` (text; null counts as empty)."""
    counted = scratch.write(count_words(docs), "counts")
    words = counted.where("kind = 0").select("id", "n")
    size = counted.where("kind in (0, 2)").groupBy("kind").agg(F.sum("n").alias("n"), F.count("*").alias("types")).collect()
    by = {r["kind"]: r for r in size}
    ends = by[2]["n"] if 2 in by else 0
    tokens, types = ends + (by[0]["n"] if 0 in by else 0), (1 if ends else 0) + (by[0]["types"] if 0 in by else 0)

    # Sixteenths of a power of two: as many whole levels, from the top, as the bound has room for.
    ranked = words.withColumn("level", F.floor(F.log2("n") * 16).cast("int"))
    room, least = HELD, 1 << 20
    for r in ranked.groupBy("level").count().orderBy(F.desc("level")).collect():
        room -= r["count"]
        if room < 0:
            break
        least = r["level"]
    best = ranked.where(F.col("level") >= least).select("id", "n").orderBy(F.desc("n"), "id").toPandas()
    held = best["id"].to_numpy(np.int64).view(np.uint64)
    n = best["n"].to_numpy(np.int64)
    top = np.sort(held[:SYMBOLS])
    top_counts = n[:SYMBOLS][np.argsort(held[:SYMBOLS])]
    top_class = (top & np.uint64(CLASSES - 1)).astype(np.int64)

    # Of each class, the counts and types of the words without a symbol of their own.
    kind = F.col("id").bitwiseAND(CLASSES - 1)
    total, many = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in words.groupBy(kind.alias("c")).agg(F.sum("n").alias("n"), F.count("*").alias("types")).collect():
        total[r["c"]], many[r["c"]] = r["n"], r["types"]
    class_share = total / max(1.0, total.sum())
    np.subtract.at(total, top_class, top_counts)
    np.subtract.at(many, top_class, 1)

    prior = np.zeros(WIDTH)
    prior[: len(top)] = top_counts
    prior[SYMBOLS:END] = total
    prior[END] = ends
    prior = (prior + _ALPHA) / (prior + _ALPHA).sum()
    prior[len(top) : SYMBOLS] = 1e-300  # numbers that no word has
    classes = np.concatenate([top_class, np.zeros(SYMBOLS - len(top), np.int64), np.arange(CLASSES), [0]])
    pairs = np.zeros(CLASSES * CLASSES)
    for r in counted.where("kind = 1").select("id", "n").collect():
        pairs[r["id"]] = r["n"]
    order = np.argsort(held)
    return Vocabulary(words, held[order], n[order], top, prior, classes, total + _ALPHA * (many + 1), class_share, pairs.reshape(CLASSES, CLASSES), tokens, types, ends)


def encode(docs: DataFrame, v: Vocabulary, scratch: Scratch) -> DataFrame:
    """The texts of ``docs`` (doc_id, text, held_out) as symbols, with what needs no hidden states.

    A row has a key, n_tokens, n_known, base (log10 of the counts of the words that a task holds), word (log10 of their
    shares of their classes), and ids and times of the words that a task does not hold. Each text is read whole, once.
    """
    held = docs.sparkSession.sparkContext.broadcast((v.top, v.held, v.held_counts, v.class_total, v.ends))
    arrow = pa.schema([("key", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("word", pa.float64()), ("ids", pa.list_(pa.int64())), ("times", pa.list_(pa.int32())), ("symbols", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        top, known, counts, class_total, ends = held.value
        words, key = Ids(), TaskContext.get().partitionId() << 40
        log_counts, log_class = np.log10(counts + _ALPHA), np.log10(class_total)
        for whole in batches:
            for start in range(0, whole.num_rows, 1024):
                b = whole.slice(start, 1024)
                out: dict[str, list] = {name: [] for name in arrow.names}
                for text in b["text"]:
                    ids = words.array(split_words(text.as_py()))
                    symbols = _symbols(ids, top)
                    at = np.minimum(np.searchsorted(known, ids), max(0, len(known) - 1))
                    here = known[at] == ids if len(known) else np.zeros(len(ids), bool)
                    in_class = symbols[:-1] >= SYMBOLS
                    rare, times = np.unique(ids[~here], return_counts=True)
                    out["key"].append(key)
                    out["n_tokens"].append(len(symbols))
                    out["n_known"].append(int(here.sum()) + (ends > 0))
                    out["base"].append(float(log_counts[at[here]].sum() + np.log10(ends + _ALPHA)))
                    out["word"].append(float(log_counts[at[in_class & here]].sum() - log_class[symbols[:-1][in_class] - SYMBOLS].sum()))
                    out["ids"].append(as_int64(rare))
                    out["times"].append(times.astype(np.int32))
                    out["symbols"].append(symbols.astype(np.uint16).tobytes())
                    key += 1
                rest = [pa.array(out[n], arrow.field(n).type) for n in arrow.names if n not in ("doc_id", "held_out")]
                yield pa.RecordBatch.from_arrays([rest[0], b["doc_id"], b["held_out"], *rest[1:]], schema=arrow)

    schema = "key long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, word double, ids array<long>, times array<int>, symbols binary"
    return scratch.write(docs.select("doc_id", "held_out", "text").mapInArrow(run, schema), "encoded")


def _sequences(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [np.frombuffer(x.as_py(), np.uint16) for x in batch["symbols"]]


def baum_welch(encoded: DataFrame, v: Vocabulary, states: int = STATES, rounds: int = ROUNDS) -> tuple[Parameters, list[float]]:
    """The parameters after so many rounds over all encoded texts, and the log-likelihood before each round."""
    p = initial(v.pairs, v.class_share, v.prior, v.classes, states)
    p.emit[END] = v.prior[END]
    p.emit /= p.emit.sum(0)
    seen = []
    for _ in range(rounds):
        counts = _expected(encoded, p)
        seen.append(counts.log_likelihood)
        p = maximised(counts, v.prior)
    return p, seen


def _expected(encoded: DataFrame, p: Parameters) -> Counts:
    """The expected counts over all texts: each task's are rows by symbol, which are summed before they are read."""
    states = len(p.start)
    held = encoded.sparkSession.sparkContext.broadcast((p.start, p.move, p.emit))
    names = [f"c{k}" for k in range(states)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, counts = Parameters(*held.value), Counts.zero(states)
        for b in batches:
            if b.num_rows:
                expect_all(own, _sequences(b), counts)
        # After the symbols: a row for each state's moves, one for starts and one for the likelihood.
        rows = np.concatenate([counts.emit, counts.move, counts.start[None], np.eye(1, states) * counts.log_likelihood])
        some = np.flatnonzero(np.any(rows != 0, 1))
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), *[pa.array(rows[some, k]) for k in range(states)]], names=["symbol", *names])

    parts = encoded.select("symbols").mapInArrow(run, "symbol long, " + ", ".join(f"{c} double" for c in names))
    summed = parts.groupBy("symbol").agg(*[F.sum(c).alias(c) for c in names]).toPandas()
    rows = np.zeros((WIDTH + states + 2, states))
    rows[summed["symbol"].to_numpy()] = summed[names].to_numpy()
    return Counts(rows[WIDTH + states], rows[WIDTH : WIDTH + states], rows[:WIDTH], float(rows[-1, 0]))


def score(encoded: DataFrame, p: Parameters, v: Vocabulary) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every encoded text.

    Words that no task holds go as rows of (text, word, times) to the table of counts and come back as sums by text.
    """
    held = encoded.sparkSession.sparkContext.broadcast((p.start, p.move, p.emit))
    columns = ["key", "doc_id", "held_out", "n_tokens", "n_known", "base", "word"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Parameters(*held.value)
        for b in batches:
            hidden = likelihoods(own, _sequences(b)) / math.log(10) if b.num_rows else np.zeros(0)
            yield b.select(columns).append_column("hidden", pa.array(hidden))

    rows = encoded.select(*columns, "symbols").mapInArrow(run, "key long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, word double, hidden double")
    pairs = encoded.select("key", F.explode(F.arrays_zip("ids", "times")).alias("x")).select("key", F.col("x.ids").alias("id"), F.col("x.times").alias("times"))
    logs = F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + _ALPHA)
    sums = pairs.join(v.words, "id", "left").groupBy("key").agg(F.sum(logs).alias("rare"), F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("rare_known"))
    whole = math.log10(v.tokens + _ALPHA * (v.types + 1))
    rare = F.coalesce("rare", F.lit(0.0))
    return rows.join(sums, "key", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(v.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + rare - F.col("n_tokens") * whole).alias("base_score"),
        (F.col("hidden") + F.col("word") + rare).alias("score"),
    )


def scores(docs: DataFrame, states: int = STATES, rounds: int = ROUNDS) -> DataFrame:
    """The model's and the base's log10 probability of every row's text, learned from those :func:`in_training`.

    Null, empty and white texts are the end alone. Rows without an id are scored but not learned from; repeated rows
    are learned from and scored as often as they come; further columns are ignored; an empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), (~in_training(F.col("doc_id"))).alias("held_out"))
    v = vocabulary(rows.where("not held_out"), scratch)
    encoded = encode(rows, v, scratch)
    p, _ = baum_welch(encoded.where("not held_out"), v, states, rounds)
    return score(encoded, p, v)


def op8_hmm_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(table(spark, sf_dir, "documents"))
