r"""Token counts. Huge texts are encoded in overlapping chunks that are spliced where both chunks must agree.

Why a splice is exact. The vocabulary's tokenizer drops white space, and no normaliser rule, special string or merge
of it reaches across a white-space character. So a text that is cut beside one of ``\x20 \x09-\x0D`` has the tokens of
its two parts. A chunk's end is no such cut: tokens near it can differ from those of the whole text. Two chunks are
spliced only at a character of the six inside their overlap, after which both have equal tokens at equal offsets up to
the next such character. Where an overlap has none (one endless word, say) it is doubled until it has one or until the
first chunk takes in the rest of the text.

The same rule lets a process remember how many tokens a run between white space has. That is the encoder which whole
short texts go through: every run is encoded by the library, but a run that comes again is not encoded again. Nor is a
word that came with other marks around it: the vocabulary's tokenizer makes lower case, takes runs of letters, single
digits and runs of other marks apart before it merges, and nothing else in a run of the characters of ``_PLAIN`` could
join them: no apostrophe (contractions), no special string, no character that composes or has another lower case.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import table

HUGE_CHARS, CHUNK_CHARS, OVERLAP_CHARS = 65_536, 32_768, 512
#: Runs and parts of runs that each of two generations remembers, and the length of the longest of them.
_CACHED_RUNS, _CACHED_PARTS, _CACHED_BYTES = 1 << 16, 1 << 19, 64
_SPACE = re.compile(r"[\x20\x09-\x0D]")
# Letters of one code point each, whose lower case is one letter too: ASCII, Latin-1 and Latin Extended-A but U+0130.
_LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u0148\u014a-\u017e"
_PLAIN = re.compile(rf"[!-&(-~{_LETTERS}]+")
_PLAIN_TEXT = re.compile(rf"[\x20\x09-\x0D!-&(-~{_LETTERS}]*")
_PARTS = re.compile(rf"[{_LETTERS}]+|[0-9]|[^\x20\x09-\x0D{_LETTERS}0-9]+")

Encode = Callable[[str], list[tuple[int, int, int]]]


def splice(text: str, encode: Encode, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> list[tuple[int, int, int]]:
    """(id, start, end) of the tokens of ``text``, from overlapping chunks. ``encode`` gives those of one chunk."""

    def encoded(start: int, end: int) -> list[tuple[int, int, int]]:
        return [(i, a + start, b + start) for i, a, b in encode(text[start:end])]

    done: list[tuple[int, int, int]] = []
    start, end = 0, min(len(text), chunk)
    left = encoded(start, end)
    while end < len(text):
        wide = min(overlap, chunk // 2)
        while True:
            begin = max(start, end - wide)
            stop = min(len(text), begin + chunk + wide)
            right = encoded(begin, stop)
            at = _common(text, left, right, begin, end)
            if at is not None or end == len(text):
                break
            # No proven boundary: the left chunk reaches further and so does the overlap.
            wide *= 2
            end = min(len(text), end + wide)
            left = encoded(start, end)
        if at is None:
            break
        done += left[: bisect.bisect_left(left, at, key=lambda t: t[1])]
        left = right[bisect.bisect_left(right, at, key=lambda t: t[1]) :]
        start, end = at, stop
    return done + left


def _common(text: str, left: list, right: list, begin: int, end: int) -> int | None:
    """The first white-space character in [begin, end) from which both chunks have the same tokens up to the next one."""
    cuts = [m.start() for m in _SPACE.finditer(text, begin, end)]
    for cut, following in zip(cuts, cuts[1:], strict=False):
        a = left[bisect.bisect_left(left, cut, key=lambda t: t[1]) : bisect.bisect_left(left, following, key=lambda t: t[1])]
        b = right[bisect.bisect_left(right, cut, key=lambda t: t[1]) : bisect.bisect_left(right, following, key=lambda t: t[1])]
        if a and a == b:
            return cut
    return None


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    return found


class Memory(dict):
    """What was counted, in two generations: what was met since the older one was young stays, so that rare entries do
    not push frequent ones out and memory is bounded. Long entries are forgotten at once."""

    def __init__(self, most: int) -> None:
        super().__init__()
        self.most = most
        self.old: dict = {}
        self.long: list = []

    def unknown(self, keys) -> list:
        """The keys that neither generation knows; the others are made young."""
        new = []
        for k in keys:
            if k not in self:
                if (n := self.old.get(k)) is None:
                    new.append(k)
                else:
                    self[k] = n
        return new

    def learn(self, keys: list, counts) -> None:
        self.update(zip(keys, counts, strict=True))
        self.long += [k for k in keys if len(k) > _CACHED_BYTES]

    def settle(self) -> None:
        for k in self.long:
            del self[k]
        self.long = []
        if len(self) > self.most:
            self.old = dict(self)
            self.clear()


class Counter:
    """Counts the tokens of texts. It remembers those of short runs and of the parts that runs are made of."""

    def __init__(self, path: str):
        self._tokenizer = _tokenizer(path)
        self._runs, self._parts = Memory(_CACHED_RUNS), Memory(_CACHED_PARTS)

    def offsets(self, text: str) -> list[tuple[int, int, int]]:
        """(id, start, end) of the tokens of a text."""
        e = self._tokenizer.encode(text, add_special_tokens=False)
        return [(i, a, b) for i, (a, b) in zip(e.ids, e.offsets, strict=True)]

    def _encoded(self, texts: list[str]) -> list[int]:
        found: list[int] = []
        for i in range(0, len(texts), 4096):
            found += map(len, self._tokenizer.encode_batch_fast(texts[i : i + 4096], add_special_tokens=False))
        return found

    def _learn(self, runs: set[bytes]) -> None:
        """Makes all these runs known."""
        made, odd, texts = [], [], []  # plain runs with their parts; others with their texts
        for r in self._runs.unknown(runs):
            text = r.decode("utf-8", "replace")
            if _PLAIN.fullmatch(text) and "<|" not in text:
                made.append((r, _PARTS.findall(text.lower())))
            else:
                odd.append(r)
                texts.append(text)
        self._runs.learn([r for r, _ in made], self._sums([xs for _, xs in made]))
        self._runs.learn(odd, self._encoded(texts))

    def _sums(self, lists: list[list[str]]) -> list[int]:
        """The tokens of lists of parts."""
        parts = self._parts
        new = parts.unknown(set().union(*lists))
        parts.learn(new, self._encoded(new))
        n = [sum(map(parts.__getitem__, xs)) for xs in lists]
        parts.settle()
        return n

    def __call__(self, texts: list[str | None]) -> list[int]:
        """The number of tokens of each text; null has none. Huge texts are encoded in chunks and spliced."""
        n = self.by_runs([t if t and len(t) <= HUGE_CHARS else None for t in texts])
        return [len(splice(t, self.offsets)) if t and len(t) > HUGE_CHARS else k for t, k in zip(texts, n, strict=True)]

    def by_runs(self, texts: list[str | None]) -> list[int]:
        """The same numbers, by parts of plain texts and by runs of others alone."""
        plain = [bool(t) and "<|" not in t and _PLAIN_TEXT.fullmatch(t) is not None for t in texts]
        sums = iter(self._sums([_PARTS.findall(t.lower()) for t, p in zip(texts, plain, strict=True) if p]))
        runs = [t.encode("utf-8", "surrogatepass").split() if t and not p else () for t, p in zip(texts, plain, strict=True)]
        self._learn(set().union(*runs))
        known = self._runs
        n = [next(sums) if p else sum(map(known.__getitem__, r)) for r, p in zip(runs, plain, strict=True)]
        known.settle()
        return n

    def by_run(self, text: str) -> list[int]:
        """The number of tokens of each run between white space, whose sum is that of the text."""
        runs = text.encode("utf-8", "surrogatepass").split()
        self._learn(set(runs))
        n = list(map(self._runs.__getitem__, runs))
        self._runs.settle()
        return n


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    """The counter of a tokenizer file; a worker keeps it, and what it remembers, from task to task."""
    return Counter(path)


def token_counts(docs: DataFrame, path: str, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens and over_limit of each row of ``docs``, in one pass and without a shuffle.

    ``path`` names the tokenizer file on the workers. A null or empty text has no bytes and no tokens. Repeated rows
    and null ids are rows like others; an empty table gives no rows; other columns are ignored. Special strings inside
    a text count as the library counts them by default.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        count = counter(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = part["text"].to_pylist()
                n = count(texts)
                size = [len(t.encode("utf-8", "surrogatepass")) if t else 0 for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [part["doc_id"], pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                    names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
                )

    rows = docs.selectExpr("cast(doc_id as long) as doc_id", "cast(text as string) as text")
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op2_overlap_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
