"""Toxicity: gradient-boosted trees over dense features of a text, with isotonic calibration.

The features are lexicon densities, the proximity of lexicon words to the second person, capitals, punctuation and
obfuscation rates. The lexicon is learned: words and word beginnings which labelled toxic texts use far more than
others; a short list of common insults stands beside it. Labelled rows are dealt to folds by a hash. The lexicon behind
a row's features never saw the row's own fold, nor did the trees behind the margin that it adds to the calibration.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import Scratch, table

#: Labelled rows that the model is fitted on, at most (in expectation: rows are drawn by a hash of their id).
SAMPLE = 20_000
#: Entries of the learned lexicon, at most; they are model parameters, ranked by evidence.
LEXICON = 8_192
THRESHOLD = 0.3
#: Texts that use an entry, and the log-odds at which it counts as mild or as strong.
LEAST_TEXTS, MILD, STRONG = 3, 1.5, 3.0
FOLDS = 5
#: Words on either side of a lexicon word in which the second person is near.
NEAR = 5

# Pronouns of the second person in English, German, French and Spanish.
SECOND_PERSON = frozenset(
    "you your yours yourself u ur du dich dir dein deine deinen ihr euch euer sie tu te toi ton ta tes vous votre vos"
    " ti tus tú usted ustedes vosotros".split()
)
# Common insults in the same languages.
INSULTS = frozenset(
    "arschloch bastard bitch clown connard crétin crap depp disgusting dumb dumm dummkopf estúpido filth fool freak garbage"
    " hate idiot idiota idiote imbécil imbecile imbécile jerk kill loser maricón mierda miststück moron pathetic pendejo"
    " pig puta salope scheiße schwein scum shit shut slut stupid stupide suck trash trottel ugly vermin whore worthless"
    .split()
)
# Look-alikes of letters.
LOOKALIKES = str.maketrans("013457@$!|", "oieastasil")

FEATURES = (
    "log_words strong mild insults distinct weight_sum weight_max strong_log near_you pronouns capitals capital_words exclamation"
    " question punctuation digits symbols obfuscated stretched word_length"
).split()

_EDGES = re.compile(r"^[\W_]+|[\W_]+$")
_INNER = re.compile(r"[\W_]+")
_STRETCH = re.compile(r"([^\W\d_])\1{2,}")
_UPPER = bytes(range(65, 91))
_PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Words that a worker remembers, and the bytes of the longest of them.
_CACHED_WORDS, _CACHED_BYTES = 1 << 17, 64


def keys(word: str) -> tuple[str, ...]:
    """The lexicon keys of a lower-case word: itself, and its beginnings of four and five letters."""
    return (word, *(f"{word[:n]}*" for n in (4, 5) if len(word) > n))


class Reader(dict):
    """Of each raw word a number whose bits say what it is. It holds a bounded number of words."""

    STRONG, MILD, YOU, CAPS, DIGIT, SYMBOL, HIDDEN, STRETCHED, INSULT = (1 << i for i in range(9))

    def __init__(self, lexicon: dict[str, float]):
        super().__init__()
        self.lexicon = lexicon

    def weight(self, word: str) -> float:
        return max((self.lexicon.get(k, 0.0) for k in keys(word)), default=0.0)

    def __missing__(self, raw: bytes) -> int:
        word = _EDGES.sub("", raw.decode("utf-8", "replace"))
        lower = word.lower()
        weight = self.weight(lower)
        bits = 0
        if lower in INSULTS:
            bits |= self.INSULT
        if lower in SECOND_PERSON:
            bits |= self.YOU
        if len(word) > 1 and word.isupper():
            bits |= self.CAPS
        if not lower.isalpha() and lower:
            if any(c.isdigit() for c in lower) and any(c.isalpha() for c in lower):
                bits |= self.DIGIT
            if _INNER.search(lower):
                bits |= self.SYMBOL
        if _STRETCH.search(lower):
            bits |= self.STRETCHED
        if weight < STRONG and bits & (self.DIGIT | self.SYMBOL | self.STRETCHED) or weight < STRONG and not raw[:1].isalnum():
            plain = _STRETCH.sub(r"\1", _INNER.sub("", raw.decode("utf-8", "replace").lower().translate(LOOKALIKES)))
            if plain != lower and ((hidden := self.weight(plain)) >= STRONG or plain in INSULTS):
                weight, bits = max(weight, hidden), bits | self.HIDDEN | (self.INSULT if plain in INSULTS else 0)
        bits |= self.STRONG if weight >= STRONG else self.MILD if weight >= MILD else 0
        found = bits | int(min(weight, 15.0) * 1000) << 9
        if len(raw) <= _CACHED_BYTES:
            if len(self) >= _CACHED_WORDS:
                self.clear()
            self[raw] = found
        return found

    def features(self, text: str | None) -> list[float]:
        data = text.encode("utf-8", "surrogatepass") if text else b""
        words = data.split()
        if not words:
            return [0.0] * len(FEATURES)
        n = len(words)
        codes = np.fromiter(map(self.__getitem__, words), np.int64, n)
        rate = lambda bit: float(np.count_nonzero(codes & bit)) / n
        strong = np.flatnonzero(codes & (self.STRONG | self.INSULT))
        weights = (codes >> 9) / 1000.0
        near = 0
        if len(strong):
            you = np.flatnonzero(codes & self.YOU)
            if len(you):
                at = np.searchsorted(you, strong)
                gap = np.minimum(np.abs(you[np.minimum(at, len(you) - 1)] - strong), np.abs(you[np.maximum(at - 1, 0)] - strong))
                near = int(np.count_nonzero(gap <= NEAR))
        size = len(data)
        return [
            float(np.log1p(n)),
            len(strong) / n,
            rate(self.MILD),
            rate(self.INSULT),
            float(np.log1p(len({words[i] for i in strong.tolist()}))),
            float(weights.sum()) / n,
            float(weights.max()),
            float(np.log1p(len(strong))),
            near / n,
            rate(self.YOU),
            (size - len(data.translate(None, _UPPER))) / size,
            rate(self.CAPS),
            data.count(b"!") / n,
            data.count(b"?") / n,
            (size - len(data.translate(None, _PUNCTUATION))) / size,
            rate(self.DIGIT),
            rate(self.SYMBOL),
            rate(self.HIDDEN),
            rate(self.STRETCHED),
            size / n,
        ]


@dataclass
class Trees:
    """Boosted trees of depth ``depth`` on a logistic loss, found by histograms of binned features."""

    rounds: int = 60
    depth: int = 3
    rate: float = 0.2
    bins: int = 64
    ridge: float = 1.0
    start: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    splits: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        n, width = x.shape
        if not n:
            return self
        quantiles = np.linspace(0, 1, self.bins)[1:-1]
        self.edges = [np.unique(np.quantile(x[:, j], quantiles)) for j in range(width)]
        binned = self._binned(x)
        p = (y.sum() + 0.5) / (n + 1)
        self.start = float(np.log(p / (1 - p)))
        score = np.full(n, self.start)
        offset = np.arange(width) * self.bins
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            g, h = p - y, p * (1 - p)
            node = np.zeros(n, np.int64)
            feature = np.zeros((1 << self.depth) - 1, np.int64)
            cut = np.full((1 << self.depth) - 1, self.bins, np.int64)
            for level in range(self.depth):
                first, many = (1 << level) - 1, 1 << level
                at = ((node * width)[:, None] * self.bins + offset + binned).ravel()
                shape = (many, width, self.bins)
                grad = np.bincount(at, np.repeat(g, width), many * width * self.bins).reshape(shape).cumsum(2)
                hess = np.bincount(at, np.repeat(h, width), many * width * self.bins).reshape(shape).cumsum(2)
                all_g, all_h = grad[:, :, -1:], hess[:, :, -1:]
                right = all_h - hess
                gain = grad**2 / (hess + self.ridge) + (all_g - grad) ** 2 / (right + self.ridge) - all_g**2 / (all_h + self.ridge)
                gain[(hess < 1e-3) | (right < 1e-3)] = 0
                best = gain.reshape(many, -1).argmax(1)
                useful = gain.reshape(many, -1).max(1) > 1e-6
                feature[first : first + many] = np.where(useful, best // self.bins, 0)
                cut[first : first + many] = np.where(useful, best % self.bins, self.bins)
                node = node * 2 + (binned[np.arange(n), feature[first + node]] > cut[first + node])
            leaves = 1 << self.depth
            value = -self.rate * np.bincount(node, g, leaves) / (np.bincount(node, h, leaves) + self.ridge)
            score += value[node]
            self.splits.append((feature, cut, value))
        return self

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)], 1)

    def margin(self, x: np.ndarray) -> np.ndarray:
        score = np.full(len(x), self.start)
        if not self.splits or not len(x):
            return score
        binned, rows = self._binned(x), np.arange(len(x))
        for feature, cut, value in self.splits:
            node = np.zeros(len(x), np.int64)
            for level in range(self.depth):
                at = (1 << level) - 1 + node
                node = node * 2 + (binned[rows, feature[at]] > cut[at])
            score += value[node]
        return score


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Points (x, value) of the non-decreasing fit of ``y``, by pooling adjacent violators. A row with the mean
    label is added at each end, so that few rows give no certainty."""
    if not len(x):
        return np.zeros(1), np.zeros(1)
    at, group = np.unique(x, return_inverse=True)  # equal margins get equal values
    ones, rows = np.bincount(group, y), np.bincount(group).astype(float)
    blocks: list[list[float]] = []  # sum, count, first, last
    for s, c, p in [(y.mean(), 1.0, at[0] - 1), *zip(ones, rows, at, strict=True), (y.mean(), 1.0, at[-1] + 1)]:
        blocks.append([float(s), float(c), float(p), float(p)])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            s, c, _, last = blocks.pop()
            blocks[-1][0] += s
            blocks[-1][1] += c
            blocks[-1][3] = last
    points = [(p, s / c) for s, c, first, last in blocks for p in dict.fromkeys((first, last))]
    return np.array([p for p, _ in points]), np.array([v for _, v in points])


@dataclass
class Model:
    lexicon: dict[str, float]
    trees: Trees
    calibration: tuple[np.ndarray, np.ndarray]

    def state(self) -> tuple:
        t = self.trees
        return self.lexicon, (t.depth, t.start, t.edges, t.splits), self.calibration


def _scores(margin: np.ndarray, calibration: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    return np.clip(np.interp(margin, *calibration), 0.0, 1.0)


def _feature_rows(rows: DataFrame, lexicons: list[dict[str, float]]) -> DataFrame:
    """label, fold and x of labelled rows: the features by the lexicon that leaves out the row's fold."""
    held = rows.sparkSession.sparkContext.broadcast(lexicons)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        readers = [Reader(lexicon) for lexicon in held.value]
        for b in batches:
            x = [readers[f].features(t.as_py()) for f, t in zip(b["fold"].to_pylist(), b["text"], strict=True)]
            yield pa.RecordBatch.from_arrays([b["label"], b["fold"], pa.array(x, pa.list_(pa.float64()))], names=["label", "fold", "x"])

    return rows.select("label", "fold", "text").mapInArrow(run, "label int, fold int, x array<double>")


def _weight(toxic: float, clean: float, all_toxic: float, all_clean: float) -> float:
    """Log-odds of a key, less one standard error."""
    odds = np.log((toxic + 0.5) / (all_toxic + 1.0)) - np.log((clean + 0.5) / (all_clean + 1.0))
    return float(odds - np.sqrt(1 / (toxic + 0.5) + 1 / (clean + 0.5)))


def _learn_lexicons(rows: DataFrame) -> list[dict[str, float]]:
    """A lexicon without each fold, and last the one of all rows, from the number of texts that use each key."""
    cells = 2 * FOLDS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            used: dict[str, list[int]] = {}
            for label, fold, text in zip(b["label"].to_pylist(), b["fold"].to_pylist(), b["text"], strict=True):
                words = {_EDGES.sub("", w.decode("utf-8", "replace")).lower() for w in set((text.as_py() or "").encode("utf-8", "surrogatepass").split())}
                for k in {k for w in words if w for k in keys(w)}:
                    used.setdefault(k, [0] * cells)[2 * fold + label] += 1
            names = list(used)
            for at in range(0, len(names), 50_000):
                part = names[at : at + 50_000]
                counts = np.array([used[k] for k in part], np.int64).reshape(len(part), cells)
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), *[pa.array(counts[:, i]) for i in range(cells)]], names=["key", *[f"c{i}" for i in range(cells)]])

    schema = "key string, " + ", ".join(f"c{i} long" for i in range(cells))
    totals = np.zeros(cells)
    for r in rows.groupBy("fold", "label").agg(F.count("*").alias("n")).collect():
        totals[2 * r["fold"] + r["label"]] = r["n"]
    sums = [F.sum(f"c{i}").alias(f"c{i}") for i in range(cells)]
    counts = rows.select("label", "fold", "text").mapInArrow(run, schema).groupBy("key").agg(*sums)
    toxic = sum((F.col(f"c{i}") for i in range(3, cells, 2)), F.col("c1"))
    clean = sum((F.col(f"c{i}") for i in range(2, cells, 2)), F.col("c0"))
    odds = F.log((toxic + 0.5) / (totals[1::2].sum() + 1.0)) - F.log((clean + 0.5) / (totals[::2].sum() + 1.0))
    best = counts.where(toxic >= LEAST_TEXTS).where(odds >= MILD).orderBy(F.desc(toxic * odds), "key").limit(LEXICON).collect()
    lexicons = []
    for fold in range(FOLDS + 1):
        keep = np.array([i // 2 != fold for i in range(cells)], float)
        lexicon = {}
        for r in best:
            c = np.array([r[f"c{i}"] for i in range(cells)]) * keep
            p, n = c[1::2].sum(), c[::2].sum()
            if p >= LEAST_TEXTS - (fold < FOLDS) and (w := _weight(p, n, (totals * keep)[1::2].sum(), (totals * keep)[::2].sum())) >= MILD:
                lexicon[r["key"]] = w
        lexicons.append(lexicon)
    return lexicons


def labelled_sample(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE) -> DataFrame:
    """doc_id, text, label (0 or 1) and fold of training rows: those whose crc32(doc_id) mod 4 is not 2.

    Rows are drawn by a hash of the id, ``bound`` in expectation. Equal texts count once, under the smallest of their
    ids and the highest of their labels, as do labels that contradict each other for one id; so the same rows give the
    same sample however they are partitioned. Rows without an id, label or text are left out.
    """
    may = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("label"))
    usable = usable.where("doc_id is not null and label in (0, 1)").where(may).groupBy("doc_id").agg(F.max("label").alias("label"))
    share = min(1.0, bound / max(1, usable.count()))
    drawn = usable.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null")
    rows = texts.join(F.broadcast(drawn), "doc_id")  # at most ``bound`` ids, or about, are broadcast
    rows = rows.groupBy("text").agg(F.min("doc_id").alias("doc_id"), F.max("label").alias("label"))
    return rows.withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(FOLDS)).cast("int"))


def fit(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE) -> Model:
    """The model that the labelled sample gives; without labelled rows it scores every text 0."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    rows = scratch.write(labelled_sample(docs, labels, bound), "sample")
    lexicons = _learn_lexicons(rows)
    found = _feature_rows(rows, lexicons).orderBy("label", "fold", "x").collect()
    scratch.drop(rows)
    x = np.array([r["x"] for r in found], float).reshape(len(found), len(FEATURES))
    y = np.array([r["label"] for r in found], float)
    folds = np.array([r["fold"] for r in found], int)
    margin = np.zeros(len(found))
    for fold in range(FOLDS):
        own = folds == fold
        margin[own] = Trees().fit(x[~own], y[~own]).margin(x[own])
    return Model(lexicons[-1], Trees().fit(x, y), isotonic(margin, y))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of ``docs`` and ``toxicity``, 0 to 1, from the whole text alone.

    Null and empty texts get the score of a text without any feature. Repeated rows, null ids and further columns pass
    through; a column named ``toxicity`` is replaced.
    """
    kept = docs.drop("toxicity")
    held = docs.sparkSession.sparkContext.broadcast(model.state())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, (depth, start, edges, splits), calibration = held.value
        reader, trees = Reader(lexicon), Trees(depth=depth, start=start, edges=edges, splits=splits)
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                x = np.array([reader.features(t.as_py()) for t in part["text"]], float).reshape(part.num_rows, len(FEATURES))
                yield part.append_column("toxicity", pa.array(_scores(trees.margin(x), calibration)))

    return kept.mapInArrow(run, StructType([*kept.schema.fields, StructField("toxicity", DoubleType())]))


def op10_boosted_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"))
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    return scored(docs, model).select(
        "doc_id",
        held_out.alias("held_out"),
        F.col("toxicity").alias("score"),
        (F.col("toxicity") >= THRESHOLD).cast("int").alias("predicted"),
    )
