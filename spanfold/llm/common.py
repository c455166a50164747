"""What several operators share: words, shingles, scratch tables and connected components."""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import Scratch

#: Words that a worker remembers, and the bytes of the longest of them.
_CACHED_WORDS, _CACHED_BYTES = 1 << 18, 64
#: Links in a file of a round of connected components, where there are more than the cluster has cores for.
LINKS_A_FILE = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def split_words(text: str | None) -> list[bytes]:
    r"""The words ``[^\x20\x09-\x0D]+`` of a text, A-Z lower-cased, as UTF-8.

    bytes.lower folds ASCII letters only and bytes.split cuts at exactly these six characters.
    """
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


class WordIds(dict):
    """A 64-bit id of each word. It holds a bounded number of short ones and computes the others again."""

    def __missing__(self, word: bytes) -> int:
        found = xxhash.xxh3_64_intdigest(word)
        if len(word) <= _CACHED_BYTES:
            if len(self) >= _CACHED_WORDS:
                self.clear()
            self[word] = found
        return found

    def array(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(word_ids: np.ndarray, width: int = 5) -> np.ndarray:
    """The distinct hashes, ascending, of a document's shingles; of the whole sequence where it is shorter."""
    if not len(word_ids):
        return word_ids
    k = min(width, len(word_ids))
    n = len(word_ids) - k + 1
    total = np.full(n, k, np.uint64)
    for i in range(k):
        total = mix64(total * np.uint64(0x9E3779B97F4A7C15) + word_ids[i : i + n])
    return np.unique(total)


def connected_components(scratch: Scratch, links: DataFrame) -> DataFrame:
    """(node, component) of the nodes in ``links`` (a, b long): the smallest node that links reach.

    Alternating large-star and small-star rounds (Kiveris et al., 2014). Each round is a few shuffles of the links,
    written to the shared folder, and the number of rounds grows with the logarithm of a component's size. No node's
    neighbours are gathered: minima are aggregates with partial sums, so a hub is no hot spot. No round makes more links
    than it got, so their number tells how many files the next one needs: an executor starts processes as it writes
    files where Hadoop has no native library.
    """
    spark = scratch.spark
    links = scratch.write(
        links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct(), "links"
    )

    def star(edges: DataFrame, large: bool) -> DataFrame:
        both = edges if not large else edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        joined = both.join(least, "a")
        if large:  # larger neighbours move to the smallest
            return joined.where("b > a and b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # smaller neighbours and the node itself move to the smallest
        moved = joined.where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        return moved.unionByName(least.select("a", F.col("m").alias("b"))).where("a != b").distinct()

    def digest(df: DataFrame) -> tuple:
        row = df.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b") % 1_000_003).alias("h")).first()
        return row["n"], row["h"]

    last = digest(links)
    while last[0]:
        files = max(spark.sparkContext.defaultParallelism, -(-last[0] // LINKS_A_FILE))
        new = scratch.write(star(star(links, True), False).coalesce(files), "links")
        now = digest(new)
        scratch.drop(links)
        links = new
        if now == last:
            break
        last = now
    nodes = links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def as_int64(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


__all__ = [
    "DataFrame", "Scratch", "SparkSession", "WordIds", "as_int64", "connected_components", "mix64", "shingles",
    "split_words", "table",
]
