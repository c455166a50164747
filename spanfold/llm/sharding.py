"""Hierarchical weighted hash tree: documents descend region, rack and shard levels by weighted hash draws.

At every node each child draws ``-ln(u) / weight`` from a hash of (key, child) and the least draw wins, so a child wins
in proportion to its weight. A changed weight alters one child's draws at each level on its path: rows move only into
or out of the subtrees whose weights change. A shard that is added by :func:`with_shard` gets a region and rack of its
own, so that nothing but the new shard gains rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, table

_ROOT = "root"
#: Buckets of a shard, in which its rows are numbered. The slots depend on it, and on nothing of the cluster.
BUCKETS = 256


@dataclass(frozen=True)
class Tree:
    """``shards``: (region, rack, shard number, weight) of each shard, weights over 0."""

    shards: tuple[tuple[str, str, int, float], ...]

    def children(self) -> dict[str, list[tuple[str, float, int]]]:
        """By node: its children's names, weights and shard numbers (-1 above the shards)."""
        found: dict[str, dict[str, list]] = {}
        for region, rack, shard, weight in self.shards:
            path = (_ROOT, f"{region}", f"{region}/{rack}", f"{region}/{rack}/{shard}")
            for level, (parent, child) in enumerate(zip(path, path[1:], strict=False)):
                entry = found.setdefault(parent, {}).setdefault(child, [child, 0.0, shard if level == 2 else -1])
                entry[1] += weight
        return {parent: [tuple(x) for x in kids.values()] for parent, kids in found.items()}


def balanced_tree(shards: int, regions: int = 4, racks: int = 2) -> Tree:
    """Shards 0 to ``shards - 1``, of weight 1, dealt evenly to regions and racks."""
    width = -(-shards // (regions * racks))
    return Tree(tuple((f"r{s // (width * racks)}", f"k{s // width % racks}", s, 1.0) for s in range(shards)))


def with_shard(tree: Tree, shard: int, weight: float = 1.0) -> Tree:
    return Tree((*tree.shards, (f"r+{shard}", "k0", shard, weight)))


def place(tree: Tree, key: Column) -> Column:
    """The shard number of a key (null counts as an empty key), from the key and the tree alone."""
    kids = tree.children()
    nodes = F.create_map(
        *[
            x
            for parent, children in kids.items()
            for x in (
                F.lit(parent),
                F.array(*[F.struct(F.lit(n).alias("name"), F.lit(w).alias("weight"), F.lit(s).alias("shard")) for n, w, s in children]),
            )
        ]
    )
    key = F.coalesce(key.cast("string"), F.lit(""))

    def draw(child: Column) -> Column:
        bits = F.conv(F.substring(F.md5(F.concat(key, F.lit("|"), child["name"])), 1, 12), 16, 10).cast("double")
        return F.struct((-F.log((bits + 0.5) / float(1 << 48)) / child["weight"]).alias("draw"), child["name"].alias("name"), child["shard"].alias("shard"))

    at = F.struct(F.lit(0.0).alias("draw"), F.lit(_ROOT).alias("name"), F.lit(-1).alias("shard"))
    for _ in range(3):
        at = F.array_min(F.transform(F.element_at(nodes, at["name"]), draw))
    return at["shard"]


def assign(docs: DataFrame, tree: Tree, grown: Tree | None = None, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot and, with ``grown``, grown_shard of every row of ``docs``.

    Size is the text's UTF-8 bytes and 16; a null text has none. Slots number each shard's rows from 0 without gaps, in
    the order of a hash bucket, then doc_id and text_crc32. Rows with equal ids all go to one shard; a null id counts
    as an empty key; an empty table gives no rows; other columns are ignored.

    No task holds a shard: rows are numbered inside (shard, bucket) and buckets start where the counts of those before
    them end. Only the digest is shuffled, never a text.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = scratch.write(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            (F.octet_length(text) + 16).cast("long").alias("size"),
            F.crc32(text).alias("text_crc32"),
            place(tree, F.col("doc_id")).alias("shard"),
            (place(grown, F.col("doc_id")) if grown else F.lit(None).cast("int")).alias("grown_shard"),
            F.pmod(F.xxhash64("doc_id", text), F.lit(buckets)).cast("int").alias("bucket"),
        ),
        "placed",
    )
    starts = (
        rows.groupBy("shard", "bucket")
        .agg(F.count("*").alias("n"))
        .withColumn("start", F.sum("n").over(Window.partitionBy("shard").orderBy("bucket")) - F.col("n"))
    )
    within = Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size")
    return (
        rows.withColumn("rank", F.row_number().over(within) - 1)
        .join(starts.drop("n"), ["shard", "bucket"])
        .withColumn("slot", (F.col("start") + F.col("rank")).cast("long"))
        .drop("bucket", "start", "rank")
    )


def write_shards(docs: DataFrame, tree: Tree, path: str) -> None:
    """The rows themselves, as Parquet in a folder for each shard."""
    docs.withColumn("shard", place(tree, F.col("doc_id"))).write.partitionBy("shard").parquet(path)


def op6_weighted_tree_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = balanced_tree(40)
    placed = assign(table(spark, sf_dir, "documents"), tree, with_shard(tree, 40))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard"
    )
