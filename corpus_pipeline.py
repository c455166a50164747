"""A corpus from raw documents to packed sequences: each stage works on all rows that the one before it kept.

All stages but the last return the columns of ``documents``; the last returns sequences with their texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanfold.llm import decontamination, jaccard, packing, secrets, toxicity
from spanfold.llm.common import Scratch, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity under the threshold; learned from the labelled ones among them."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.scored(docs, model).where(F.col("toxicity") < toxicity.THRESHOLD).select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document, by id, of each group of near copies."""
    return jaccard.deduplicated(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that cover no test item by half."""
    return decontamination.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced by a mark; n_chars follows the text."""
    found = secrets.scan_documents(docs)
    if "n_chars" in docs.columns:
        found = found.withColumn("__masked", F.col("secret_spans") != "")
        clean = secrets.redact(found)
        changed = F.when(F.col("__masked"), F.length("text")).otherwise(F.col("n_chars"))
        return clean.withColumn("n_chars", changed.cast(docs.schema["n_chars"].dataType)).select(docs.columns)
    return secrets.redact(found).select(docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of the permitted lengths in tokens, with the ids, pieces and texts that they hold."""
    import public_tokenizers

    packed = packing.pack(docs, with_text=True, tokenizer=public_tokenizers.path("word_bpe_49k.json"))
    return packed.withColumn("doc_ids", F.col("pieces.doc_id"))


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard", drop_near_copies),
    ("decontamination", drop_leaks),
    ("secrets", mask_secrets),
    ("packing", pack_sequences),
]

#: SQL can express neither the classifier nor the packing; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
    return docs
