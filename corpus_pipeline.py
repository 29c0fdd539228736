"""Corpus pipeline over ``documents``: stages that each read what the one before wrote.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame. All but the last
return the columns of ``docs``.
"""

from __future__ import annotations

from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidemark.functions.lineage import scratch
from tidemark.llm import decontamination, packing, secrets, similarity, simhash, toxicity
from tidemark.llm.common import labelled_sample, read

BATCH = 4 << 20


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go; the classifier learns from this stage's own rows and the table of labels."""
    sample = labelled_sample(docs, read(spark, sf_dir, "labels"), "toxic", 5, 0, toxicity.TRAIN_ROWS)
    return toxicity.reject(docs, toxicity.learn(docs, sample))


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: that of the smallest id. Texts link by their fingerprints or
    by a similarity of their 5-word shingles of at least 0.8."""
    return simhash.keep_first(docs, similar=similarity.SIMILAR).select(docs.columns)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words inside an occurrence of a benchmark window are cut out; every document stays."""
    return decontamination.remove(docs, read(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; every document stays."""
    return secrets.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in their training sequences, with their ids."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), keep_words=False)


def in_small_batches(stage):
    """``stage`` with Arrow batches of at most ``BATCH`` bytes: a batch is held by the JVM and by its Python worker, several times over
    while it grows, and the stages follow each other in the same processes."""
    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH))
        return stage(spark, docs, sf_dir)

    return run


STAGES = [(name, in_small_batches(stage)) for name, stage in [
    ("toxicity", without_toxic),
    ("simhash near-dedup", without_near_duplicates),
    ("benchmark decontamination", without_benchmark),
    ("secret scans", without_secrets),
    ("packing", packed),
]]

# SQL has neither the learned stage nor the fingerprints: tests compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; each stage's rows are written to the shared folder and read again."""
    docs, folder = read(spark, sf_dir, "documents"), scratch(spark, "corpus")
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
    return docs
