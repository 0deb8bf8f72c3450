"""From raw documents to token files: quality, near-duplicates, benchmark passages, mixing, output."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from brasstide.llm import decontaminate, mixing, ranker, simhash, tokens
from brasstide.llm.common import written

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
#: Seed of the global shuffle.
SEED = 17


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score at or above the threshold of a ranker fitted on the labelled ones among them."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return ranker.accepted(docs, ranker.fit(*ranker.training_rows(docs, labels)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the least id, of each group of linked fingerprints."""
    return simhash.representatives(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources evened out to the square roots of their sizes, in globally shuffled order."""
    return mixing.mix(docs, seed=SEED).select(docs.columns)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row in flat files, in globally shuffled order; per row what the files say of it.

    The mixing stage's shuffle is drawn again, since Parquet is not read back in order: the place is a
    digest of (seed, id, place of the row in `docs`), so copies of a document lie apart. `docs` must be
    stored rows, whose places a repeated task finds unchanged.
    """
    key_type = docs.schema["doc_id"].dataType.simpleString()
    order = mixing.order_key(SEED, F.col("doc_id"), F.monotonically_increasing_id())
    return tokens.read(*tokens.write(docs, TOKENIZER, order=order), key_type=key_type)


STAGES = [
    ("quality classifier", quality),
    ("simhash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing to target weights", mixture),
    ("token-id output", token_files),
]

#: Fingerprints, a fitted model and token ids are not SQL; tests/llm holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each stored as Parquet and read back by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return docs
