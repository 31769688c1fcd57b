"""A training corpus from documents: five stages, each written as Parquet before the next one reads it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointweave.llm import packing, secrets, similar, suffixes, toxicity
from pointweave.llm.common import cut, drop, shared_dir, small_batches, table
from pointweave.llm.queries import tokenizer_file

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _documents(docs: DataFrame) -> DataFrame:
    """The columns of documents; n_chars tells the length of the text as it is now."""
    return docs.select(*[F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(c) for c in COLUMNS])


def toxic_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what a model of all labelled documents scores 0.7 or more. Null texts are scored as empty ones; rows
    without an id and repeated ones are judged by their texts like any other."""
    small_batches(spark)
    labels = table(spark, sf_dir, "labels", "doc_id", "toxic").withColumnRenamed("doc_id", "id")
    model = toxicity.fit(docs.select(F.col("doc_id").alias("id"), "text"), labels)
    return _documents(toxicity.keep_clean(docs.select(*COLUMNS), model))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest id of each group that pairs of five-word Jaccard similarity 0.8 or more link.

    Fingerprints close to each other by vantage points, and sets that share a rare shingle, are compared as
    whole sets. Null and wordless texts are one group; rows without an id stay, repeated rows stay or go together.
    """
    small_batches(spark)
    return _documents(similar.keep_first(docs.select(*COLUMNS), words=5, least=0.8))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes what 50-byte strings of documents of smaller ids cover. All rows stay, null texts too; rows without an
    id lose nothing, repeated ones lose the same."""
    small_batches(spark)
    return _documents(suffixes.without_repeats(docs.select(*COLUMNS)))


def secret_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets by a mark. All rows stay, null texts as they are."""
    small_batches(spark)
    return _documents(secrets.redact(docs.select(*COLUMNS)))


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places each document's tokens in sequences of 4096; null texts have their end token, repeated rows a place each."""
    small_batches(spark)
    return packing.pack(packing.token_pieces(docs.select("doc_id", "text"), tokenizer_file("word_bpe_49k.json")))


STAGES = [
    ("toxicity", toxic_documents),
    ("simhash_near_dedup", near_duplicates),
    ("suffix_array_dedup", repeated_passages),
    ("secret_scan", secret_spans),
    ("best_fit_packing", packed_sequences),
]

#: Trained models, fingerprints and tokenizers are beyond SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir. A stage's folder goes when the next one is written, the last at the end."""
    docs, folder = table(spark, sf_dir, "documents", *COLUMNS), f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
            if k:
                drop(spark, f"{folder}/{k - 1}")
    docs = cut(docs)
    drop(spark, folder)
    return docs
