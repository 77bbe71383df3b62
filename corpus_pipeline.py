"""The corpus pipeline: toxicity, near-dedup, personal data, mixing, packing, each stage on what its predecessor kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from sessionloom.llm import mixing, packing, pii, scale, simhash, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the classifier, fitted to the labels, does not hold toxic. Null and empty texts are scored as texts without
    words, repeated rows each; all columns stay; without confirmed toxic rows nothing goes."""
    return toxicity.remove_toxic(docs, scale.table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies: the one with the smallest id, a null id last. Repeated rows are copies of each other, and so
    are null and wordless texts; all columns stay."""
    return simhash.keep_representatives(docs)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with personal data replaced by its kind. Null and empty texts, repeated rows and all columns stay; n_chars
    follows the new text."""
    return pii.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All the documents, repeated rows and null texts among them, in the order of the mix; null sources are a source."""
    return mixing.in_mix_order(docs, mixing.tempered_weights(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of each document, packed into sequences; null texts count as empty, repeated rows are packed each."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), order=scale.row_order(docs))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("pii", redact_personal_data),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: SQL can't express the learned stages; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to the documents; what a stage returns is written as Parquet and read again for the next."""
    docs = scale.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scale.written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
