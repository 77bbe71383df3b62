"""The registered queries of this package: thin, each on its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import adsampling, bond, impacts, langid, licenses, mixing, packing, pii, ppm, secrets, simhash, toxicity, whitening
from .scale import table


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.licenses(table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.language_model(table(spark, sf_dir, "documents"))


def op4_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adsampling.nearest(table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 20 == 0, k=20)


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle_words=3, max_bits=2)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def op6_top_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return impacts.top_products(table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 50 == 0, k=5)


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.personal_data(table(spark, sf_dir, "documents")).withColumn("base", F.filter("spans", lambda s: s.strict))

    def count(k: int) -> Column:
        return F.size(F.filter("base", lambda s: s.kind == k)).cast("long").alias(f"n_{pii.KINDS[k]}")

    counts = [count(k) for k in range(len(pii.KINDS))]
    return found.select("doc_id", *counts, F.sha2(pii.digest(F.col("base")), 256).alias("base_sha256"), pii.digest(F.col("spans")).alias("spans"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_id(table(spark, sf_dir, "documents"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mixing.schedule(docs, mixing.tempered_weights(docs))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return bond.hard_negatives(table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 100 == 0, label)


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.secrets(table(spark, sf_dir, "documents"))
    kinds = secrets.KINDS

    def count(name: str) -> Column:
        return F.size(F.filter("spans", lambda s: s.kind == kinds.index(name))).cast("long").alias(f"n_{name}")

    base = F.filter("spans", lambda s: s.kind < kinds.index("random"))
    return found.select("doc_id", *[count(k) for k in kinds[:3]], F.sha2(secrets.digest(base), 256).alias("base_sha256"), secrets.digest(F.col("spans")).alias("spans"), count("random"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(table(spark, sf_dir, "embeddings"), components=4)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    numbered = (op1_license_scan, op2_toxicity, op3_lm_scoring, op4_nearest_vectors, op5_simhash_near_dedup, op6_top_products, op7_pii, op8_language_id, op9_mixing, op10_packing, op11_hard_negatives, op12_secret_scan, op13_whitening)
    return {f.__name__: f for f in numbered}


def oracle_sql() -> dict[str, str]:
    return {"op1_license_scan": licenses.licenses_sql(), "op6_top_products": impacts.top_products_sql(), "op11_hard_negatives": bond.hard_negatives_sql()}
