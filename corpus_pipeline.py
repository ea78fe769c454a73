"""A training corpus from raw documents: toxic and poor texts go, one of each group of near copies stays, the rest is packed.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, with the columns of its
documents in all stages but the last. run() writes each stage's rows as Parquet in the shared folder and gives the next one
what it reads there, so a lost executor repeats no finished stage. Every stage bounds the bytes of text that Python gets at once, for
the session.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens.llm import common, compression, near_copies, packing, toxicity


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not called toxic. Null and empty texts stay."""
    common.small_batches(spark)
    model = toxicity.fit(docs, common.table(spark, sf_dir, "labels"), ~toxicity.held_out(F.col("doc_id")))
    return toxicity.keep(docs, model, threshold=0.5)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are called good. Null and empty texts have no quality and go where calibration puts them."""
    common.small_batches(spark)
    model = compression.fit(docs, common.table(spark, sf_dir, "labels"), ~compression.held_out(F.col("doc_id")))
    return compression.keep(docs, model, threshold=0.7)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id; near copies have a Jaccard
    similarity of five-word shingles of 0.8 or more. Fingerprints within op5's two bits give the first pairs; those of copies
    edited further come from min-hashes and a prefix filter. Every pair is measured on whole texts."""
    common.small_batches(spark)
    return near_copies.one_of_each(docs, size=5, least=0.8)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in the training sequences."""
    common.small_batches(spark)
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), size=2048)


STAGES = [("toxicity", toxicity_stage), ("quality_classifier", quality_stage), ("simhash_near_dedup", near_dedup_stage), ("best_fit_packing", packing_stage)]

#: Trained classifiers and packing have no SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    folder = f"{common.shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
