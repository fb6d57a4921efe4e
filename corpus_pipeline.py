"""The corpus pipeline: four stages over ``documents``, each written and read back by the next.

1. language_id     drops documents whose language is rejected (no letters, or a narrow margin)
2. near_dedup      keeps one document of every SimHash class (op2's link rule), that of the smallest id
3. mix             repeats each document as the source targets ask
4. encode          byte-level BPE ids of every document, and digests of the ids and of their decoded text

Null and empty texts have no letters and leave at stage 1; an empty table passes through
every stage.  Repeated rows and rows with null ids are classed by text at stage 2, which keeps
one row of a class: the smallest id (null last), then the smallest digest of its content, which
also settles ties.  Stages 1 to 3 carry every column of the table through as it is, whatever
its name; stage 4 returns the ids and their digests.  Texts of any length are read whole.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidewheel.llm import byte_bpe, language_id, mixing, simhash
from tidewheel.llm._session import dropped, fresh_folder, modest_batches, usual_batches


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    modest_batches(spark)
    model = language_id.fit(docs.where(~language_id.held_out()))
    return language_id.keep_identified(docs, model)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    modest_batches(spark)
    return simhash.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    modest_batches(spark)
    return byte_bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, keep_ids=True, share=0.5)


STAGES = [("language_id", identify_language), ("near_dedup", near_dedup), ("mix", mix_sources), ("encode", encode)]

#: Compression classification, SimHash and BPE are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another; a stage's table goes once the next one stands, and the session's
    setting for batches is as before."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder, before, ours = fresh_folder(spark, "pipeline"), None, modest_batches(spark)
    try:
        for name, stage in STAGES:
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
            docs = spark.read.parquet(f"{folder}/{name}")
            if before:
                dropped(spark, f"{folder}/{before}")
            before = name
    finally:
        if ours:
            usual_batches(spark)
    return docs
