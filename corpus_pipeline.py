"""Corpus pipeline: quality rules, near-duplicates, repeated passages, source mixing, token ids."""
from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelloom.llm import bpe, mixing, quality, simhash, substring
from pixelloom.llm.common import discard_tables, materialize

#: Words of a passage that may not repeat across documents.
PASSAGE = 50


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go; the columns stay."""
    return quality.quality_filter(docs)


def copies_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of exact and near copies the document of smallest id stays."""
    return simhash.drop_copies(docs)


def passages_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of PASSAGE or more words that stand in a document of smaller id are cut out; n_chars follows the text."""
    return substring.clean_passages(docs, PASSAGE).withColumn("n_chars", F.length("text").cast("long"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are dropped or repeated so that the sources meet their shares of tokens."""
    return mixing.apply_mix(docs)


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of every document."""
    ids = bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return ids.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [("quality_rules", quality_stage), ("simhash_near_dedup", copies_stage), ("substring_dedup", passages_stage), ("source_mixing", mixing_stage), ("bpe_encoding", tokens_stage)]
#: SQL has neither the sketches nor the fingerprints; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, done = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
        discard_tables(*done)
        done = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
