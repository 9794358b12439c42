"""Helpers shared by the training-data operators."""
from __future__ import annotations

import ctypes

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import discard, discard_tables, materialize, scratch, shared_dir  # noqa: F401

#: The white space that separates words in every operator here: space and U+0009 to U+000D.
WS_CLASS = "[\\x20\\x09-\\x0D]+"
WS_CHARS = " \t\n\x0b\f\r"


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop shuffle files of plans that are no longer referenced."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def give_back() -> None:
    """Return to the system what this process has freed: a Python worker outlives its task, and what it keeps counts beside what the next one takes."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_of(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text column; a null or blank text has none."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(WS_CHARS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, WS_CLASS))


def n_words_of(text: Column) -> Column:
    return F.size(words_of(text)).cast("long")
