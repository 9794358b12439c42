"""Sinks: results, batches, manifests, shards, caches, logs."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from .files import write_files


def write_run(results: DataFrame, path: str, run_id: str) -> None:
    """Results under a run id of their own; several runs share the table."""
    results.withColumn("run_id", F.lit(run_id)).write.mode("append").partitionBy("run_id").parquet(path)


def name_batch(rows: DataFrame, prefix: str, index: str = "idx") -> DataFrame:
    """Zero-padded file names of a batch."""
    return rows.withColumn("name", F.format_string(f"{prefix}_%04d.png", F.col(index)))


def write_batch(rows: DataFrame, path: str, prefix: str, index: str = "idx") -> None:
    """The named rows, and one summary row beside them."""
    named = name_batch(rows, prefix, index)
    named.write.json(f"{path}/items")
    named.agg(F.count(F.lit(1)).alias("count"), F.min("name").alias("first"), F.max("name").alias("last")).write.json(f"{path}/summary")


def write_manifest(manifest: DataFrame, path: str) -> None:
    """JSON lines; nulls are written."""
    manifest.write.option("ignoreNullFields", "false").json(path)


def write_json_arrays(rows: DataFrame, path: str, chunk: Column) -> None:
    """Files that are one JSON array each, of the rows that share ``chunk`` (its value is the file's name); nulls are written."""
    arrays = rows.groupBy(chunk.cast("string").alias("c")).agg(F.to_json(F.collect_list(F.struct(*rows.columns)), {"ignoreNullFields": "false"}).alias("a"))
    write_files(arrays.select(F.concat("c", F.lit(".json")).alias("name"), F.encode("a", "utf-8").alias("data")), path)


def write_evaluation(results: DataFrame, summary: DataFrame, path: str) -> None:
    """Results per pair as a table and the summary as JSON; infinite values, which JSON has not, become null there."""
    results.write.parquet(f"{path}/results")
    finite = {c: F.when(F.abs(c) != float("inf"), F.col(c)) for c, t in summary.dtypes if t == "double"}
    summary.withColumns(finite).coalesce(1).write.json(f"{path}/summary")


def write_shards(rows: DataFrame, path: str, shard: str = "worker") -> None:
    """One folder per worker; a hot worker is split over several files by the rows' hash."""
    rows.repartition(F.col(shard), F.pmod(F.xxhash64(*rows.columns), F.lit(4))).write.partitionBy(shard).json(path)


def cache_path(base: str, name: str) -> str:
    """A folder name from a configuration's name."""
    return f"{base}/" + "".join("-" if c in "/\\.?!" else c for c in name)


def materialise_once(df: DataFrame, path: str) -> DataFrame:
    """Write ``df`` unless a finished table stands there; read that one."""
    spark: SparkSession = df.sparkSession
    try:
        return spark.read.schema(df.schema).parquet(path)
    except AnalysisException:
        df.write.mode("ignore").parquet(path)
        return spark.read.schema(df.schema).parquet(path)


def append_log(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def write_comparison(row: DataFrame, path: str) -> None:
    row.coalesce(1).write.json(path)
