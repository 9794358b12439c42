"""Streams over growing folders: incremental ingest of shards, and a live monitor of step windows.

Both run until all files that are there have been read, and go on from their checkpoint when they are called again.
"""
from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import manifest as MF

LINES = "file string, image_path string, caption string, mask_path string, text_only boolean, line string, reason string, batch bigint"
COUNTS = "file string, reason string, n bigint, batch bigint"


def _run(writer, checkpoint: str) -> None:
    writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def ingest_shards(spark: SparkSession, source: str, target: str, checkpoint: str, files_per_batch: int = 1000) -> None:
    """Parse the completed line files that have come since the last call, ``files_per_batch`` at a time. ``target`` gets, in every micro-batch, the valid records, the rejected
    lines with their reason, and last the counts of both for each file (``read_records``, ``read_rejected``, ``read_counters``).

    A micro-batch that fails at any point is run again with the same files and replaces what it had written under its number, and readers take only batches whose
    counts are there: every line counts once. Each line is parsed once; the counts come from what was written."""
    lines = spark.readStream.schema("value string").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_batch).text(source)
    judged = MF.judged_lines(lines.select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("line")), "file")

    def put(df: DataFrame, number: int) -> None:
        at = f"{target}/lines/batch={number}"
        df.withColumn("line", F.when(F.col("reason") != "ok", F.col("line"))).write.mode("overwrite").partitionBy("reason").parquet(at)
        _count(spark, at, f"{target}/counts/batch={number}")

    _run(judged.writeStream.foreachBatch(put), checkpoint)


def _count(spark: SparkSession, lines: str, target: str) -> None:
    try:
        rows = spark.read.schema(LINES).parquet(lines)
    except AnalysisException:  # a batch without lines has no folders
        rows = spark.createDataFrame([], LINES)
    rows.groupBy("file", "reason").agg(F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(target)


def read_counters(spark: SparkSession, target: str) -> DataFrame:
    """file, reason, n and batch of all finished micro-batches."""
    return spark.read.schema(COUNTS).parquet(f"{target}/counts")


def _finished(spark: SparkSession, target: str) -> DataFrame:
    done = read_counters(spark, target).select(F.col("batch").alias("_done")).distinct()
    return spark.read.schema(LINES).parquet(f"{target}/lines").join(F.broadcast(done), F.col("batch") == F.col("_done"), "left_semi")


def read_records(spark: SparkSession, target: str) -> DataFrame:
    """file, batch, image_path, caption, mask_path, text_only of the valid lines of all finished micro-batches."""
    return _finished(spark, target).filter(F.col("reason") == "ok").select("file", "batch", "image_path", "caption", "mask_path", "text_only")


def read_rejected(spark: SparkSession, target: str) -> DataFrame:
    """file, batch, reason and line of the other lines; blank ones too."""
    return _finished(spark, target).filter(F.col("reason") != "ok").select("file", "batch", "reason", "line")


def step_monitor(spark: SparkSession, source: str, target: str, checkpoint: str, every: int, late: int = 0, files_per_batch: int = 1000, schema: str = "step bigint, loss double") -> None:
    """Means of the windows of ``every`` steps, appended to the table ``target`` (window, loss, n) once each.

    Steps serve as event time: a window is closed, written and dropped from the state when a step has come that lies ``late`` steps beyond its end or further, so the
    state holds the windows of the last ``every + late`` steps. A row that comes after its window was closed (as a resumed run may repeat steps) is left out. A
    window whose last step never came is not written, nor is the last one while no later step is there; one that began late, after a resume, is."""
    log = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    log = log.withColumn("at", F.timestamp_seconds("step")).withWatermark("at", f"{late} seconds")
    closed = F.max((F.col("step") + 1) % every == 0)
    agg = log.groupBy(F.window("at", f"{every} seconds").alias("w")).agg(F.avg("loss").alias("loss"), F.count(F.lit(1)).alias("n"), closed.alias("closed"))
    out = agg.filter("closed").select(F.floor(F.unix_seconds("w.start") / every).alias("window"), "loss", "n")
    _run(out.writeStream.outputMode("append").format("parquet").option("path", target), checkpoint)


def read_windows(spark: SparkSession, target: str) -> DataFrame:
    return spark.read.schema("window bigint, loss double, n bigint").parquet(target)
