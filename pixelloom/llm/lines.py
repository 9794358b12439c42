"""Line dedup over levelled sorted runs of line hashes (DataFrame functions only).

Batches of documents come one after the other. A batch's lines become keys (stripped, A-Z in lower case) and these 128-bit hashes, counted once a
document before anything is shuffled. The index is a list of runs: tables of (hash, documents, largest document), bucketed and sorted by
hash, at levels. A new batch is anti-joined with the runs by merging, which leaves out the keys that a run has settled already, and adds the rest as a
run of its own; two runs of one level are merged into one of the next. At the end the runs are merged into one, and the documents drop the lines
whose keys enough documents hold, except in the largest document.
"""
from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.image import let
from .common import WS_CHARS, discard, discard_tables, materialize, scratch, shuffle_partitions

#: A key shorter than this many code points, or in fewer documents, drops nothing.
LEAST_CHARS, LEAST_DOCS = 20, 3
#: Batches that one table is dealt to, by descending id.
BATCHES = 4
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Characters outside of ASCII that have a lower case.
CAPITALS = "[[\\p{IsUppercase}\\p{Lt}]&&[^\\x00-\\x7F]]"
#: The id that stands for null in comparisons: smaller than any other.
NO_ID = -(2**63)


def line_key(line: Column) -> Column:
    """The line stripped of ``[\\x20\\x09-\\x0D]`` at both ends, with A-Z in lower case and all other characters as they are."""

    def folded(key: Column) -> Column:
        # Where no capital stands outside of ASCII, the plain function, which is much faster, changes nothing else.
        plain = (F.octet_length(key) == F.length(key)) | ~key.rlike(CAPITALS)
        return F.when(plain, F.lower(key)).otherwise(F.translate(key, UPPER, LOWER))

    return let(F.btrim(line, F.lit(WS_CHARS)), folded)


def lines_of(text: Column) -> Column:
    """The \\n-split lines; a null or empty text has one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def key_hash(line: Column, least: int = LEAST_CHARS) -> Column:
    """The first 128 bits of the key's SHA-256; null for short keys. That two keys of a corpus of 10^12 share one has a probability of under 10^-14."""
    return let(line_key(line), lambda key: F.when(F.length(key) >= least, F.unhex(F.left(F.sha2(key.cast("binary"), 256), F.lit(32)))))


class Runs:
    """The index: runs by level, in the folder that all executors share. ``fan`` runs of a level are merged into one of the next."""

    def __init__(self, spark: SparkSession, least: int = LEAST_DOCS, fan: int = 2):
        self.spark, self.least, self.fan, self.buckets = spark, least, fan, shuffle_partitions(spark)
        self.levels: list[list[str]] = []
        self.paths: dict[str, str] = {}

    def _write(self, keys: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        self.paths[name] = scratch(self.spark, "line-run")
        keys.repartition(self.buckets, "h").write.bucketBy(self.buckets, "h").sortBy("h").option("path", self.paths[name]).saveAsTable(name)
        return name

    def _drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE {name}")
        discard(self.spark, self.paths.pop(name))

    def _merged(self, names: list[str]) -> DataFrame:
        """Runs of like buckets side by side: no shuffle. The sums of the documents and the largest id of each hash."""
        out = self.spark.table(names[0])
        for n in names[1:]:
            b = self.spark.table(n).select(F.col("h").alias("bh"), F.col("docs").alias("bd"), F.col("top").alias("bt"))
            zero = F.lit(0).cast("long")
            out = out.join(b.hint("merge"), F.col("h") == F.col("bh"), "full_outer").select(
                F.coalesce("h", "bh").alias("h"), (F.coalesce("docs", zero) + F.coalesce("bd", zero)).alias("docs"), F.greatest("top", "bt").alias("top"))
        return out

    def add(self, keys: DataFrame) -> None:
        """``keys``: h, docs, top (each hash once). What a run has settled (enough documents, and a larger one than any here) goes; the rest is added."""
        for name in [n for level in self.levels for n in level]:
            run = self.spark.table(name).filter(F.col("docs") >= self.least).select(F.col("h").alias("rh"), F.col("top").alias("rt"))
            keys = keys.join(run.hint("merge"), (F.col("h") == F.col("rh")) & (F.col("rt") >= F.col("top")), "left_anti")
        self._put(0, self._write(keys))

    def _put(self, level: int, name: str) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)
        if len(self.levels[level]) == self.fan:
            names, self.levels[level] = self.levels[level], []
            merged = self._write(self._merged(names))
            for n in names:
                self._drop(n)
            self._put(level + 1, merged)

    def settled(self) -> DataFrame:
        """h and top of the hashes that enough documents hold, over all runs."""
        names = [n for level in self.levels for n in level]
        return self._merged(names).filter(F.col("docs") >= self.least).select("h", "top")

    def close(self) -> None:
        for name in list(self.paths):
            self._drop(name)
        self.levels = []


def _batch_of(docs: DataFrame, key: str, batches: int) -> Column:
    """Number of the batch of a row, by descending id, in batches of like size; rows without an id come last."""
    cuts = docs.agg(F.percentile_approx(F.col(key), [k / batches for k in range(1, batches)], 10_000)).first()[0] or []
    out = F.lit(0)
    for c in cuts:
        out = out + F.when(F.col(key) < c, 1).otherwise(0)
    return F.when(F.col(key).isNull(), F.lit(batches - 1)).otherwise(out)


def dedup_lines(docs: DataFrame, text: str = "text", key: str = "doc_id", least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS, batches: int = BATCHES) -> DataFrame:
    """One row per row of ``docs``: key, n_lines, n_dropped, kept (the lines that stay, joined by \\n).

    Every row counts as a document; rows that share an id keep or lose their lines together, and a null id is smaller than any other. A null or empty text is one
    empty line. Short keys never drop lines; repeats of a line inside the largest document stay. Other columns play no part and may have any name. An
    empty table gives an empty result. Texts of any length are split whole."""
    spark = docs.sparkSession
    # A row is known by its id and a hash of its text, as ids may repeat.
    slim = docs.select(F.col(key).cast("long").alias("d"), F.col(text).alias("t"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("th"))
    hashes = F.transform(lines_of(F.col("t")), lambda x: key_hash(x, least_chars))
    table = slim.select("d", "th", _batch_of(slim, "d", batches).alias("batch"), hashes.alias("hs"))
    path = scratch(spark, "line-hashes")
    table.write.partitionBy("batch").parquet(path)
    kind = "d bigint, th bigint, hs array<binary>, batch int"
    runs = Runs(spark, least_docs)
    for b in range(batches):
        mine = spark.read.schema(kind).parquet(path).filter(F.col("batch") == b)
        once = mine.select(F.coalesce("d", F.lit(NO_ID)).alias("d"), F.explode(F.array_distinct("hs")).alias("h")).filter(F.col("h").isNotNull())
        runs.add(once.groupBy("h").agg(F.count(F.lit(1)).alias("docs"), F.max("d").alias("top")))
    common = materialize(runs.settled(), "line-common")
    runs.close()
    places = spark.read.schema(kind).parquet(path).select(F.coalesce("d", F.lit(NO_ID)).alias("d"), "th", F.posexplode("hs").alias("p", "h")).filter(F.col("h").isNotNull())
    gone = places.join(common.withColumnRenamed("h", "ch").hint("merge"), (F.col("h") == F.col("ch")) & (F.col("d") < F.col("top"))).select("d", "th", "p")
    gone = materialize(gone.groupBy(F.col("d").alias("gd"), F.col("th").alias("gt")).agg(F.collect_set("p").alias("gone")), "line-gone")
    discard(spark, path)
    discard_tables(common)
    out = slim.join(gone.hint("merge"), (F.coalesce("d", F.lit(NO_ID)) == F.col("gd")) & (F.col("th") == F.col("gt")), "left")
    lines = lines_of(F.col("t"))
    stay = lambda x: F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.col("gone"))
    cut = let(lines, lambda x: F.array_join(F.transform(stay(x), lambda p: F.get(x, p)), "\n"))
    kept = F.when(F.col("gone").isNull(), F.coalesce("t", F.lit(""))).otherwise(cut)
    return out.select(F.col("d").alias(key), F.size(lines).cast("long").alias("n_lines"), F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long").alias("n_dropped"), kept.alias("kept"))
