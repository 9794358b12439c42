"""Sources: manifests in several formats, images, listings, logs. All reads are lazy and declare their schemas."""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import kernels as K
from ..operators import manifest as MF
from ..operators.kernels import unpack

RECORD = "image_path string, caption string, mask_path string, label int"


def read_lines(spark: SparkSession, path: str | list[str], pattern: str = "*") -> DataFrame:
    """Lines of text files with their file: file, line. Files that cannot be read are skipped."""
    r = spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").option("ignoreCorruptFiles", "true")
    return r.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("line"))


def read_jsonl(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Tolerant scan: blank, broken and incomplete lines are left out (``MF.classify_lines`` counts them)."""
    return MF.parse_lines(read_lines(spark, path, "*.{jsonl,json,txt}"), "file")


def read_jsonl_folder(spark: SparkSession, folder: str) -> DataFrame:
    """All .jsonl and .json files of a folder, line by line."""
    return MF.parse_lines(read_lines(spark, folder, "*.{jsonl,json}"), "file")


def read_json_array(spark: SparkSession, path: str, schema: str = RECORD) -> DataFrame:
    """Files that are one JSON array each, in any folder below ``path``."""
    return spark.read.schema(schema).option("recursiveFileLookup", "true").json(path, multiLine=True)


def read_jsonl_strict(spark: SparkSession, path: str, required: tuple[str, ...] = MF.REQUIRED) -> DataFrame:
    """Every line must be a whole record: the first bad one of a file is an error that names file and line (from 0). The files are checked before they
    are read."""
    lines = spark.read.option("recursiveFileLookup", "true").text(path)
    lines = lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("i"), F.col("value").alias("line"))
    c = MF.classify_lines(lines, required=required)
    bad = c.filter(~F.col("reason").isin("ok", "blank")).select(F.min(F.struct("file", "split", "i", "reason", F.substring("line", 1, 80).alias("start"))).alias("b")).first()["b"]
    if bad:
        number = lines.filter((F.col("file") == bad["file"]) & (F.struct("split", "i") < F.struct(F.lit(bad["split"]).alias("split"), F.lit(bad["i"]).alias("i")))).count()
        raise ValueError(f"bad record ({bad['reason']}) in {bad['file']}, line {number}: {bad['start']}")
    return c.filter(F.col("reason") == "ok").select("file", F.from_json("line", RECORD).alias("r")).select("file", "r.*")


FORMATS = (".json", ".jsonl", ".parquet")


def _source(spark: SparkSession, s: dict) -> DataFrame:
    p = s["path"].rstrip("/")
    return spark.read.parquet(p) if p.endswith(".parquet") else read_json_array(spark, p) if p.endswith(".json") else read_jsonl_strict(spark, p).drop("file")


def read_catalogue(spark: SparkSession, catalogue: DataFrame | list[dict]) -> DataFrame:
    """Several sources as one table. ``catalogue`` is a table or a list of: path, and if wanted type (default ``default``), ratio (of the rows, an exact number of them, the first by
    a hash of ``key``, an expression; without one, of the whole row), root (joined to all path columns there are), image_root (attached as _image_root).

    The format follows the path's ending (.json: files that are one array; .jsonl: strict lines; .parquet); any other is refused before anything is read. Sources may have different
    columns: what one lacks is null, and a column whose types differ is an error that names it. The catalogue has a row a source and is read to the driver, the sources
    are not."""
    from ..operators.sampling import exact_sample

    sources = [r.asDict() for r in catalogue.collect()] if isinstance(catalogue, DataFrame) else catalogue
    for s in sources:
        if not s["path"].rstrip("/").endswith(FORMATS):
            raise ValueError(f"unknown source format: {s['path']}")
    parts, kinds = [], {}
    for s in sources:
        d, ratio = _source(spark, s), s.get("ratio")
        for name, kind in d.dtypes:
            if kinds.setdefault(name, kind) != kind:
                raise ValueError(f"column {name} of {s['path']} is {kind}, not {kinds[name]} as in an earlier source")
        if ratio is not None and ratio < 1.0:
            key = F.expr(s["key"]) if s.get("key") else F.xxhash64(F.to_json(F.struct("*")))
            d = exact_sample(d.withColumn("_k", key), "_k", ratio, 0).drop("_k")
        d = MF.prefix_paths(d, s["root"], ("path", "image_url", "image", "image_path")) if s.get("root") else d
        parts.append(MF.with_root(d, s.get("image_root")).withColumn("_type", F.lit(s.get("type") or "default")))
    return MF.union_all(parts)


#: Partitions of a scan of files that one task reads. Spark counts 4 MB for opening a file, so a partition holds 32 small files, and a task with a Python worker for each
#: would take far longer to begin than to read.
MERGED = 64


def _merged(files: DataFrame) -> DataFrame:
    """The scan in fewer tasks, without a shuffle: MERGED partitions each, or less, as long as there are four tasks a core."""
    parts, cores = files.rdd.getNumPartitions(), files.sparkSession.sparkContext.defaultParallelism
    return files.coalesce(max(4 * cores, -(-parts // MERGED)))


def scan_images(spark: SparkSession, path: str) -> DataFrame:
    """path, height, width, channels, px: images packed as bytes, row by row, in RGB order (the decoder gives BGR). Broken files, whether no image at all, cut off or
    empty, are left out; ``broken_images`` counts them."""
    raw = spark.read.format("image").option("dropInvalid", "true").option("ignoreCorruptFiles", "true").option("recursiveFileLookup", "true").load(path).select("image.*")

    def run(batches):
        for b in batches:
            px = []
            for c, data in zip(b.column(3).to_pylist(), b.column(4)):
                im = np.frombuffer(data.as_buffer(), np.uint8).reshape(-1, c)
                px.append((im[:, [2, 1, 0, *range(3, c)]] if c >= 3 else im).tobytes())
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(px, pa.binary())], names=["path", "height", "width", "channels", "px"])

    return _merged(raw).select("origin", "height", "width", "nChannels", "data").mapInArrow(run, "path string, height int, width int, channels int, px binary")


def broken_images(files: DataFrame, images: DataFrame) -> DataFrame:
    """The files of a listing (path) that ``scan_images`` could not decode. Paths may have a scheme or not."""
    plain = lambda c: F.regexp_replace(c, "^[a-z0-9]+:/+", "/")
    good = images.select(plain(F.col("path")).alias("_p"))
    return files.join(good.hint("merge"), plain(F.col("path")) == F.col("_p"), "left_anti")


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """``scan_images`` with the pixels as an array."""
    return unpack(scan_images(spark, path))


def scan_masks(spark: SparkSession, path: str) -> DataFrame:
    """path, height, width, px: one 8-bit channel, packed. Files of three or more channels are turned to luma."""
    return K.map_images(scan_images(spark, path), K.to_luma, "path", packed=True).drop("channels")


def read_masks(spark: SparkSession, path: str) -> DataFrame:
    """``scan_masks`` with the pixels as an array."""
    return unpack(scan_masks(spark, path))


def read_captions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(X.strip(F.col("value")).alias("caption")).filter(F.length("caption") > 0)


def read_grades(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema="image_id string, DR_grade int")


def read_sidecars(spark: SparkSession, folder: str, schema: str = "caption string, dr_grade string, seed int") -> DataFrame:
    """One JSON document per file, with the file's path."""
    raw = spark.read.option("pathGlobFilter", "*.json").option("recursiveFileLookup", "true").text(folder, wholetext=True)
    return raw.select(F.col("_metadata.file_path").alias("path"), F.from_json("value", schema).alias("m")).select("path", "m.*")


def list_files(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """path and length of files, without reading them."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.select("path", "length", "modificationTime")


def list_images(spark: SparkSession, path: str) -> DataFrame:
    """PNG and JPG listings together."""
    return list_files(spark, path, "*.png").unionByName(list_files(spark, path, "*.{jpg,jpeg}"))


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """The long summary of an evaluation that ``sinks.write_evaluation`` wrote."""
    return spark.read.schema("metric string, n bigint, mean double, std double, min double, max double").json(f"{path}/summary")
