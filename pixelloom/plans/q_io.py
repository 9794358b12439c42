"""Queries that write a view of the given tables and read it back: sinks, sources, streams, extension points."""
from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from ..functions import metrics as M
from ..operators import extend as EX
from ..sources import readers as RD
from ..sources import sinks as K
from ..sources.scratch import scratch
from ..streaming import stream as ST
from . import q_images as QI
from . import q_manifest as QM
from . import q_plans as QP
from . import views as V

QUERIES: dict = {}
SQL: dict = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql if sql.startswith("WITH ") else V.with_views(sql)
        return fn

    return add


_REC = f"SELECT image_path, caption, mask_path, mask_path IS NULL AS text_only FROM ({QM._RECORDS})"


def _lines_folder(spark, sf) -> str:
    path = scratch(spark, "lines")
    V.manifest_lines(spark, sf).select("line").write.text(path)
    return path


@query("s2_folder_scan", _REC)
def s2(spark, sf):
    return RD.read_jsonl(spark, _lines_folder(spark, sf)).select("image_path", "caption", "mask_path", "text_only")


def _ingested(spark, sf) -> str:
    """Shards that arrive in two goes, taken in by two calls, two files to a micro-batch."""
    path, lines = scratch(spark, "stream"), V.manifest_lines(spark, sf)
    for part in (F.col("line_no") % 5 < 3, F.col("line_no") % 5 >= 3):
        lines.filter(part).select("line").repartition(4).write.mode("append").text(f"{path}/in")
        ST.ingest_shards(spark, f"{path}/in", f"{path}/out", f"{path}/checkpoint", 2)
    return f"{path}/out"


@query("t1_stream_ingest", _REC)
def t1(spark, sf):
    return ST.read_records(spark, _ingested(spark, sf)).select("image_path", "caption", "mask_path", "text_only")


@query("t1_stream_rejected", f"SELECT reason, count(*) AS n, sum(length(line))::BIGINT AS chars FROM (SELECT {QM._REASON} AS reason, line FROM manifest_lines) WHERE reason <> 'ok' GROUP BY reason")
def t1_rejected(spark, sf):
    return ST.read_rejected(spark, _ingested(spark, sf)).groupBy("reason").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("line")).alias("chars"))


@query("t1_stream_counters", QM.SQL["a2_load_counters"])
def t1_counters(spark, sf):
    return ST.read_counters(spark, _ingested(spark, sf)).groupBy("reason").agg(F.sum("n").alias("n"))


# Windows whose last step came, and a step behind it.
@query("t2_stream_windows", "SELECT step // 30 AS \"window\", round(avg(loss), 6) AS loss, count(*) AS n FROM run_log WHERE step % 211 < 200 GROUP BY 1 HAVING bool_or((step + 1) % 30 = 0) AND (step // 30 + 2) * 30 <= (SELECT max(step) FROM run_log WHERE step % 211 < 200)")
def t2(spark, sf):
    """The log comes in five files, rows up to 25 steps late; the monitor is stopped and started between them. Some steps are missing."""
    path, log = scratch(spark, "stream"), V.run_log(spark, sf).filter(F.col("step") % 211 < 200).select("step", "loss")
    size = (log.agg(F.max("step")).first()[0] or 0) // 5 + 1
    part = F.floor((F.col("step") + F.when(F.col("step") % 7 == 0, 25).otherwise(0)) / size)
    for k in range(6):
        log.filter(part == k).coalesce(1).write.mode("append").parquet(f"{path}/in")
        if k in (2, 5):
            ST.step_monitor(spark, f"{path}/in", f"{path}/out", f"{path}/checkpoint", 30, 30, 1)
    return ST.read_windows(spark, f"{path}/out").select("window", F.round("loss", 6).alias("loss"), "n")


_MANIFEST = "SELECT image_path, caption, mask_path, label FROM manifest"


@query("k3_manifest_jsonl", _MANIFEST)
def k3(spark, sf):
    path = scratch(spark, "manifest")
    K.write_manifest(V.manifest(spark, sf).select("image_path", "caption", "mask_path", "label"), path)
    return spark.read.schema(RD.RECORD).json(path).select("image_path", "caption", "mask_path", "label")


@query("s4_strict_jsonl", _MANIFEST)
def s4(spark, sf):
    path = scratch(spark, "manifest")
    K.write_manifest(V.manifest(spark, sf).select("image_path", "caption", "mask_path", "label"), path)
    return RD.read_jsonl_strict(spark, path).select("image_path", "caption", "mask_path", "label")


@query("s3_json_array", _MANIFEST)
def s3(spark, sf):
    """Arrays of 64 rows."""
    path = scratch(spark, "array")
    m = V.manifest(spark, sf).select("image_path", "caption", "mask_path", "label", "doc_id")
    K.write_json_arrays(m, path, F.floor(F.col("doc_id") / 64))
    return RD.read_json_array(spark, path).select("image_path", "caption", "mask_path", "label")


_ID = "CAST(regexp_extract(image_path, '([0-9]+)[.]png', 1) AS BIGINT)"
_SOURCES = """WITH r AS (SELECT *, doc_id % 3 AS k, row_number() OVER (PARTITION BY doc_id % 3 ORDER BY (doc_id * 1103515245) % 2147483648, doc_id) AS n, count(*) OVER (PARTITION BY doc_id % 3) AS c FROM manifest)
SELECT CASE k WHEN 0 THEN 'first/' || image_path ELSE image_path END AS image_path, CASE WHEN k <> 1 THEN label END AS label, CASE WHEN k = 2 THEN length(grp)::INT END AS width, CASE k WHEN 1 THEN 'lines' WHEN 2 THEN 'tables' ELSE 'default' END AS _type,
  CASE k WHEN 1 THEN '/mnt/lines' END AS _image_root FROM r WHERE n <= floor(c * CASE k WHEN 0 THEN 0.5 WHEN 1 THEN 1.0 ELSE 0.25 END)"""


@query("s5_catalogue", V.with_views(_SOURCES))
def s5_catalogue(spark, sf):
    """A catalogue that is a table, of a source of JSON arrays, one of JSON lines and one of Parquet, whose columns differ."""
    path, m = scratch(spark, "sources"), V.manifest(spark, sf)
    part = lambda k, *cols: m.filter(F.col("doc_id") % 3 == k).select("image_path", "caption", *cols)
    K.write_json_arrays(part(0, "label", "doc_id"), f"{path}/a.json", F.floor(F.col("doc_id") / 64))
    K.write_manifest(part(1, "mask_path"), f"{path}/b.jsonl")
    part(2, "label", F.length("grp").alias("width")).write.parquet(f"{path}/c.parquet")
    kind = "path string, type string, ratio double, key string, root string, image_root string"
    rows = [(f"{path}/a.json", None, 0.5, _ID, "first", None), (f"{path}/b.jsonl", "lines", 1.0, None, None, "/mnt/lines"), (f"{path}/c.parquet", "tables", 0.25, _ID, None, None)]
    spark.createDataFrame(rows, kind).write.parquet(f"{path}/catalogue")
    return RD.read_catalogue(spark, spark.read.parquet(f"{path}/catalogue")).select("image_path", "label", "width", "_type", "_image_root")


@query("s10_grades_csv", "SELECT image_path AS image_id, label AS DR_grade FROM manifest")
def s10(spark, sf):
    path = scratch(spark, "grades")
    V.manifest(spark, sf).select(F.col("image_path").alias("image_id"), F.col("label").alias("DR_grade")).write.csv(path, header=True)
    return RD.read_grades(spark, path)


@query("s11_sidecars", "SELECT caption, dr_grade, seed FROM (SELECT item_id::VARCHAR AS dr_grade, text AS caption, item_id::INT AS seed FROM benchmark)")
def s11(spark, sf):
    path = scratch(spark, "sidecars")
    b = V.table(spark, sf, "benchmark").select(F.to_json(F.struct(F.col("text").alias("caption"), F.col("item_id").cast("string").alias("dr_grade"), F.col("item_id").cast("int").alias("seed"))).alias("value"), F.col("item_id").alias("k"))
    b.repartitionByRange(200, "k").select("value").write.option("maxRecordsPerFile", 1).text(path)
    files = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True)
    return files.select(F.from_json("value", "caption string, dr_grade string, seed int").alias("m")).select("m.*")


def _listed(spark, sf, rows, name: str):
    """Files of a folder for each group of ``rows``, written and listed: grp."""
    path = scratch(spark, name)
    rows.select("grp", "doc_id").repartition("grp").write.partitionBy("grp").json(path)
    return RD.list_files(spark, path, "*.json").select(F.regexp_extract("path", "grp=([^/]+)/", 1).alias("grp"), "length").filter("length > 0").select("grp").distinct()


@query("s12_file_listing", "SELECT DISTINCT grp FROM manifest")
def s12(spark, sf):
    return _listed(spark, sf, V.manifest(spark, sf), "listing")


@query("u5_two_listings", "SELECT DISTINCT 'png' AS kind, grp FROM manifest WHERE doc_id % 3 = 0 UNION ALL SELECT DISTINCT 'jpg', grp FROM manifest WHERE doc_id % 3 = 1")
def u5(spark, sf):
    m = V.manifest(spark, sf)
    parts = [_listed(spark, sf, m.filter(F.col("doc_id") % 3 == k), kind).select(F.lit(kind).alias("kind"), "grp") for k, kind in enumerate(("png", "jpg"))]
    return parts[0].unionByName(parts[1])


def _evaluation(spark, sf) -> str:
    path = scratch(spark, "evaluation")
    e = QI.evaluated(spark, sf)
    K.write_evaluation(e, QI.summary(e, ("psnr", "mae", "mse")), path)
    return path


@query("k4_evaluation_output", "SELECT image_id, round(mse, 6) AS mse, round(mae, 6) AS mae FROM (" + QI._EVAL + ")")
def k4(spark, sf):
    return spark.read.parquet(f"{_evaluation(spark, sf)}/results").select("image_id", F.round("mse", 6).alias("mse"), F.round("mae", 6).alias("mae"))


@query("s14_results_readback", QI.SQL["a9_metric_summary"])
def s14(spark, sf):
    return QI._rounded(RD.read_results(spark, _evaluation(spark, sf)))


@query("k1_run_partition", "SELECT doc_id, label, 'run_1' AS run_id FROM manifest")
def k1(spark, sf):
    path = scratch(spark, "runs")
    K.write_run(V.manifest(spark, sf).select("doc_id", "label"), path, "run_1")
    return spark.read.parquet(path).select("doc_id", "label", F.col("run_id").cast("string").alias("run_id"))


@query("k2_named_batch", "SELECT 'img_' || lpad(item_id::VARCHAR, greatest(4, length(item_id::VARCHAR))::INT, '0') || '.png' AS name, text AS caption FROM benchmark")
def k2(spark, sf):
    path = scratch(spark, "batch")
    K.write_batch(V.table(spark, sf, "benchmark").select(F.col("item_id").alias("idx"), F.col("text").alias("caption")), path, "img")
    return spark.read.schema("name string, caption string").json(f"{path}/items")


@query("k5_worker_shards", QP.SQL["e5_generation_grid"])
def k5(spark, sf):
    path = scratch(spark, "shards")
    K.write_shards(QP.grid(spark, sf).select("worker", "name", "seed"), path)
    return spark.read.schema("name string, seed int, worker int").json(path).groupBy("worker").agg(F.count(F.lit(1)).alias("jobs"), F.countDistinct("name").alias("names"))


@query("k6_materialise_once", "SELECT doc_id, grp, label FROM manifest")
def k6(spark, sf):
    path = K.cache_path(scratch(spark, "cache"), "configs/train.yaml")
    first = V.manifest(spark, sf).select("doc_id", "grp", "label")
    K.materialise_once(first, path)
    return K.materialise_once(first.limit(0), path)


@query("k7_append_log", "SELECT step, loss FROM run_log")
def k7(spark, sf):
    path = scratch(spark, "log")
    log = V.run_log(spark, sf).select("step", "loss")
    for k in range(2):
        K.append_log(log.filter(F.col("step") % 2 == k), path)
    return spark.read.parquet(path)


@query("k8_comparison", QP.SQL["j11_compare_runs"])
def k8(spark, sf):
    path = scratch(spark, "comparison")
    K.write_comparison(QP.j11(spark, sf), path)
    return spark.read.schema("baseline double, augmented double, points double").json(path)


@query("x1_item_processor", "SELECT doc_id, CASE WHEN doc_id % 10 <> 0 THEN length(grp)::BIGINT END AS n, doc_id % 10 = 0 AS failed FROM manifest")
def x1(spark, sf):
    def process(row: dict) -> dict:
        if row["doc_id"] % 10 == 0:
            raise ValueError("unreadable")
        return {"n": len(row["grp"])}

    return EX.process_items(V.manifest(spark, sf).select("doc_id", "grp"), "doc_id", process, "n bigint").select("doc_id", "n", F.col("error").isNotNull().alias("failed"))


@query("x2_transform_hook", "SELECT doc_id, upper(grp) AS grp FROM manifest")
def x2(spark, sf):
    hook = lambda d: d.withColumn("grp", F.upper("grp"))
    return V.manifest(spark, sf).select("doc_id", "grp").transform(hook)


@query("x3_custom_extractor", "SELECT image_id, sum(v)::BIGINT AS n FROM (SELECT image_id, unnest(list_transform(range(1, 65), lambda i: (px[3*i-1] > 127)::INT)) AS v FROM rgb_images) GROUP BY image_id")
def x3(spark, sf):
    def green(px: pd.Series) -> pd.Series:
        return px.map(lambda p: (p[1::3] > 127).astype("int32"))

    found = EX.lesion_extractor(green)(F.col("px"), 0.5)
    return V.rgb_images(spark, sf).select("image_id", F.aggregate(found, F.lit(0).cast("bigint"), lambda a, x: a + x).alias("n"))


@query("x4_metric_registry", "SELECT image_id, round(max(abs(x - y)), 6) AS worst, round(avg(abs(x - y)), 6) AS mae FROM pair_px GROUP BY image_id")
def x4(spark, sf):
    registry = M.REGISTRY | {"worst": lambda a, b: F.array_max(F.zip_with(a, b, lambda x, y: F.abs(x - y).cast("double")))}
    return QI.pairs(spark, sf).select("image_id", *[F.round(registry[m](F.col("px_a"), F.col("px_b")), 6).alias(m) for m in ("worst", "mae")])


@query("x5_collate", "SELECT doc_id // 8 AS batch, count(*) AS n, sum(label)::BIGINT AS labels FROM manifest GROUP BY 1")
def x5(spark, sf):
    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"batch": [pdf["batch"].iloc[0]], "n": [len(pdf)], "labels": [int(pdf["label"].sum())]})

    rows = V.manifest(spark, sf).select(F.floor(F.col("doc_id") / 8).alias("batch"), "label")
    return EX.collate(rows, "batch", one, "batch bigint, n bigint, labels bigint")
