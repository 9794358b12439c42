"""Views over the given tables with the shapes of an image corpus: images, masks, manifest, predictions, run log.

``SQL`` holds the same views for DuckDB; ``with_views`` puts those that a query names in front of it.
"""
from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.image import nearest_resize


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def gray_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = F.transform("embedding", lambda e: F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (e.cast("double") + 1.0) / 2.0)) * 255.0).cast("int"))
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image_id"), F.lit(8).alias("height"), F.lit(8).alias("width"), F.lit(1).alias("channels"), px.alias("px"))


def rgb_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three gray images as the channels of one: ids 3k, 3k + 1, 3k + 2, gathered with one aggregation. Channels that the last ids do not fill are zero."""
    g = gray_images(spark, sf_dir)
    plane = lambda c: F.max(F.when(F.col("image_id") % 3 == c, F.col("px")))
    k = g.groupBy(F.floor(F.col("image_id") / 3).cast("long").alias("image_id")).agg(plane(0).alias("r"), plane(1).alias("g"), plane(2).alias("b"))
    px = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.array(*[F.coalesce(F.get(c, i), F.lit(0)) for c in "rgb"])))
    return k.select("image_id", F.lit(8).alias("height"), F.lit(8).alias("width"), F.lit(3).alias("channels"), px.alias("px"))


def masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = F.transform("px", lambda p: F.when(p > 127, 255).otherwise(0))
    return gray_images(spark, sf_dir).filter(F.col("image_id") % 2 == 0).select("image_id", "height", "width", px.alias("px"))


def generated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gray images as a generator would leave them: every tenth has half the size."""
    return _some_halved(gray_images(spark, sf_dir), 10, "channels")


def sized_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The masks, some of another size than their images."""
    return _some_halved(masks(spark, sf_dir), 6)


def _some_halved(images: DataFrame, every: int, *more: str) -> DataFrame:
    small = F.col("image_id") % every == 0
    size = F.when(small, 4).otherwise(8)
    out = images.withColumn("px", F.when(small, nearest_resize(F.col("px"), F.col("height"), F.col("width"), 4, 4)).otherwise(F.col("px")))
    return out.select("image_id", size.alias("height"), size.alias("width"), *more, "px")


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, lab = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").select(F.col("doc_id").alias("lid")).distinct()
    mask = F.when(F.col("lid").isNotNull(), F.concat(F.lit("masks/"), F.col("doc_id"), F.lit(".png")))
    return d.join(lab, F.col("doc_id") == F.col("lid"), "left").select("doc_id", F.concat("source", F.lit("/"), "doc_id", F.lit(".png")).alias("image_path"), F.col("text").alias("caption"),
                                                                        mask.alias("mask_path"), (F.col("doc_id") % 5).cast("int").alias("label"), F.col("source").alias("grp"))


def manifest_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, k = table(spark, sf_dir, "events"), F.col("event_id") % 10
    head = F.concat(F.lit('{"image_path": "img/'), F.col("event_id"), F.lit('.png", "caption": '))
    quoted = F.concat(F.lit('"'), F.col("event_type"), F.lit('"'))
    line = (F.when(k == 0, "").when(k == 1, F.concat("props", F.lit("x"))).when(k == 2, F.col("props")).when(k == 3, F.concat(head, F.lit("null}")))
            .when(k < 7, F.concat(head, quoted, F.lit(', "mask_path": "m/'), F.col("event_id"), F.lit('.png"}'))).otherwise(F.concat(head, quoted, F.lit("}"))))
    return e.select(F.col("event_id").alias("line_no"), line.alias("line"))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).cast("int").alias("pred"))


def run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    epoch = (F.floor(F.col("event_id") / 50) + 1).cast("int")
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("step"), epoch.alias("epoch"), F.col("value").alias("loss"), (0.001 / epoch).alias("lr"), "ts")


def image_dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_chars")
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("image_id"), (256 + n % 2048).cast("int").alias("width"), (256 + (n * 7) % 1536).cast("int").alias("height"))


#: Every second pixel of an 8 x 8 array, as nearest neighbours at half size take them.
_HALF = "list_transform(range(0, 16), lambda k: px[(2 * (k // 4) + 1) * 8 + 2 * (k % 4) + 2])"

SQL = {
    "gray_images": "SELECT vec_id AS image_id, 8 AS height, 8 AS width, 1 AS channels, list_transform(embedding, lambda e: floor(greatest(0.0::DOUBLE, least(1.0::DOUBLE, (e::DOUBLE + 1.0) / 2.0)) * 255.0)::INT) AS px FROM embeddings",
    "rgb_images": "SELECT a.image_id // 3 AS image_id, 8 AS height, 8 AS width, 3 AS channels, flatten(list_transform(range(1, 65), lambda i: [a.px[i], coalesce(b.px[i], 0), coalesce(c.px[i], 0)])) AS px FROM gray_images a LEFT JOIN gray_images b ON b.image_id = a.image_id + 1 LEFT JOIN gray_images c ON c.image_id = a.image_id + 2 WHERE a.image_id % 3 = 0",
    "masks": "SELECT image_id, height, width, list_transform(px, lambda p: CASE WHEN p > 127 THEN 255 ELSE 0 END) AS px FROM gray_images WHERE image_id % 2 = 0",
    "generated": f"SELECT image_id, CASE WHEN image_id % 10 = 0 THEN 4 ELSE 8 END AS side, CASE WHEN image_id % 10 = 0 THEN {_HALF} ELSE px END AS px FROM gray_images",
    "sized_masks": f"SELECT image_id, CASE WHEN image_id % 6 = 0 THEN 4 ELSE 8 END AS side, CASE WHEN image_id % 6 = 0 THEN {_HALF} ELSE px END AS px FROM masks",
    "manifest": "SELECT d.doc_id, source || '/' || d.doc_id || '.png' AS image_path, text AS caption, CASE WHEN l.doc_id IS NOT NULL THEN 'masks/' || d.doc_id || '.png' END AS mask_path, (d.doc_id % 5)::INT AS label, source AS grp FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON l.doc_id = d.doc_id",
    "manifest_lines": """SELECT event_id AS line_no, CASE WHEN event_id % 10 = 0 THEN '' WHEN event_id % 10 = 1 THEN props || 'x' WHEN event_id % 10 = 2 THEN props
      WHEN event_id % 10 = 3 THEN '{"image_path": "img/' || event_id || '.png", "caption": null}'
      WHEN event_id % 10 < 7 THEN '{"image_path": "img/' || event_id || '.png", "caption": "' || event_type || '", "mask_path": "m/' || event_id || '.png"}'
      ELSE '{"image_path": "img/' || event_id || '.png", "caption": "' || event_type || '"}' END AS line FROM events""",
    "predictions": "SELECT vec_id, label, (CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END)::INT AS pred FROM embeddings",
    "run_log": "SELECT event_id AS step, (event_id // 50 + 1)::INT AS epoch, value AS loss, 0.001::DOUBLE / (event_id // 50 + 1) AS lr, ts FROM events",
    "image_dims": "SELECT doc_id AS image_id, (256 + n_chars % 2048)::INT AS width, (256 + (n_chars * 7) % 1536)::INT AS height FROM documents",
    "pairs": "SELECT a.image_id, a.px AS px_a, b.px AS px_b FROM gray_images a JOIN gray_images b ON b.image_id = a.image_id + 1",
    "pair_px": "SELECT image_id, unnest(px_a)::DOUBLE AS x, unnest(px_b)::DOUBLE AS y FROM pairs",
}


def with_views(body: str) -> str:
    """``body`` with the views that it names, directly or through others, as common table expressions."""
    used: list[str] = []

    def need(text: str) -> None:
        for name in SQL:
            if re.search(rf"\b{name}\b", text) and name not in used:
                need(SQL[name])
                if name not in used:
                    used.append(name)

    need(body)
    head = ", ".join(f"{n} AS ({SQL[n]})" for n in used)
    body = body.strip()
    if not head:
        return body
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {head}, {body[15:]}"
    return f"WITH {head}, {body[5:]}" if body.upper().startswith("WITH ") else f"WITH {head} {body}"
