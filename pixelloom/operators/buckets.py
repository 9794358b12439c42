"""Crop buckets and crop geometry."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def crop_buckets(spark: SparkSession, patches: int, patch_size: int, max_ratio: float = 4.0) -> DataFrame:
    """Width and height (in pixels) on the staircase of patch grids that just hold ``patches`` patches, up to an aspect of ``max_ratio``.
    The table has fewer than ``2 * patches`` rows."""
    w = spark.range(1, patches + 1).select(F.col("id").cast("int").alias("w"))
    h = F.sequence(F.greatest(F.lit(1), F.floor(patches / (F.col("w") + 1)).cast("int")), F.floor(patches / F.col("w")).cast("int"))
    rows = w.withColumn("h", F.explode(h)).filter(F.greatest("w", "h") / F.least("w", "h") <= max_ratio)
    return rows.select((F.col("w") * patch_size).alias("w"), (F.col("h") * patch_size).alias("h"))


def score(iw: Column, ih: Column, w: Column, h: Column) -> Column:
    """How much of an image a crop of the shape keeps: the smaller over the larger of the two scale factors."""
    return F.least(w / iw, h / ih) / F.greatest(w / iw, h / ih)


def best_buckets(images: DataFrame, buckets: DataFrame, k: int = 1) -> DataFrame:
    """``images``: image_id, width, height. The k best buckets of each, by score, then size. The small table is gathered into one array, so
    an image is scored in its own row: no join, no shuffle."""
    table = buckets.agg(F.collect_list(F.struct("w", "h")).alias("b"))
    scored = F.transform("b", lambda b: F.struct(score(F.col("width"), F.col("height"), b["w"], b["h"]).alias("score"), b["w"].alias("w"), b["h"].alias("h")))
    top = F.slice(F.sort_array(scored, asc=False), 1, k)
    return images.join(F.broadcast(table)).select("image_id", F.posexplode(top).alias("rank", "t")).select("image_id", (F.col("rank") + 1).alias("rank"), "t.w", "t.h", "t.score")


def pick_one(candidates: DataFrame, h: Column) -> DataFrame:
    """One of the candidates of each image, by hash."""
    n = F.count(F.lit(1)).over(Window.partitionBy("image_id"))
    return candidates.withColumn("_n", n).filter(F.col("rank") - 1 == F.pmod(h, F.col("_n"))).drop("_n")


def center_geometry(width: Column, height: Column, size: int) -> dict[str, Column]:
    """Halve while the short side is at least twice ``size``, scale the short side to it (half to even), centre."""
    short = F.least(width, height)
    # Repeated halving with floors equals one shift by the count.
    n = F.aggregate(F.sequence(F.lit(0), F.lit(20)), F.struct(short.cast("int").alias("s"), F.lit(0).alias("n")), lambda a, _: F.when(a["s"] >= 2 * size, F.struct(F.floor(a["s"] / 2).cast("int").alias("s"), (a["n"] + 1).alias("n"))).otherwise(a))["n"]
    w, h = F.call_function("shiftright", width, n), F.call_function("shiftright", height, n)
    scale = size / F.least(w, h)
    sw, sh = F.bround(w * scale).cast("int"), F.bround(h * scale).cast("int")
    return {"halvings": n, "scaled_w": sw, "scaled_h": sh, "left": F.floor((sw - size) / 2).cast("int"), "top": F.floor((sh - size) / 2).cast("int")}


def cover_geometry(width: Column, height: Column, crop_w: int, crop_h: int, h: Column) -> dict[str, Column]:
    """Halve while both sides are at least twice the crop, scale to cover it, and place it by hash."""
    n = F.aggregate(F.sequence(F.lit(0), F.lit(20)), F.struct(width.cast("int").alias("w"), height.cast("int").alias("h"), F.lit(0).alias("n")),
                    lambda a, _: F.when((a["w"] >= 2 * crop_w) & (a["h"] >= 2 * crop_h), F.struct(F.floor(a["w"] / 2).cast("int").alias("w"), F.floor(a["h"] / 2).cast("int").alias("h"), (a["n"] + 1).alias("n"))).otherwise(a))["n"]
    w, hh = F.call_function("shiftright", width, n), F.call_function("shiftright", height, n)
    scale = F.greatest(crop_w / w, crop_h / hh)
    sw, sh = F.bround(w * scale).cast("int"), F.bround(hh * scale).cast("int")
    return {"halvings": n, "scaled_w": sw, "scaled_h": sh, "left": F.pmod(h, sw - crop_w + 1).cast("int"), "top": F.pmod(F.floor(h / 65536), sh - crop_h + 1).cast("int")}
