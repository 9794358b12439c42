"""Queries over images, masks and pairs."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import image as I
from ..functions import metrics as M
from ..functions import text as X
from ..operators import kernels as K
from ..operators import pair_metrics as PM
from ..sources import files as FL
from ..sources import readers as RD
from ..sources.scratch import scratch
from . import views as V

QUERIES: dict = {}
SQL: dict = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = V.with_views(sql)
        return fn

    return add


def text(px: Column) -> Column:
    """An integer array as text, comparable between engines."""
    return F.array_join(px.cast("array<string>"), ",")


def micro(x: Column) -> Column:
    """Doubles in millionths, as text."""
    return text(F.transform(x, lambda v: F.round(v * 1e6).cast("long")))


def r6(c: Column) -> Column:
    return F.round(c, 6)


T, U = "array_to_string({}, ',')", "array_to_string(list_transform({}, lambda v: round(v * 1e6)::BIGINT), ',')"
_PX3 = "list_transform(range(1, 65), lambda i: {})"


def pairs(spark, sf) -> DataFrame:
    """Generated images joined to their references by key; only keys and pixels travel."""
    a = V.gray_images(spark, sf).select("image_id", "height", "width", "channels", F.col("px").alias("px_a"))
    b = V.gray_images(spark, sf).select((F.col("image_id") - 1).alias("image_id"), F.col("px").alias("px_b"))
    return a.join(b, "image_id")


def packed_pairs(spark, sf) -> DataFrame:
    """``pairs`` with packed pixels."""
    a = K.pack(V.gray_images(spark, sf)).withColumnRenamed("px", "px_a")
    b = K.pack(V.gray_images(spark, sf).select((F.col("image_id") - 1).alias("image_id"), "px")).withColumnRenamed("px", "px_b")
    return a.join(b.hint("merge"), "image_id")


# --- image files

#: Written names: of every ten files one is cut in half, one holds no image, and one is empty.
_STATE = "CASE image_id % 10 WHEN 3 THEN 'cut' WHEN 5 THEN 'noise' WHEN 8 THEN 'empty' ELSE 'whole' END"


def image_folder(spark, sf, images: DataFrame) -> str:
    """The images as files in a new folder, some of them broken."""
    path, k = scratch(spark, "images"), F.regexp_extract("name", r"(\d+)", 1).cast("long") % 10
    data = F.when(k == 3, F.substring("data", F.lit(1), (F.length("data") / 2).cast("int"))).when(k == 5, F.encode("name", "utf-8")).when(k != 8, F.col("data"))
    FL.write_files(FL.to_png(images.withColumn("name", F.format_string("%06d.png", "image_id"))).select("name", data.alias("data")), path)
    return path


def _id() -> Column:
    return F.regexp_extract("path", r"(\d+)\.png$", 1).cast("long").alias("image_id")


@query("s7_image_scan", f"SELECT image_id, height, width, channels, {T.format('px')} AS px FROM rgb_images WHERE {_STATE} = 'whole'")
def s7(spark, sf):
    files = RD.read_images(spark, image_folder(spark, sf, V.rgb_images(spark, sf)))
    return files.select(_id(), "height", "width", "channels", text(F.col("px")).alias("px"))


@query("s7_broken_files", f"SELECT {_STATE} AS state, count(*) AS n FROM rgb_images WHERE {_STATE} <> 'whole' GROUP BY 1")
def s7_broken(spark, sf):
    path = image_folder(spark, sf, V.rgb_images(spark, sf))
    lost = RD.broken_images(FL.walk_files(spark, path), RD.scan_images(spark, path))
    state = F.when(F.col("length") == 0, "empty").when(F.col("length") == 10, "noise").otherwise("cut")
    return lost.groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("n"))


_LUMA = "(px[3 * i + 1] * 19595 + px[3 * i + 2] * 38470 + px[3 * i + 3] * 7471 + 32768) >> 16"


@query("s8_mask_scan", f"SELECT image_id, height, width, {T.format(f'list_transform(range(0, 64), lambda i: {_LUMA})')} AS px FROM rgb_images WHERE image_id % 2 = 1 AND {_STATE} = 'whole' UNION ALL SELECT image_id, height, width, {T.format('px')} FROM masks WHERE {_STATE} = 'whole'")
def s8(spark, sf):
    """Mask files of one channel, and of three, which are turned to luma."""
    gray = V.masks(spark, sf).withColumn("channels", F.lit(1))
    both = gray.unionByName(V.rgb_images(spark, sf).filter(F.col("image_id") % 2 == 1))
    files = RD.read_masks(spark, image_folder(spark, sf, both))
    return files.select(_id(), "height", "width", text(F.col("px")).alias("px"))


# --- array functions of images

@query("i2_nearest_resize", "SELECT image_id, " + T.format("list_transform(range(0, 16), lambda i: px[1 + floor((i // 4 + 0.5) * 2)::INT * 8 + floor((i % 4 + 0.5) * 2)::INT])") + " AS px FROM masks")
def i2(spark, sf):
    return V.masks(spark, sf).select("image_id", text(I.nearest_resize(F.col("px"), F.col("height"), F.col("width"), 4, 4)).alias("px"))


@query("i3a_gray_to_rgb", "SELECT image_id, " + T.format("flatten(list_transform(px, lambda p: [p, p, p]))") + " AS px FROM gray_images")
def i3a(spark, sf):
    return V.gray_images(spark, sf).select("image_id", text(I.gray_to_rgb(F.col("px"))).alias("px"))


@query("i3b_rgb_to_gray", "SELECT image_id, " + T.format(_PX3.format("(px[3*i-2] * 19595 + px[3*i-1] * 38470 + px[3*i] * 7471 + 32768) >> 16")) + " AS luma, " + U.format(_PX3.format("(px[3*i-2] + px[3*i-1] + px[3*i]) / 3.0::DOUBLE")) + " AS mean FROM rgb_images")
def i3b(spark, sf):
    return V.rgb_images(spark, sf).select("image_id", text(I.rgb_to_luma(F.col("px"))).alias("luma"), micro(I.channel_mean(F.col("px"))).alias("mean"))


@query("i4_scale_unit", "SELECT image_id, " + U.format("list_transform(px, lambda p: p / 255.0::DOUBLE)") + " AS unit, " + U.format("list_transform(px, lambda p: p / 255.0::DOUBLE * 2 - 1)") + " AS symmetric FROM gray_images")
def i4(spark, sf):
    px = F.col("px")
    return V.gray_images(spark, sf).select("image_id", micro(I.scale_unit(px)).alias("unit"), micro(I.scale_unit(px, True)).alias("symmetric"))


@query("i5_standardise", "SELECT image_id, " + U.format("list_transform(range(1, 193), lambda i: (px[i] / 255.0::DOUBLE - [0.485::DOUBLE, 0.456, 0.406][1 + (i - 1) % 3]) / [0.229::DOUBLE, 0.224, 0.225][1 + (i - 1) % 3])") + " AS px FROM rgb_images")
def i5(spark, sf):
    return V.rgb_images(spark, sf).select("image_id", micro(I.standardise(F.col("px"))).alias("px"))


@query("i10_channel_max", "SELECT image_id, " + T.format(_PX3.format("greatest(px[3*i-2], px[3*i-1], px[3*i])")) + " AS px FROM rgb_images")
def i10(spark, sf):
    return V.rgb_images(spark, sf).select("image_id", text(I.channel_max(F.col("px"), 3)).alias("px"))


def _lesion(cond: str) -> str:
    return "SELECT image_id, " + T.format(_PX3.format(f"CASE WHEN {cond} THEN 1 ELSE 0 END")) + " AS px FROM (SELECT image_id, CASE WHEN list_max(px) > 1 THEN list_transform(px, lambda p: p / 255.0::DOUBLE) ELSE list_transform(px, lambda p: p::DOUBLE) END AS px FROM rgb_images)"


@query("i11_lesion_red", _lesion("px[3*i-2] > 0.5"))
def i11(spark, sf):
    return V.rgb_images(spark, sf).select("image_id", text(I.lesion_mask(F.col("px"), "red_channel", 0.5)).alias("px"))


@query("i12_lesion_saturation", _lesion("CASE WHEN greatest(px[3*i-2], px[3*i-1], px[3*i]) = least(px[3*i-2], px[3*i-1], px[3*i]) THEN 0.0 ELSE (greatest(px[3*i-2], px[3*i-1], px[3*i]) - least(px[3*i-2], px[3*i-1], px[3*i])) / greatest(px[3*i-2], px[3*i-1], px[3*i]) END > 0.3"))
def i12(spark, sf):
    return V.rgb_images(spark, sf).select("image_id", text(I.lesion_mask(F.col("px"), "saturation", 0.3)).alias("px"))


@query("i13_lesion_brightness", _lesion("(px[3*i-2] + px[3*i-1] + px[3*i]) / 3.0 < 1.0 - 0.5"))
def i13(spark, sf):
    return V.rgb_images(spark, sf).select("image_id", text(I.lesion_mask(F.col("px"), "brightness", 0.5)).alias("px"))


@query("i15_mask_scale_binarize", "SELECT image_id, " + U.format("list_transform(px, lambda p: p / 255.0::DOUBLE)") + " AS scaled, " + U.format("list_transform(px, lambda p: CASE WHEN p / 255.0 > 0.5 THEN 1.0 ELSE 0.0 END)") + " AS cut FROM gray_images")
def i15(spark, sf):
    s = I.normalize_mask(F.col("px"))
    return V.gray_images(spark, sf).select("image_id", micro(s).alias("scaled"), micro(I.binarize_mask(s)).alias("cut"))


@query("i16_bilinear_mask", """SELECT image_id, array_to_string(list(round(((v00 * (1 - fx) + v01 * fx) * (1 - fy) + (v10 * (1 - fx) + v11 * fx) * fy) * 1e6)::BIGINT ORDER BY i), ',') AS px FROM (
  SELECT image_id, i, fy, fx, px[1 + y0 * 8 + x0]::DOUBLE AS v00, px[1 + y0 * 8 + x1]::DOUBLE AS v01, px[1 + y1 * 8 + x0]::DOUBLE AS v10, px[1 + y1 * 8 + x1]::DOUBLE AS v11 FROM (
    SELECT *, least(y0 + 1, 7) AS y1, least(x0 + 1, 7) AS x1, ay - y0 AS fy, ax - x0 AS fx FROM (
      SELECT *, floor(ay)::INT AS y0, floor(ax)::INT AS x0 FROM (
        SELECT image_id, px, i, greatest((i // 5 + 0.5::DOUBLE) * 8 / 5 - 0.5, 0) AS ay, greatest((i % 5 + 0.5::DOUBLE) * 8 / 5 - 0.5, 0) AS ax FROM masks, range(0, 25) t(i))))) GROUP BY image_id""")
def i16(spark, sf):
    return V.masks(spark, sf).select("image_id", micro(I.bilinear_resize(F.col("px"), F.col("height"), F.col("width"), 5, 5)).alias("px"))


@query("i17_zero_mask", "SELECT g.image_id, " + U.format("coalesce(list_transform(m.px, lambda p: p::DOUBLE), list_transform(range(0, 64), lambda i: 0.0::DOUBLE))") + " AS px FROM gray_images g LEFT JOIN masks m USING (image_id)")
def i17(spark, sf):
    m = V.masks(spark, sf).select("image_id", "px")
    return V.gray_images(spark, sf).select("image_id", "height", "width").join(m, "image_id", "left").select("image_id", micro(I.zero_mask(F.col("px"), F.col("height"), F.col("width"))).alias("px"))


@query("i18_to_bytes", "SELECT image_id, " + T.format("px") + " AS px FROM gray_images")
def i18(spark, sf):
    return V.table(spark, sf, "embeddings").select(F.col("vec_id").alias("image_id"), text(I.to_bytes(F.col("embedding"))).alias("px"))


@query("i19_append_mask", "SELECT r.image_id, " + T.format("flatten(list_transform(range(1, 65), lambda i: [r.px[3*i-2], r.px[3*i-1], r.px[3*i], m.px[i]]))") + " AS px FROM rgb_images r JOIN masks m ON m.image_id = 2 * r.image_id")
def i19(spark, sf):
    m = V.masks(spark, sf).select((F.col("image_id") / 2).cast("long").alias("image_id"), F.col("px").alias("m"))
    return V.rgb_images(spark, sf).join(m, "image_id").select("image_id", text(I.append_mask(F.col("px"), F.col("m"), 3)).alias("px"))


@query("i20_patches", "SELECT image_id, k, array_to_string(list_transform(range(0, 16), lambda j: px[1 + (k // 2 * 4 + j // 4) * 8 + k % 2 * 4 + j % 4]), ',') AS patch, CASE WHEN k < 4 THEN 1 ELSE 0 END AS valid FROM (SELECT image_id, px, unnest(range(0, 4))::INT AS k FROM gray_images)")
def i20(spark, sf):
    p = V.gray_images(spark, sf).withColumn("p", I.patches(F.col("px"), 8, 8, 1, 4))
    seq, flags = I.pad_patches(F.col("p"), F.lit(4))
    return p.select("image_id", F.posexplode(F.arrays_zip(seq.alias("patch"), flags.alias("valid"))).alias("k", "z")).select("image_id", "k", text(F.col("z.patch")).alias("patch"), F.col("z.valid").alias("valid"))


@query("i21_unpatch", "SELECT image_id, " + T.format("px") + " AS px FROM gray_images")
def i21(spark, sf):
    p = V.gray_images(spark, sf).withColumn("p", I.patches(F.col("px"), 8, 8, 1, 4))
    padded, _ = I.pad_patches(F.col("p"), F.lit(6))
    return p.withColumn("q", padded).select("image_id", text(I.unpatch(F.col("q"), 8, 8, 1, 4)).alias("px"))


@query("i24_crop", "SELECT image_id, " + T.format("list_transform(range(0, 12), lambda j: px[1 + (2 + j // 4) * 8 + 3 + j % 4])") + " AS px FROM gray_images")
def i24(spark, sf):
    return V.gray_images(spark, sf).select("image_id", text(I.crop(F.col("px"), F.col("width"), 1, F.lit(2), F.lit(3), F.lit(3), F.lit(4))).alias("px"))


@query("i26_random_flip", "SELECT image_id, " + T.format("CASE WHEN (image_id * 1103515245 + 7 * 12345) % 2147483648 < 1073741824 THEN list_transform(range(0, 192), lambda j: px[1 + (j // 24) * 24 + (7 - j % 24 // 3) * 3 + j % 3]) ELSE px END") + " AS px FROM rgb_images")
def i26(spark, sf):
    coin = (F.col("image_id") * 1103515245 + 7 * 12345) % 2147483648 < 1073741824
    return V.rgb_images(spark, sf).select("image_id", text(F.when(coin, I.flip_rows(F.col("px"), F.col("height"), F.col("width"), 3)).otherwise(F.col("px"))).alias("px"))


@query("i7_median_filter", """SELECT image_id, y::INT AS y, x::INT AS x, median(px[1 + greatest(0, least(7, y + dy)) * 8 + greatest(0, least(7, x + dx))])::INT AS v
FROM gray_images, range(0, 8) a(y), range(0, 8) b(x), range(-1, 2) c(dy), range(-1, 2) d(dx) GROUP BY image_id, y, x""")
def i7(spark, sf):
    return K.median_exploded(V.gray_images(spark, sf), 3)


# Images as rows (image_id, y, x, ch, v) in SQL, and separable filters over them.
_KERNELS = {"lanczos": "CASE WHEN x = 0 THEN 1.0 WHEN abs(x) <= 3 THEN sin(pi() * x) / (pi() * x) * sin(pi() * x / 3) / (pi() * x / 3) ELSE 0 END",
            "bicubic": "CASE WHEN abs(x) < 1 THEN 1.5 * abs(x) ^ 3 - 2.5 * x * x + 1 WHEN abs(x) <= 2 THEN -0.5 * abs(x) ^ 3 + 2.5 * x * x - 4 * abs(x) + 2 ELSE 0 END", "box": "(x > -0.5 AND x <= 0.5)::INT"}


def rows_sql(rel: str, side: int, channels: int) -> str:
    return f"SELECT image_id, i // {side * channels} AS y, i // {channels} % {side} AS x, i % {channels} AS ch, px[i + 1]::DOUBLE AS v FROM {rel}, range(0, {side * side * channels}) t(i)"


def _axis_sql(rows: str, axis: str, size: int, out: int, kernel: str) -> str:
    other = "y" if axis == "x" else "x"
    weights = f"SELECT o, i, trunc(k / s * 4194304 + 0.5 * sign(k)) / 4194304.0::DOUBLE AS w FROM (SELECT *, sum(k) OVER (PARTITION BY o) AS s FROM (SELECT o, i, {_KERNELS[kernel]} AS k FROM (SELECT o, i, (i + 0.5::DOUBLE - (o + 0.5) * {size} / {out}) / {max(size / out, 1.0)}::DOUBLE AS x FROM range(0, {out}) a(o), range(0, {size}) b(i))))"
    return f"SELECT image_id, {other}, o AS {axis}, ch, greatest(0, least(255, floor(sum(v * w) + 0.5))) AS v FROM ({rows}) r JOIN ({weights}) w ON r.{axis} = w.i GROUP BY image_id, {other}, o, ch"


def resample_sql(rows: str, size: int, out: int, kernel: str = "lanczos") -> str:
    return _axis_sql(_axis_sql(rows, "x", size, out, kernel), "y", size, out, kernel)


def gauss_sql(rows: str, size: int) -> str:
    """A 5 x 5 blur of deviation 1, mirrored at the borders."""
    at = lambda c: f"(CASE WHEN {c} + d < 0 THEN -({c} + d) WHEN {c} + d > {size - 1} THEN {2 * (size - 1)} - ({c} + d) ELSE {c} + d END)"
    w = "(SELECT d, exp(-d * d / 2.0::DOUBLE) / sum(exp(-d * d / 2.0::DOUBLE)) OVER () AS w FROM range(-2, 3) t(d))"
    grid = f"SELECT a.c AS c, {at('a.c')} AS s, w FROM range(0, {size}) a(c), {w}"
    return f"SELECT r.image_id, p.c AS y, q.c AS x, r.ch, greatest(0, least(255, floor(sum(v * p.w * q.w) + 0.5))) AS v FROM ({rows}) r JOIN ({grid}) p ON r.y = p.s JOIN ({grid}) q ON r.x = q.s GROUP BY r.image_id, p.c, q.c, r.ch"


def median_sql(rows: str, size: int, r: int) -> str:
    clamp = lambda c: f"greatest(0, least({size - 1}, {c} + d))"
    grid = f"SELECT c, {clamp('c')} AS s FROM range(0, {size}) a(c), range({-r}, {r + 1}) b(d)"
    return f"SELECT r.image_id, p.c AS y, q.c AS x, r.ch, median(v) AS v FROM ({rows}) r JOIN ({grid}) p ON r.y = p.s JOIN ({grid}) q ON r.x = q.s GROUP BY r.image_id, p.c, q.c, r.ch"


def gathered_sql(rows: str, value: str = "v::INT") -> str:
    return f"SELECT image_id, array_to_string(list({value} ORDER BY y, x, ch), ',') AS px FROM ({rows}) GROUP BY image_id"


def shown(images: DataFrame) -> DataFrame:
    return images.select("image_id", text(F.col("px").cast("array<int>")).alias("px"))


_MICRO = "round(({0}) * 1e6)::BIGINT"
_GRAY, _RGB = rows_sql("gray_images", 8, 1), rows_sql("rgb_images", 8, 3)
_PREPARED = "v / 255.0::DOUBLE * 2 - 1"


@query("i1_lanczos_resize", gathered_sql(resample_sql(_GRAY, 8, 4)))
def i1(spark, sf):
    return shown(K.map_images(V.gray_images(spark, sf), lambda im, _: K.resample(im, 4, 4)))


@query("i6_gaussian_blur", gathered_sql(gauss_sql(_GRAY, 8)))
def i6(spark, sf):
    return shown(K.map_images(V.gray_images(spark, sf), lambda im, _: K.gaussian(im, 5, 1.0)))


@query("i8_denoise", " UNION ALL ".join(gathered_sql(f"SELECT * FROM ({rows}) WHERE image_id % 3 = {k}") for k, rows in enumerate((gauss_sql(_GRAY, 8), median_sql(_GRAY, 8, 2), _GRAY))))
def i8(spark, sf):
    plan = V.gray_images(spark, sf).withColumn("method", F.get(F.array(F.lit("gaussian"), F.lit("median"), F.lit("none")), (F.col("image_id") % 3).cast("int")))
    return shown(K.map_images(plan, lambda im, rows: K.denoise_each(im, rows["method"]), extra=("method",)))


@query("i9_prepare", gathered_sql(gauss_sql(resample_sql(_RGB, 8, 6), 6), _MICRO.format(_PREPARED)))
def i9(spark, sf):
    return K.map_images(V.rgb_images(spark, sf), lambda im, _: K.prepare(im, 6, "gaussian")).select("image_id", micro(F.col("px")).alias("px"))


@query("i22_center_crop_pixels", gathered_sql(resample_sql(resample_sql(_RGB, 8, 4, "box"), 4, 3, "bicubic")))
def i22p(spark, sf):
    return shown(K.map_images(V.rgb_images(spark, sf), lambda im, _: K.center_crop(im, 3)))


def rotated_sql(rel: str, degrees: str) -> str:
    """Nearest-neighbour rotation of 8 x 8 images of three channels around their centre."""
    turned = f"SELECT image_id, px, y, x, floor(sin(a) * (x - 3.5) + cos(a) * (y - 3.5) + 4)::INT AS sy, floor(cos(a) * (x - 3.5) - sin(a) * (y - 3.5) + 4)::INT AS sx FROM (SELECT *, radians({degrees}) AS a FROM {rel}), range(0, 8) a(y), range(0, 8) b(x)"
    return f"SELECT image_id, y, x, ch, CASE WHEN sy BETWEEN 0 AND 7 AND sx BETWEEN 0 AND 7 THEN px[sy * 24 + sx * 3 + ch + 1] ELSE 0 END::DOUBLE AS v FROM ({turned}), range(0, 3) c(ch)"


_ANGLE = "((image_id * 37 % 2001 - 1000) / 100.0::DOUBLE)"


@query("i27_rotate", gathered_sql(rotated_sql("rgb_images", _ANGLE)))
def i27(spark, sf):
    images = V.rgb_images(spark, sf).withColumn("angle", (F.col("image_id") * 37 % 2001 - 1000) / 100.0)
    return shown(K.map_images(images, lambda im, rows: K.rotate(im, rows["angle"]), extra=("angle",)))


def _factor(seed: int) -> Column:
    return 0.8 + 0.4 * X.unit(X.mix_hash(F.col("image_id"), seed))


_FACTOR = lambda seed: f"(0.8::DOUBLE + 0.4::DOUBLE * (((image_id * 1103515245 + {seed * 12345}) % 2147483648) / 2147483648.0::DOUBLE))"


def jittered_sql(rows: str) -> str:
    lit = f"SELECT *, least(255.0::DOUBLE, v * {_FACTOR(11)}) AS b FROM ({rows})"
    return f"SELECT image_id, y, x, ch, floor(greatest(0, least(255, m + (b - m) * {_FACTOR(12)}))) AS v FROM (SELECT *, avg(b) OVER (PARTITION BY image_id) AS m FROM ({lit}))"


@query("i28_jitter", gathered_sql(jittered_sql(_RGB)))
def i28(spark, sf):
    return shown(V.rgb_images(spark, sf).select("image_id", I.jitter(F.col("px"), _factor(11), _factor(12)).alias("px")))


_STANDARD = _MICRO.format("(v / 255.0::DOUBLE - [0.485, 0.456, 0.406][ch + 1]::DOUBLE) / [0.229, 0.224, 0.225][ch + 1]::DOUBLE")
_FLIPPED = f"(SELECT image_id, CASE WHEN {_FACTOR(13)} < 1.0 THEN list_transform(range(0, 192), lambda i: px[i // 24 * 24 + (7 - i // 3 % 8) * 3 + i % 3 + 1]) ELSE px END AS px FROM rgb_images)"


@query("i29_train_transform", f"SELECT image_id, 'train' AS split, px FROM ({gathered_sql(jittered_sql(rotated_sql(_FLIPPED, _ANGLE)), _STANDARD)}) UNION ALL SELECT image_id, 'validation', px FROM ({gathered_sql(_RGB, _STANDARD)})")
def i29(spark, sf):
    rgb = V.rgb_images(spark, sf)
    train = rgb.withColumns({"px": F.when(_factor(13) < 1.0, I.flip_rows(F.col("px"), F.col("height"), F.col("width"), 3)).otherwise(F.col("px")), "angle": (F.col("image_id") * 37 % 2001 - 1000) / 100.0})
    train = K.map_images(train, lambda im, rows: K.rotate(im, rows["angle"]), extra=("angle",)).withColumn("px", I.jitter(F.col("px"), _factor(11), _factor(12)))
    out = train.select("image_id", F.lit("train").alias("split"), micro(I.standardise(F.col("px"))).alias("px"))
    return out.unionByName(rgb.select("image_id", F.lit("validation").alias("split"), micro(I.standardise(F.col("px"))).alias("px")))


# --- metrics of pairs

@query("j1_pairs_inner", "SELECT image_id, " + T.format("px_a") + " AS generated, " + T.format("px_b") + " AS reference FROM pairs")
def j1(spark, sf):
    return pairs(spark, sf).select("image_id", text(F.col("px_a")).alias("generated"), text(F.col("px_b")).alias("reference"))


@query("j2_pairs_with_mask", "SELECT p.image_id, " + T.format("m.px") + " AS mask FROM pairs p LEFT JOIN masks m USING (image_id)")
def j2(spark, sf):
    return pairs(spark, sf).select("image_id").join(V.masks(spark, sf).select("image_id", "px"), "image_id", "left").select("image_id", text(F.col("px")).alias("mask"))


@query("j3_unmatched", "SELECT image_id FROM gray_images a WHERE NOT EXISTS (SELECT 1 FROM gray_images b WHERE b.image_id = a.image_id + 1)")
def j3(spark, sf):
    refs = V.gray_images(spark, sf).select((F.col("image_id") - 1).alias("image_id"))
    return V.gray_images(spark, sf).select("image_id").join(refs, "image_id", "left_anti")


@query("a3_mse_mae", "SELECT image_id, round(avg((x - y) * (x - y)), 6) AS mse, round(avg(abs(x - y)), 6) AS mae FROM pair_px GROUP BY image_id")
def a3(spark, sf):
    return PM.pair_scores(packed_pairs(spark, sf), ("mse", "mae")).select("image_id", r6(F.col("mse")).alias("mse"), r6(F.col("mae")).alias("mae"))


_PSNR = "CASE WHEN {0} = 0 THEN 'inf'::DOUBLE ELSE 20 * log10(255.0::DOUBLE / sqrt({0})) END"


@query("a4_psnr", f"SELECT image_id, round({_PSNR.format('m')}, 6) AS psnr FROM (SELECT image_id, avg((x - y) * (x - y)) AS m FROM pair_px GROUP BY image_id)")
def a4(spark, sf):
    return PM.pair_scores(packed_pairs(spark, sf), ("mse",)).select("image_id", r6(M.psnr_of(F.col("mse"))).alias("psnr"))


@query("f4_psnr_of_mse", f"SELECT step, round({_PSNR.format('(loss * loss)')}, 6) AS psnr FROM run_log")
def f4(spark, sf):
    return V.run_log(spark, sf).select("step", r6(M.psnr_of(F.col("loss") * F.col("loss"))).alias("psnr"))


_SSIM = """SELECT image_id, (2 * mx * my + 6.5025) * (2 * c + 58.5225) / ((mx * mx + my * my + 6.5025) * (vx + vy + 58.5225)) AS s
FROM (SELECT image_id, avg(x) AS mx, avg(y) AS my, var_pop(x) AS vx, var_pop(y) AS vy, covar_samp(x, y) AS c FROM pair_px GROUP BY image_id)"""


@query("a5_global_ssim", f"SELECT image_id, round(s, 6) AS ssim FROM ({_SSIM})")
def a5(spark, sf):
    return PM.pair_scores(packed_pairs(spark, sf), ("ssim",)).select("image_id", r6(F.col("ssim")).alias("ssim"))


def windowed_sql(px: str) -> str:
    """Mean of the four 7 x 7 windows of 8 x 8 images. ``px``: image_id, y, x, v and w (the pair's values)."""
    sums = f"SELECT image_id, a, b, avg(v) AS mx, avg(w) AS my, var_samp(v) AS vx, var_samp(w) AS vy, covar_samp(v, w) AS c FROM ({px}), range(0, 2) p(a), range(0, 2) q(b) WHERE y BETWEEN a AND a + 6 AND x BETWEEN b AND b + 6 GROUP BY image_id, a, b"
    return f"SELECT image_id, avg((2 * mx * my + 6.5025) * (2 * c + 58.5225) / ((mx * mx + my * my + 6.5025) * (vx + vy + 58.5225))) AS s FROM ({sums}) GROUP BY image_id"


_PAIR_ROWS = "SELECT image_id, i // 8 AS y, i % 8 AS x, px_a[i + 1]::DOUBLE AS v, px_b[i + 1]::DOUBLE AS w FROM pairs, range(0, 64) t(i)"


@query("a6_windowed_ssim", f"SELECT image_id, round(s, 6) AS ssim FROM ({windowed_sql(_PAIR_ROWS)})")
def a6(spark, sf):
    return PM.pair_scores(packed_pairs(spark, sf), ("windowed_ssim",)).select("image_id", r6(F.col("windowed_ssim")).alias("ssim"))


_OVERLAP = """SELECT image_id, sum((a AND b)::INT) AS i, sum(a::INT) AS na, sum(b::INT) AS nb FROM (
  SELECT p.image_id, unnest(list_transform(px_a, lambda v: v / (CASE WHEN list_max(px_a) > 1 THEN 255.0 ELSE 1.0 END) > 0.5)) AS a,
    unnest(list_transform(px_b, lambda v: v / (CASE WHEN list_max(px_b) > 1 THEN 255.0 ELSE 1.0 END) > 0.5)) AS b FROM pairs p) GROUP BY image_id"""


@query("a7_dice", f"SELECT image_id, round(CASE WHEN na + nb = 0 THEN 1.0 ELSE 2.0::DOUBLE * i / (na + nb) END, 6) AS dice FROM ({_OVERLAP})")
def a7(spark, sf):
    return PM.pair_scores(packed_pairs(spark, sf), ("dice",)).select("image_id", r6(F.col("dice")).alias("dice"))


@query("a8_iou", f"SELECT image_id, round(CASE WHEN na + nb - i = 0 THEN 1.0 ELSE i::DOUBLE / (na + nb - i) END, 6) AS iou FROM ({_OVERLAP})")
def a8(spark, sf):
    return PM.pair_scores(packed_pairs(spark, sf), ("iou",)).select("image_id", r6(F.col("iou")).alias("iou"))


@query("f5_dice_iou_identity", f"SELECT image_id, round(i::DOUBLE / (na + nb - i), 6) AS iou, round(2.0::DOUBLE * i / (na + nb), 6) AS dice FROM ({_OVERLAP}) WHERE na + nb > 0")
def f5(spark, sf):
    a, b = F.col("px_a"), F.col("px_b")
    d = pairs(spark, sf).filter(F.exists(a, lambda v: v > 127.5) | F.exists(b, lambda v: v > 127.5)).select("image_id", M.dice(a, b).alias("d"), M.iou(a, b).alias("i"))
    return d.select("image_id", r6(M.iou_of_dice(F.col("d"))).alias("iou"), r6(M.dice_of_iou(F.col("i"))).alias("dice"))


def _sided(images: DataFrame, side: str) -> DataFrame:
    return K.pack(images).select("image_id", *[F.col(c).alias(f"{c}_{side}") for c in ("height", "width", "channels", "px")])


def evaluated(spark, sf) -> DataFrame:
    """The evaluation of every pair: MSE, MAE, PSNR, windowed SSIM, and Dice and IoU of the lesions of the generated image against its input mask (null
    where it has none). Packed pixels are joined by key and judged in one pass."""
    a, m = _sided(V.generated(spark, sf), "a"), _sided(V.sized_masks(spark, sf).withColumn("channels", F.lit(1)), "m")
    b = _sided(V.gray_images(spark, sf).withColumn("image_id", F.col("image_id") - 1), "b")
    p = a.join(b.hint("merge"), "image_id").join(m.hint("merge"), "image_id", "left")
    return PM.evaluate(p).withColumn("psnr", M.psnr_of(F.col("mse")))


def summary(values: DataFrame, metrics: tuple[str, ...]) -> DataFrame:
    """Long form: metric, n, mean, std (population), min, max over the finite, non-null values; zeros where PSNR has none. One aggregation."""
    ok = lambda m: F.when(F.col(m).isNotNull() & ~F.isnan(m) & (F.abs(m) != float("inf")), F.col(m))
    aggs = [f(ok(m)).alias(f"{m}_{n}") for m in metrics for n, f in (("n", F.count), ("mean", F.avg), ("std", F.stddev_pop), ("min", F.min), ("max", F.max))]
    wide = values.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(m).alias("metric"), *[F.col(f"{m}_{n}").cast("long" if n == "n" else "double").alias(n) for n in ("n", "mean", "std", "min", "max")]) for m in metrics])
    long = wide.select(F.inline(rows))
    fill = {n: F.when(F.col("metric") == "psnr", F.coalesce(n, F.lit(0.0))).otherwise(F.col(n)) for n in ("mean", "std", "min", "max")}
    return long.filter((F.col("n") > 0) | (F.col("metric") == "psnr")).withColumns(fill)


# Generated images of half the size are resampled to that of their references.
_HALVES = "SELECT image_id, i // 4 AS y, i % 4 AS x, 0 AS ch, px[i + 1]::DOUBLE AS v FROM generated, range(0, 16) t(i) WHERE side = 4"
_FULL = f"SELECT image_id, i // 8 AS y, i % 8 AS x, px[i + 1]::DOUBLE AS v FROM generated, range(0, 64) t(i) WHERE side = 8 UNION ALL SELECT image_id, y, x, v FROM ({resample_sql(_HALVES, 4, 8)})"
_ALIGNED = f"SELECT g.image_id, g.y, g.x, g.v, b.px[g.y * 8 + g.x + 1]::DOUBLE AS w FROM ({_FULL}) g JOIN gray_images b ON b.image_id = g.image_id + 1"
_MEANS = f"SELECT image_id, avg((v - w) * (v - w)) AS mse, avg(abs(v - w)) AS mae FROM ({_ALIGNED}) GROUP BY image_id"
_EVAL = f"SELECT image_id, mse, mae, {_PSNR.format('mse')} AS psnr FROM ({_MEANS})"
_MASK = "(CASE WHEN side = 4 THEN px[y // 2 * 4 + x // 2 + 1] ELSE px[y * 8 + x + 1] END > 127.5)::INT"
_FOUND = f"SELECT image_id, sum(f * m) AS i, sum(f) AS na, sum(m) AS nb FROM (SELECT g.image_id, (g.v / (CASE WHEN max(g.v) OVER (PARTITION BY g.image_id) > 1 THEN 255.0 ELSE 1.0 END) > 0.5)::INT AS f, {_MASK} AS m FROM ({_FULL}) g JOIN sized_masks k ON k.image_id = g.image_id) GROUP BY image_id"
_DICE, _IOU = "CASE WHEN na + nb = 0 THEN 1.0 ELSE 2.0::DOUBLE * i / (na + nb) END", "CASE WHEN na + nb - i = 0 THEN 1.0 ELSE i::DOUBLE / (na + nb - i) END"


def _summary_sql(rel: str, metrics: tuple[str, ...]) -> str:
    one = "SELECT '{m}' AS metric, count(v) AS n, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, round(min(v), 6) AS min, round(max(v), 6) AS max FROM (SELECT {m} AS v FROM ev WHERE isfinite({m}))"
    return f"WITH ev AS ({rel}) " + " UNION ALL ".join(one.format(m=m) for m in metrics)


def _rounded(d: DataFrame) -> DataFrame:
    return d.select("metric", "n", *[r6(F.col(c)).alias(c) for c in ("mean", "std", "min", "max")])


@query("a9_metric_summary", _summary_sql(_EVAL, ("psnr", "mae", "mse")))
def a9(spark, sf):
    return _rounded(summary(evaluated(spark, sf), ("psnr", "mae", "mse")))


@query("e2_pair_evaluation", _summary_sql(f"SELECT e.*, s.s AS ssim, {_DICE} AS dice, {_IOU} AS iou FROM ({_EVAL}) e JOIN ({windowed_sql(_ALIGNED)}) s USING (image_id) LEFT JOIN ({_FOUND}) o USING (image_id)", ("psnr", "ssim", "mae", "mse", "dice", "iou")))
def e2(spark, sf):
    return _rounded(summary(evaluated(spark, sf), ("psnr", "ssim", "mae", "mse", "dice", "iou")))


@query("p19_finite_only", f"SELECT count(*) AS num_images, count(*) FILTER (isfinite(psnr)) AS finite, round(avg(psnr) FILTER (isfinite(psnr)), 6) AS psnr FROM ({_EVAL})")
def p19(spark, sf):
    fin = F.when(F.abs("psnr") != float("inf"), F.col("psnr"))
    return evaluated(spark, sf).agg(F.count(F.lit(1)).alias("num_images"), F.count(fin).alias("finite"), r6(F.avg(fin)).alias("psnr"))


def structure(spark, sf) -> DataFrame:
    """Red-channel lesions of an image against its input mask, resized to the image where it has another size; where a mask is missing, Dice
    and IoU are null and the row stays."""
    m = _sided(V.sized_masks(spark, sf).withColumn("channels", F.lit(1)), "m")
    return PM.structure_scores(_sided(V.rgb_images(spark, sf), "a").join(m.hint("merge"), "image_id", "left"))


_STRUCT = f"""SELECT image_id, CASE WHEN any_value(mk) IS NULL THEN NULL WHEN sum(f) + sum(m) = 0 THEN 1.0 ELSE 2.0::DOUBLE * sum(f * m) / (sum(f) + sum(m)) END AS dice,
  CASE WHEN any_value(mk) IS NULL THEN NULL WHEN sum(f) + sum(m) - sum(f * m) = 0 THEN 1.0 ELSE sum(f * m)::DOUBLE / (sum(f) + sum(m) - sum(f * m)) END AS iou FROM (
  SELECT r.image_id, m.image_id AS mk, (r.px[3 * i + 1] / (CASE WHEN list_max(r.px) > 1 THEN 255.0 ELSE 1.0 END) > 0.5)::INT AS f, CASE WHEN m.image_id IS NULL THEN 0 ELSE {_MASK.replace('px[', 'm.px[')} END AS m
  FROM (SELECT *, i // 8 AS y, i % 8 AS x FROM rgb_images, range(0, 64) t(i)) r LEFT JOIN sized_masks m ON m.image_id = r.image_id) GROUP BY image_id"""


@query("e3_structure_evaluation", f"SELECT image_id, round(dice, 6) AS dice, round(iou, 6) AS iou FROM ({_STRUCT})")
def e3(spark, sf):
    return structure(spark, sf).select("image_id", r6(F.col("dice")).alias("dice"), r6(F.col("iou")).alias("iou"))


_HIGH = lambda m: "CASE WHEN {0} > {1} THEN 'excellent' WHEN {0} >= {2} THEN 'good' WHEN {0} >= {3} THEN 'acceptable' ELSE 'poor' END".format(m, *M.BANDS[m])
_LOW = lambda m: "CASE WHEN {0} < {1} THEN 'excellent' WHEN {0} <= {2} THEN 'good' WHEN {0} <= {3} THEN 'acceptable' ELSE 'poor' END".format(m, *M.BANDS[m])


@query("p16_quality_band", f"SELECT image_id, {_HIGH('psnr')} AS psnr, {_LOW('mae')} AS mae, {_LOW('mse')} AS mse FROM ({_EVAL})")
def p16(spark, sf):
    return evaluated(spark, sf).select("image_id", *[M.band(m, F.col(m)).alias(m) for m in ("psnr", "mae", "mse")])


def _verdict_sql() -> str:
    out = "CASE"
    for name, b in M.VERDICTS.items():
        e = "" if name == "ideal" else "="
        out += " WHEN " + " AND ".join(f"{m} {'<' if m in ('mae', 'mse') else '>'}{e} {t}" for m, t in b.items()) + f" THEN '{name}'"
    return out + " ELSE 'poor' END"


@query("p17_verdict", f"SELECT step, {_verdict_sql()} AS verdict FROM (SELECT step, 20 + loss / 5 AS psnr, 0.7 + loss / 400 AS ssim, 30 - loss / 4 AS mae, 1200 - loss * 12 AS mse, 0.5 + loss / 200 AS dice, 0.3 + loss / 200 AS iou FROM run_log)")
def p17(spark, sf):
    x = F.col("loss")
    v = {"psnr": 20 + x / 5, "ssim": 0.7 + x / 400, "mae": 30 - x / 4, "mse": 1200 - x * 12, "dice": 0.5 + x / 200, "iou": 0.3 + x / 200}
    return V.run_log(spark, sf).select("step", M.verdict(v).alias("verdict"))


@query("p23_class_range", "SELECT image_id, list_max(px) >= 255 AS out_of_range FROM gray_images")
def p23(spark, sf):
    return V.gray_images(spark, sf).select("image_id", (F.array_max("px") >= F.lit(255)).alias("out_of_range"))


_MODALITY = "(VALUES " + ", ".join(f"({i}, '{n}', {p}, {d}, '{m}')" for i, (n, p, d, m) in enumerate(M.MODALITIES)) + ") t(k, modality, least_psnr, least_dice, method)"


@query("p26_modality_acceptance", f"SELECT image_id, modality, method, psnr > least_psnr AND dice > least_dice AS accepted FROM (SELECT e.image_id, psnr + 15 AS psnr, {_DICE} AS dice FROM ({_EVAL}) e JOIN ({_FOUND}) o USING (image_id)) x JOIN {_MODALITY} ON k = image_id % 3")
def p26(spark, sf):
    limits = spark.createDataFrame([(i, *m) for i, m in enumerate(M.MODALITIES)], "k int, modality string, least_psnr double, least_dice double, method string")
    e = evaluated(spark, sf).filter(F.col("dice").isNotNull()).select("image_id", (F.col("psnr") + 15).alias("psnr"), "dice")
    return e.join(F.broadcast(limits), F.col("image_id") % 3 == F.col("k")).select("image_id", "modality", "method", ((F.col("psnr") > F.col("least_psnr")) & (F.col("dice") > F.col("least_dice"))).alias("accepted"))


_MERGED = "SELECT image_id, array_to_string(list(v ORDER BY i), ',') AS px FROM (SELECT {0} AS image_id, i, max(v) AS v FROM (SELECT image_id, unnest(range(0, 64)) AS i, unnest(px) AS v FROM masks) GROUP BY ALL) GROUP BY image_id"


def _merged(masks: DataFrame) -> DataFrame:
    return K.unpack(K.merge_masks(K.pack(masks))).select("image_id", text(F.col("px")).alias("px"))


@query("a18_merge_masks", "WITH m AS (" + _MERGED.format("image_id // 8") + ") SELECT k AS image_id, coalesce(px, array_to_string(list_transform(range(0, 64), lambda i: 0), ',')) AS px FROM (SELECT DISTINCT image_id // 8 AS k FROM gray_images UNION SELECT -1) g LEFT JOIN m ON m.image_id = k")
def a18(spark, sf):
    """Several masks an image, and none for image -1: its mask is zero."""
    of = lambda d: d.withColumn("image_id", F.floor(F.col("image_id") / 8).cast("long"))
    images = of(V.gray_images(spark, sf).select("image_id")).distinct().unionByName(spark.range(1).select((F.col("id") - 1).alias("image_id")))
    merged = _merged(of(V.masks(spark, sf))).withColumnRenamed("image_id", "mid")
    out = images.join(merged.hint("merge"), F.col("image_id") == F.col("mid"), "left")
    return out.select("image_id", F.coalesce("px", text(F.array_repeat(F.lit(0), 64))).alias("px"))


@query("a18_merge_many_masks", _MERGED.format("image_id % 3"))
def a18_many(spark, sf):
    """A third of all masks belongs to each of three images."""
    return _merged(V.masks(spark, sf).withColumn("image_id", F.col("image_id") % 3))


@query("a25_distinct_labels", "SELECT image_id, array_to_string(list_sort(list_distinct(px)), ',') AS labels, len(list_distinct(px))::INT AS n FROM masks")
def a25(spark, sf):
    d = F.sort_array(F.array_distinct("px"))
    return V.masks(spark, sf).select("image_id", text(d).alias("labels"), F.size(d).alias("n"))
