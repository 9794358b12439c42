"""Manifest operators: tolerant parsing, validation against listings, sidecars, unions, statistics."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.image import let

REQUIRED = ("image_path", "caption")


def _parsed(line: Column) -> Column:
    """The line as a variant under ``r``, null if it is no JSON. Spark's parser stops after the first value, so the line must parse inside an object and
    inside a list."""
    in_map, in_list = (F.try_parse_json(F.concat(F.lit(a), line, F.lit(b))) for a, b in (('{"r":', "}"), ("[", "]")))
    return F.when(in_list.isNotNull(), in_map)


def classify_lines(lines: DataFrame, line: str = "line", required: tuple[str, ...] = REQUIRED) -> DataFrame:
    """Add reason: blank, bad_json, not_object, missing_key or ok. A key whose value is null is present."""
    return _classified(lines, line, required).drop("_v")


def _classified(lines: DataFrame, line: str, required: tuple[str, ...]) -> DataFrame:
    """With _v, the parsed line. Both come out of one generator, as what is computed there is never computed again by a filter that stands above."""

    def judged(s: Column, v: Column) -> Column:
        there = reduce(lambda a, b: a & b, [F.try_variant_get(v, f"$.r.{k}", "variant").isNotNull() for k in required])
        reason = F.when(s.isNull() | (s == ""), "blank").when(v.isNull(), "bad_json").when(~s.startswith("{"), "not_object").when(~there, "missing_key").otherwise("ok")
        return F.array(F.struct(reason.alias("reason"), v.alias("_v")))

    return lines.select("*", F.inline(let(X.strip(F.col(line)), lambda s: let(_parsed(s), lambda v: judged(s, v)))))


def judged_lines(lines: DataFrame, key: str, line: str = "line") -> DataFrame:
    """All lines: ``key``, image_path, caption, mask_path, text_only (of valid ones), line, reason."""
    field = lambda k: F.when(F.col("reason") == "ok", F.try_variant_get(F.col("_v"), f"$.r.{k}", "string")).alias(k)
    out = _classified(lines, line, REQUIRED).select(key, field("image_path"), field("caption"), field("mask_path"), F.col(line).alias("line"), "reason")
    return out.select(key, "image_path", "caption", "mask_path", F.when(F.col("reason") == "ok", F.col("mask_path").isNull()).alias("text_only"), "line", "reason")


def parse_lines(lines: DataFrame, key: str, line: str = "line") -> DataFrame:
    """The records of valid lines: ``key``, image_path, caption, mask_path, text_only, extra (the whole record as a variant)."""
    ok = _classified(lines, line, REQUIRED).filter(F.col("reason") == "ok")
    field = lambda k: F.try_variant_get(F.col("_v"), f"$.r.{k}", "string").alias(k)
    out = ok.select(key, field("image_path"), field("caption"), field("mask_path"), F.try_variant_get(F.col("_v"), "$.r", "variant").alias("extra"))
    return out.select(key, "image_path", "caption", "mask_path", F.col("mask_path").isNull().alias("text_only"), "extra")


def resolve_existing(rows: DataFrame, listing: DataFrame, column: str) -> DataFrame:
    """Add resolved: the path where ``listing`` (path) has it, else null."""
    return rows.join(listing.select(F.col("path").alias("resolved")).distinct(), F.col(column) == F.col("resolved"), "left")


def prefix_paths(rows: DataFrame, root: str, columns: tuple[str, ...] = ("path", "image_url", "image")) -> DataFrame:
    """Join ``root`` to every one of ``columns`` that the rows have."""
    return rows.withColumns({c: F.concat_ws("/", F.lit(root), c) for c in columns if c in rows.columns})


def with_root(rows: DataFrame, root: Column | str | None) -> DataFrame:
    """Attach a source's root as _image_root; a source without one has null."""
    return rows.withColumn("_image_root", F.lit(root).cast("string"))


def attach_masks(rows: DataFrame, masks: DataFrame) -> DataFrame:
    """``masks``: mask (paths that exist or decode). A row whose mask is not among them becomes text-only and stays."""
    return rows.drop("text_only").join(masks, F.col("mask_path") == F.col("mask"), "left").withColumn("text_only", F.col("mask").isNull())


def valid_requests(requests: DataFrame) -> DataFrame:
    return requests.filter(~(F.col("mask_path").isNull() & (F.coalesce("text", F.lit("")) == "") & (F.col("grade") == "None")))


def request_caption(default: str = "Diabetic retinopathy fundus image") -> Column:
    """The grade's caption, else the free text, else the default."""
    return F.when(F.col("grade") != "None", X.label_to_caption(F.col("grade"))).when(F.coalesce("text", F.lit("")) != "", F.col("text")).otherwise(default)


def normalise_requests(requests: DataFrame) -> DataFrame:
    return requests.withColumns({"mask_path": F.when(F.col("use_mask"), F.col("mask_path")), "seed": F.when(F.col("seed") >= 0, F.col("seed")), "dr_grade": F.when(F.col("grade") != "None", F.col("grade"))})


def with_sidecar(images: DataFrame, own: DataFrame, default: DataFrame) -> DataFrame:
    """``images``: suffix, dir. ``own``: suffix, s_caption, s_grade. ``default``: dir, d_caption. The own sidecar, else the folder's."""
    return images.join(own, "suffix", "left").join(default, "dir", "left").withColumn("caption", F.coalesce("s_caption", "d_caption"))


def grades_with_lesions(grades: DataFrame, listing: DataFrame, lesions: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """Graded images that exist, with one mask path column per lesion kind (one shuffle for all kinds)."""
    there = grades.join(listing, F.col("image_path") == F.col("path"), "left_semi")
    wide = lesions.groupBy("doc_id").pivot("kind", list(kinds)).agg(F.first("p"))
    return there.join(wide, "doc_id", "left")


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def tagged_union(generated: DataFrame, original: DataFrame) -> DataFrame:
    """Generated rows and original ones, the latter with a blank caption and no mask."""
    blank = original.withColumns({"caption": F.lit(""), "mask_path": F.lit(None).cast("string"), "source": F.lit("original")})
    return generated.withColumn("source", F.lit("generated")).unionByName(blank)


def statistics(manifest: DataFrame) -> DataFrame:
    """Totals, shares and caption lengths; the shares of an empty manifest are null."""
    n, m, size = F.count(F.lit(1)), F.count("mask_path"), F.char_length(F.coalesce("caption", F.lit("")))
    return manifest.agg(n.alias("total"), m.alias("with_mask"), (n - m).alias("text_only"), F.round(F.try_divide(100.0 * m, n), 6).alias("with_mask_pct"), F.round(F.try_divide(100.0 * (n - m), n), 6).alias("text_only_pct"),
                        F.min(size).alias("min_len"), F.max(size).alias("max_len"), F.round(F.avg(size), 6).alias("avg_len"))


def numbered_lines(files: DataFrame, text: str) -> DataFrame:
    """The lines of whole files, numbered from 1."""
    return files.select("*", F.posexplode(F.split(text, "\n")).alias("k", "line")).withColumn("line_no", F.col("k") + 1)
