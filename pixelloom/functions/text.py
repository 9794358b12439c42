"""Scalar functions of strings, labels and hashes."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The captions of the grades.
GRADES = {0: "No diabetic retinopathy", 1: "Mild non-proliferative diabetic retinopathy", 2: "Moderate non-proliferative diabetic retinopathy", 3: "Severe non-proliferative diabetic retinopathy", 4: "Proliferative diabetic retinopathy"}


def strip(c: Column) -> Column:
    """Without white space of any kind on either side."""
    return F.regexp_replace(c, r"^(?U)\s+|\s+$", "")


def label_to_caption(label: Column, mapping: dict[int, str] | None = None) -> Column:
    """Text that is a whole number is looked up (unknown: ``Unknown grade: n``); other text stays; null stays null."""
    pairs = [x for k, v in (mapping or GRADES).items() for x in (F.lit(str(k)), F.lit(v))]
    number = F.when(label.rlike(r"^\s*[+-]?[0-9]+\s*$"), F.regexp_replace(label, r"^\s*\+?|\s+$", "").try_cast("bigint").cast("string"))
    return F.when(number.isNotNull(), F.coalesce(F.try_element_at(F.create_map(*pairs), number), F.concat(F.lit("Unknown grade: "), number))).otherwise(label)


def integer_label(label: Column) -> Column:
    """A label as integer; white space around it, a sign and leading zeros are allowed. Any other text, and null, is an error in every mode of Spark."""
    n = strip(label).try_cast("int")
    return F.when(n.isNotNull(), n).otherwise(F.raise_error(F.concat(F.lit("no integer label: "), F.coalesce(label, F.lit("null")))).cast("int"))


def resolve_path(path: Column, base: str) -> Column:
    return F.when(path.startswith("/"), path).otherwise(F.concat_ws("/", F.lit(base), path))


def stem_suffix(stem: Column) -> Column:
    return F.element_at(F.split(stem, "_"), -1)


def mix_hash(key: Column, seed: int) -> Column:
    """A linear hash that other engines share, in [0, 2 ** 31)."""
    return F.pmod(F.pmod(key.cast("long"), F.lit(2147483648)) * 1103515245 + seed * 12345, F.lit(2147483648))


def unit(h: Column) -> Column:
    return h / 2147483648.0


def choose_caption(captions: Column, h: Column | None) -> Column:
    """One of a list by hash, or without a hash the first; no captions: an empty text."""
    pick = F.get(captions, F.lit(0)) if h is None else F.get(captions, (h % F.greatest(F.size(captions), F.lit(1))).cast("int"))
    return F.when(F.size(captions) > 0, pick).otherwise("")


def drop_caption(caption: Column, h: Column, p: float = 0.1) -> Column:
    return F.when(unit(h) < p, "").otherwise(caption)


def drop_label(label: Column, h: Column, p: float, num_classes: int, force: Column | None = None) -> Column:
    gone = unit(h) < p
    return F.when(gone if force is None else gone | force, num_classes).otherwise(label)


def batch_id(ts: Column) -> Column:
    return F.concat_ws("_", F.date_format(ts, "yyyyMMdd_HHmmss"), F.substring(F.uuid(), 1, 8))


def time_embedding(t: Column, dim: int, max_period: float = 10000.0) -> Column:
    """Cosines, then sines, of ``t`` at falling frequencies; an odd dimension ends with 0."""
    half = dim // 2
    angle = lambda i: t * F.exp(-F.log(F.lit(max_period)) * i / half)
    steps = F.sequence(F.lit(0), F.lit(half - 1))
    parts = [F.transform(steps, lambda i: F.cos(angle(i))), F.transform(steps, lambda i: F.sin(angle(i)))]
    return F.concat(*parts, *([F.array(F.lit(0.0))] if dim % 2 else []))
