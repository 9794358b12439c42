"""Path policy, flattened configurations and operation logs."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..sources.scratch import materialize


#: Words that are settings and no paths, and marks of a path.
NOT_PATHS = ("cuda", "cpu", "ddpm", "ddim", "png", "jpg", "jpeg")
PATH_MARKS = ("/", "\\", ".pth", ".yaml", ".json", ".jsonl", ".txt", ".log")


def looks_like_path(value: Column) -> Column:
    """At least three characters, no setting's word, and a slash or a known extension somewhere."""
    marked = reduce(lambda a, b: a | b, [F.contains(value, F.lit(m)) for m in PATH_MARKS])
    return F.coalesce((F.char_length(value) >= 3) & ~value.isin(*NOT_PATHS) & marked, F.lit(False))


def is_valid_path(value: Column, allowed_prefix: str) -> Column:
    """Relative, or starting with the allowed prefix; empty and null are not valid."""
    return F.coalesce((value != "") & (~value.startswith("/") | value.startswith(allowed_prefix)), F.lit(False))


def suggestion(value: Column, allowed_prefix: str) -> Column:
    """A relative form of a path that is not valid."""
    return F.when(~is_valid_path(value, allowed_prefix), F.regexp_replace(value, "^/+", ""))


def flatten_config(rows: DataFrame, column: str) -> DataFrame:
    """One row per leaf of a JSON document: key (``a.b[0]``) and value. One generator a level, until no document has a deeper one; empty objects and lists
    stay as JSON text, and broken documents as one row without value."""
    keep = [c for c in rows.columns if c != column]
    open_, done = rows.select(*keep, F.try_parse_json(F.col(column)).alias("_v"), F.lit("").alias("_k")), []
    nested = F.coalesce(F.schema_of_variant("_v").rlike(r"^(OBJECT<.|ARRAY<)") & ~F.to_json("_v").isin("{}", "[]"), F.lit(False))
    while True:
        open_ = materialize(open_.withColumn("_n", nested), "config-level")
        done.append(open_.filter(~F.col("_n")).drop("_n"))
        deeper = open_.filter("_n").drop("_n")
        if not deeper.limit(1).count():
            break
        level = deeper.lateralJoin(deeper.sparkSession.tvf.variant_explode(F.col("_v").outer()))
        path = F.when(F.col("key").isNull(), F.concat(F.col("_k"), F.lit("["), F.col("pos"), F.lit("]"))).otherwise(F.concat_ws(".", F.nullif(F.col("_k"), F.lit("")), F.col("key")))
        open_ = level.select(*keep, F.col("value").alias("_v"), path.alias("_k"))
    out = reduce(lambda a, b: a.unionByName(b), done)
    return out.select(*keep, F.col("_k").alias("key"), F.try_variant_get("_v", "$", "string").alias("value"))


#: What the key of a path setting contains.
PATH_KEYS = ("path", "dir", "file")


def path_settings(flat: DataFrame, allowed_prefix: str) -> DataFrame:
    """The leaves of ``flatten_config`` whose own key (not that of a list they stand in) names a path and whose value is an absolute one, with a slash or a
    drive letter in front, outside the allowed prefix."""
    own = F.lower(F.substring_index("key", ".", -1))
    named = reduce(lambda a, b: a | b, [F.contains(own, F.lit(k)) for k in PATH_KEYS]) & ~F.endswith(F.col("key"), F.lit("]"))
    absolute = F.col("value").startswith("/") | F.coalesce(F.substring("value", 2, 1) == ":", F.lit(False))
    return flat.filter(named & absolute & ~F.col("value").startswith(allowed_prefix))


def parse_ops(lines: DataFrame, column: str) -> DataFrame:
    """Operation log lines: at (the text before the third colon, or the second of two), kind, old_path, new_path, path. Lines with fewer colons are
    skipped, blank ones too."""
    line = X.strip(F.col(column))
    colons = F.size(F.split(line, ":")) - 1
    head = F.when(colons >= 3, F.substring_index(line, ":", 3)).when(colons == 2, F.substring_index(line, ":", 2))
    words = F.split(X.strip(F.substr(line, F.length(head) + 2)), r"\s+")
    lower = F.transform(words, lambda w: F.lower(w))
    to = F.array_position(lower, "to").cast("int") - 1
    said = lambda verb: F.exists(lower, lambda w: F.contains(w, F.lit(verb)))
    renamed = said("renamed") & (to >= 2) & (to + 1 < F.size(words))
    kind = F.when(renamed, "rename").when(said("deleted") & (F.size(words) >= 2), "delete").otherwise("unknown")
    out = lines.filter(head.isNotNull()).withColumns({"at": X.strip(head), "kind": kind})
    return out.withColumns({"old_path": F.when(F.col("kind") == "rename", F.get(words, to - 1)), "new_path": F.when(F.col("kind") == "rename", F.get(words, to + 1)), "path": F.when(F.col("kind") == "delete", F.get(words, 1))})
