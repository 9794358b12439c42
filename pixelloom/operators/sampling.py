"""Positions, samples, splits, shards and batches. All randomness is a hash of a seed and a key, so every plan can be run again."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.image import let
from ..functions.text import mix_hash
from ..sources.scratch import materialize


#: Rows of a range (a task numbers one range), most ranges, and keys of a range in the sample that sets its bounds.
RANGE_ROWS, MOST_RANGES, SAMPLED = 1 << 15, 10_000, 20


def _bounds(keys: DataFrame, ranges: int, n: int) -> list:
    """The keys at which ranges of like size begin, from a sample of SAMPLED keys a range."""
    some = keys.sample(min(1.0, SAMPLED * ranges / n), seed=1).orderBy(*keys.columns).collect()
    cut = [some[len(some) * k // ranges] for k in range(1, ranges)] if some else []
    return list(dict.fromkeys(cut))


def _range_of(keys: list[Column], bounds: list, schema) -> Column:
    """How many of the sorted ``bounds`` are not over the keys, by halving."""
    literal = F.array(*[F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(b, schema)]) for b in bounds])
    at = F.struct(*[k.alias(f.name) for k, f in zip(keys, schema)])

    def half(s: Column, _: Column) -> Column:
        mid = ((s["lo"] + s["hi"]) / 2).cast("int")
        over = let(mid, lambda m: F.when(at >= F.get(literal, m), F.struct((m + 1).alias("lo"), s["hi"].alias("hi"))).otherwise(F.struct(s["lo"].alias("lo"), m.alias("hi"))))
        return F.when(s["lo"] < s["hi"], over).otherwise(s)

    steps = F.array(*[F.lit(0)] * (len(bounds).bit_length() + 1))
    return F.aggregate(steps, F.struct(F.lit(0).alias("lo"), F.lit(len(bounds)).alias("hi")), half)["lo"]


def global_index(df: DataFrame, order: list, name: str = "idx") -> DataFrame:
    """A dense 0-based position of all rows in the ascending order (nulls first) of ``order``, names or expressions.

    The rows are counted, and a sample of their keys is cut into ranges of RANGE_ROWS rows. With these bounds, which stay the same in every pass, the keys are counted by range, and the
    rows are numbered within their range, behind the sum of the counts before it. Only keys and counts are read in the passes before the last, and nothing is
    written; so the rows must be the same each time they are read. Rows that share all of ``order`` stand in one range, in any order."""
    cols = [F.col(c) if isinstance(c, str) else c for c in order]
    keys = df.select(*[c.alias(f"k{i}") for i, c in enumerate(cols)])
    n = keys.count()
    ranges = min(-(-n // RANGE_ROWS), MOST_RANGES)
    bounds = _bounds(keys, ranges, n) if ranges > 1 else []
    if not bounds:  # RANGE_ROWS rows or fewer
        return df.withColumn(name, (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*cols)) - 1).cast("long"))
    names = [F.col(c) for c in keys.columns]
    counts = keys.groupBy(_range_of(names, bounds, keys.schema).alias("r")).count().collect()
    before, total = [0] * (len(bounds) + 1), {r["r"]: r["count"] for r in counts}
    for k in range(len(bounds)):
        before[k + 1] = before[k] + total.get(k, 0)
    out = df.withColumn("_range", _range_of(cols, bounds, keys.schema))
    local = F.row_number().over(Window.partitionBy("_range").orderBy(*cols)) - 1
    return out.withColumn(name, (F.get(F.array(*[F.lit(x).cast("long") for x in before]), F.col("_range")) + local).cast("long")).drop("_range")


def group_ranges(indexed: DataFrame, group: str) -> DataFrame:
    """First and last index of each group and its size."""
    return indexed.groupBy(group).agg(F.min("idx").alias("first"), F.max("idx").alias("last"), F.count(F.lit(1)).alias("n"))


def exact_sample(df: DataFrame, key: str, ratio: float, seed: int) -> DataFrame:
    """Exactly floor(n * ratio) rows without replacement: the first ones in the order of a seeded hash."""
    n = df.count()
    return global_index(df, [mix_hash(F.col(key), seed), key], "_r").filter(F.col("_r") < int(n * ratio)).drop("_r")


def exact_sample_per_group(df: DataFrame, group: str, key: str, ratios: DataFrame, seed: int) -> DataFrame:
    """``ratios``: group, ratio. Of every group floor(n * ratio) rows in hash order (groups without a ratio stay whole). The positions are
    counted over all groups, so that a group of any size is spread over many tasks."""
    ranked = materialize(global_index(df, [group, mix_hash(F.col(key), seed), key], "_r"), "ranked")
    per = ranked.groupBy(F.col(group).alias("_g")).agg(F.min("_r").alias("_first"), F.count(F.lit(1)).alias("_n"))
    ratios = ratios.select(F.col(group).alias("_rg"), "ratio")
    limit = per.join(ratios, F.col("_g").eqNullSafe(F.col("_rg")), "left").select("_g", "_first", F.floor(F.col("_n") * F.coalesce("ratio", F.lit(1.0))).alias("_k"))
    # One row for each group: Spark broadcasts it if its measured size is small, and splits a hot group else.
    out = ranked.join(limit, F.col(group).eqNullSafe(F.col("_g")))
    return out.filter(F.col("_r") - F.col("_first") < F.col("_k")).drop("_r", "_g", "_first", "_k")


def shuffled(df: DataFrame, key: str, seed: int) -> DataFrame:
    """Add pos, the position in a seeded shuffle."""
    return global_index(df, [mix_hash(F.col(key), seed), key], "pos")


def split_by_position(indexed: DataFrame, every: int = 5) -> DataFrame:
    return indexed.withColumn("split", F.when(F.col("idx") % every == 0, "validation").otherwise("train"))


def shard_plan(keys: DataFrame, key: str, epochs: int, workers: int, batch: int, seed: int, max_steps: int | None = None, resume_step: int = 0) -> DataFrame:
    """The order in which ``workers`` meet the rows over ``epochs`` shuffled anew: epoch, pos, worker, slot, step. The positions of all
    epochs are dealt to the workers in turn as one stream; a step takes ``batch`` rows over all workers."""
    n = keys.count()
    many = keys.select(F.col(key).cast("long").alias("id")).withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    h = F.pmod(F.pmod(F.col("id"), F.lit(2147483648)) * 1103515245 + (F.lit(seed) + F.col("epoch")).cast("long") * 12345, F.lit(2147483648))
    g = global_index(many.withColumn("_h", h), ["epoch", "_h", "id"], "g").drop("_h")
    out = g.withColumns({"pos": F.col("g") - F.col("epoch") * n, "worker": (F.col("g") % workers).cast("int"), "slot": F.floor(F.col("g") / workers)})
    out = out.withColumn("step", F.floor(F.col("slot") / (batch // workers)))
    if max_steps is not None:
        out = out.filter(F.col("step") < max_steps)
    return out.filter(F.col("step") >= resume_step)


def chunk_of(idx: Column, n: int, workers: int) -> Column:
    """Contiguous chunks of ceil(n / workers) rows; the last may be short."""
    return F.floor(idx / max(1, -(-n // workers))).cast("int")


def batches(indexed: DataFrame, size: int, micro: int | None = None, drop_last: bool = False) -> DataFrame:
    """Add batch and, if asked, micro; ``drop_last`` leaves out a short last batch."""
    out = indexed.withColumn("batch", F.floor(F.col("idx") / size))
    if micro:
        out = out.withColumn("micro", F.floor(F.pmod(F.col("idx"), F.lit(size)) / micro).cast("int"))
    if drop_last:
        out = out.filter(F.col("batch") < indexed.count() // size)
    return out


#: Rows of a block in a running aggregate: a window holds one block, or one row for each block.
BLOCK = 1 << 16


def in_blocks(df: DataFrame, order: list) -> DataFrame:
    """Add _i, the position over all rows, and _b, its block: what runs along the order can then run inside blocks, with a carry between them. The rows are
    written, as blocks and carries are read apart."""
    return materialize(global_index(df, order, "_i").withColumn("_b", F.floor(F.col("_i") / BLOCK)), "blocks")


def fallback_items(rows: DataFrame, group: str) -> DataFrame:
    """``rows``: group, idx, valid (a value, null if unreadable). Adds used: the valid value itself, else the nearest valid one before it in the
    group, else the group's last; null in a group without any."""
    g = in_blocks(rows, [group, "idx"])
    inside = F.last("valid", True).over(Window.partitionBy("_b", group).orderBy("_i").rowsBetween(Window.unboundedPreceding, 0))
    per = g.groupBy(F.col(group).alias("_g"), F.col("_b").alias("_gb")).agg(F.max_by("valid", F.when(F.col("valid").isNotNull(), F.col("_i"))).alias("_last"))
    w = Window.partitionBy("_g").orderBy("_gb")
    carry = per.select("_g", "_gb", F.last("_last", True).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("_before"), F.last("_last", True).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_end"))
    out = g.withColumn("_inside", inside).join(carry.hint("merge"), F.col(group).eqNullSafe(F.col("_g")) & (F.col("_b") == F.col("_gb")), "left")
    return out.withColumn("used", F.coalesce("_inside", "_before", "_end")).drop("_i", "_b", "_inside", "_g", "_gb", "_before", "_end")


def seed_list(given: Column, k: int, default: int = 42) -> Column:
    """``given`` (the default if there are none), padded with hashes up to ``k``; more than ``k`` are an error."""
    base = F.when(F.size(given) > 0, given).otherwise(F.array(F.lit(default).cast("bigint")))
    pad = F.transform(F.sequence(F.lit(1), F.lit(k)), lambda i: F.pmod(i.cast("long") * 1103515245 + 12345, F.lit(2147483648)))
    whole = F.slice(F.concat(base, pad), 1, k)
    return F.when(F.size(base) <= k, whole).otherwise(F.raise_error(F.lit("more seeds than samples")).cast("array<bigint>"))


def parse_resolution(text: Column) -> tuple[Column, Column]:
    """Width and height of ``category:WxH`` or ``category WxH``."""
    return F.regexp_extract(text, r"(\d+)x(\d+)$", 1).cast("int"), F.regexp_extract(text, r"(\d+)x(\d+)$", 2).cast("int")


def job_grid(captions: DataFrame, resolutions: list[str], seeds: list[int], size: int = 1024) -> DataFrame:
    """``captions``: idx, caption, worker. One row per caption, resolution and seed, with geometry and the output name. The grid is a
    generator over two literal lists, so the captions are never shuffled."""
    res = F.explode(F.array(*[F.lit(r) for r in resolutions]))
    s = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(x).alias("seed")) for i, x in enumerate(seeds)])
    g = captions.withColumn("resolution", res).withColumn("_s", F.explode(s))
    w, h = parse_resolution(F.col("resolution"))
    g = g.withColumns({"seed": F.col("_s.seed"), "i": F.col("_s.i"), "w": w, "h": h}).drop("_s")
    g = g.withColumns({"latent_w": F.floor(F.col("w") / 8).cast("int"), "latent_h": F.floor(F.col("h") / 8).cast("int"), "scale": F.sqrt(F.col("w") * F.col("h") / float(size * size))})
    return g.withColumn("name", F.format_string("%d_res=%s_%d_seed=%d_gpu=%d.png", F.col("idx"), F.concat_ws("x", "w", "h"), F.col("i"), F.col("seed"), F.col("worker")))
