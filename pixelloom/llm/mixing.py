"""Mixing sources to target weights by entropy balancing.

The rates w of the documents minimise their relative entropy to one copy each, within 0 <= w <= 2, such that every source's tokens
sum to its target. The dual is convex with one multiplier per source: w = min(2, exp(lambda * size)). Distributed Newton
iterations (an aggregation by source over a histogram of sizes, with a bracket as safeguard) solve it; the rates are then rounded
into whole copies so that rounding errors cancel along the sizes.
"""
from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, n_words_of

#: Weights of the sources in order, repeating; share of all tokens; most copies of a document.
WEIGHTS, SHARE, CAP = (5.0, 2.0, 1.0), 1.5, 2.0
#: The Newton iterations end when every source's tokens are so near (relative) to its target; with the bracket halved where Newton leaves it they do
#: after a few dozens. More than ROUNDS are an error.
TOLERANCE, ROUNDS = 1e-6, 300
#: Documents of one source and size are ranked in so many salted groups.
SALTS = 64


def source_targets(sized: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """``sized``: source, size. One row per source (null is a source): source, source_size, target.

    The sources, in code point order with null last, weigh ``weights`` repeating and share ``share`` of all tokens; a target stops at
    ``cap`` times its source's tokens and the excess is shared again by weight. Filling by ascending cap per weight gives the
    end of that process at once: the first source whose cap is not reached sets the level. The windows hold one row per source."""
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    w = F.array(*[F.lit(x) for x in weights])
    k = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    per = per.withColumn("weight", F.get(w, k)).withColumn("limit", F.lit(cap) * F.col("source_size"))
    by = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.lit(share) * F.sum("source_size").over(everything)
    left_weight = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    level = (total - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / left_weight
    per = per.withColumn("level", level)
    final = F.max(F.when(F.col("level") <= F.col("limit") / F.col("weight"), F.col("level"))).over(everything)
    fill = F.coalesce(final * F.col("weight"), F.col("limit"))
    return per.withColumn("target", F.least(fill, F.col("limit"))).select("source", "source_size", "target")


def dual_rates(cells: DataFrame, targets: DataFrame, cap: float = CAP) -> DataFrame:
    """``cells``: source, size, n (documents of a source that have a size). Returns the cells with ``rate``."""
    cells = cells.filter(F.col("size") > 0)
    scale = targets.select("source", F.col("target").cast("double").alias("target"), F.col("source_size").cast("double").alias("total"))
    mean = cells.groupBy("source").agg((F.sum(F.col("n") * F.col("size")) / F.sum("n")).alias("mean"), F.max("size").alias("longest"))
    state = scale.join(mean.withColumnRenamed("source", "ms").hint("merge"), F.col("source").eqNullSafe(F.col("ms"))).drop("ms")
    state = materialize(state.select("source", "target", "total", "mean", F.lit(0.0).alias("lam"), F.lit(-1e6).alias("lo"), F.lit(1e6).alias("hi"), F.lit(1.0).alias("gap")), "mixing-dual")
    cells = materialize(cells, "mixing-cells")
    for _ in range(ROUNDS):
        both = cells.join(state.withColumnRenamed("source", "ss").hint("merge"), F.col("source").eqNullSafe(F.col("ss")))
        c = F.col("size") / F.col("mean")
        raw = F.exp(F.least(F.col("lam") * c, F.lit(50.0)))
        w = F.least(raw, F.lit(cap))
        sums = both.groupBy(F.col("source").alias("gs")).agg(F.sum(F.col("n") * F.col("size") * w).alias("have"), F.sum(F.when(raw < cap, F.col("n") * F.col("size") * c * raw).otherwise(0.0)).alias("slope"))
        x = state.join(sums.hint("merge"), F.col("source").eqNullSafe(F.col("gs")))
        over = F.col("have") - F.col("target")
        lo, hi = F.when(over < 0, F.col("lam")).otherwise(F.col("lo")), F.when(over > 0, F.col("lam")).otherwise(F.col("hi"))
        x = x.select("source", "target", "total", "mean", "lam", lo.alias("lo"), hi.alias("hi"), over.alias("over"), "slope")
        newton = F.when(F.col("slope") > 0, F.col("lam") - F.col("over") / F.col("slope"))
        # Brackets that are still open are left geometrically, closed ones are halved.
        half = F.when(F.col("hi") >= 1e6, F.greatest(F.col("lo") * 2, F.lit(1.0))).when(F.col("lo") <= -1e6, F.least(F.col("hi") * 2, F.lit(-1.0))).otherwise((F.col("lo") + F.col("hi")) / 2)
        step = F.when(newton.isNotNull() & (newton > F.col("lo")) & (newton < F.col("hi")) & (F.abs(newton) < 1e6), newton).otherwise(half)
        gap = F.when(F.col("target") >= cap * F.col("total"), 0.0).otherwise(F.abs(F.col("over")) / F.greatest("target", F.lit(1.0)))
        state = materialize(x.select("source", "target", "total", "mean", F.when(gap > TOLERANCE, step).otherwise(F.col("lam")).alias("lam"), "lo", "hi", gap.alias("gap")), "mixing-dual")
        if (state.agg(F.max("gap")).first()[0] or 0.0) <= TOLERANCE:
            break
    else:
        raise RuntimeError(f"the rates did not reach the targets in {ROUNDS} rounds")
    full = F.when(F.col("target") >= cap * F.col("total"), F.lit(cap)).otherwise(F.least(F.exp(F.least(F.col("lam") * F.col("size") / F.col("mean"), F.lit(50.0))), F.lit(cap)))
    return cells.join(state.withColumnRenamed("source", "ss").hint("merge"), F.col("source").eqNullSafe(F.col("ss"))).select("source", "size", "n", "target", full.alias("rate"))


def round_copies(rated: DataFrame, cap: float = CAP) -> DataFrame:
    """``rated``: source, size, n, target, rate. Adds ``copies``: whole copies of the documents of a cell together. Going down the sizes,
    each cell takes what brings the tokens so far nearest to what the rates ask, so the error left is about half the
    smallest document. A group holds one row per size: as many as the longest document has words, at most."""

    def spread(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("size", ascending=False, kind="stable")
        wanted = taken = 0.0
        out = []
        for size, n, rate in zip(pdf["size"], pdf["n"], pdf["rate"]):
            wanted += size * n * rate
            k = min(max(round((wanted - taken) / size), int(n * min(int(rate), cap))), int(n * min(int(rate) + 1, cap)))
            taken += k * size
            out.append(k)
        # What rounding and the tolerance of the dual leave is mended upwards from the smallest documents.
        sizes, ns = pdf["size"].tolist(), pdf["n"].tolist()
        rest = (float(pdf["target"].iloc[0]) if len(pdf) else 0.0) - taken
        for j in range(len(out) - 1, -1, -1):
            if abs(rest) < sizes[j] / 2:
                break
            k = min(max(round(rest / sizes[j]), -out[j]), int(ns[j] * cap) - out[j])
            out[j] += k
            rest -= k * sizes[j]
        return pdf.assign(copies=out)[["source", "size", "n", "copies"]]

    return rated.groupBy("source").applyInPandas(spread, "source string, size bigint, n bigint, copies bigint")


def mix(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", cap: float = CAP) -> DataFrame:
    """One row per row of ``docs``: doc_id, h (text hash), size, source, source_size, target, copies.

    A null text has size 0 and no copies; a null source is a source; repeated rows count each and may get different copies.
    An empty table gives an empty result. The same table gives the same copies on every run."""
    sized = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(source).cast("string").alias("source"), n_words_of(F.col(text)).alias("size"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("h"))
    sized = materialize(sized, "mixing-sizes")
    targets = materialize(source_targets(sized), "mixing-targets")
    cells = sized.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n"))
    whole = round_copies(dual_rates(cells, targets, cap), cap)
    whole = materialize(whole.select(F.col("source").alias("cs"), F.col("size").alias("cz"), F.floor(F.col("copies") / F.col("n")).alias("each"), (F.col("copies") % F.col("n")).alias("extra")), "mixing-copies")
    # Which documents of a cell get the copy more: the first by hash. They are ranked within salted groups, whose counts are summed.
    order = F.xxhash64("doc_id", "h", F.lit(17))
    salted = sized.withColumns({"o": order, "salt": F.pmod(order, F.lit(SALTS)).cast("int")})
    sums = Window.partitionBy("bs", "bz").orderBy("bt").rowsBetween(Window.unboundedPreceding, -1)
    before = salted.groupBy(F.col("source").alias("bs"), F.col("size").alias("bz"), F.col("salt").alias("bt")).agg(F.count(F.lit(1)).alias("c")).withColumn("before", F.coalesce(F.sum("c").over(sums), F.lit(0))).drop("c")
    plan = before.join(whole.hint("merge"), F.col("bs").eqNullSafe(F.col("cs")) & (F.col("bz") == F.col("cz")), "left").drop("cs", "cz")
    plan = plan.join(targets.withColumnRenamed("source", "ts").hint("merge"), F.col("bs").eqNullSafe(F.col("ts")), "left").drop("ts")
    plan = materialize(plan, "mixing-plan")
    ranked = salted.withColumn("r", F.row_number().over(Window.partitionBy("source", "size", "salt").orderBy("o", "doc_id", "h")))
    out = ranked.join(plan.hint("merge"), F.col("source").eqNullSafe(F.col("bs")) & (F.col("size") == F.col("bz")) & (F.col("salt") == F.col("bt")))
    copies = F.coalesce(F.col("each") + F.when(F.col("before") + F.col("r") <= F.col("extra"), 1).otherwise(0), F.lit(0))
    return out.select("doc_id", "h", "size", "source", "source_size", "target", copies.cast("long").alias("copies"))


def apply_mix(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id") -> DataFrame:
    """The mixed corpus: every row of ``docs`` as often as the mix takes it, columns unchanged."""
    keys = lambda k, h, s: [F.coalesce(k, F.lit(-(2**63))).alias("k1"), h.alias("k2"), F.coalesce(F.concat(F.lit("s"), s), F.lit("n")).alias("k3")]
    plan = mix(docs, text, source, key).select(*keys(F.col("doc_id"), F.col("h"), F.col("source")), "copies")
    plan = materialize(plan.groupBy("k1", "k2", "k3").agg(F.sort_array(F.collect_list("copies"), asc=False).alias("copies")), "mixing-rows")
    row = docs.select(F.struct("*").alias("row"), *keys(F.col(key).cast("long"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))), F.col(source).cast("string")))
    out = row.join(plan.hint("merge"), ["k1", "k2", "k3"])
    # Rows that agree in all keys take the entries of the list in turn; the join has brought them together already.
    nth = F.row_number().over(Window.partitionBy("k1", "k2", "k3").orderBy(F.lit(1)))
    out = out.withColumn("take", F.get("copies", nth - 1)).filter(F.col("take") > 0)
    return out.select("row", F.explode(F.array_repeat(F.lit(1), F.col("take").cast("int")))).select("row.*")
