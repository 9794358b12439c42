"""Run-log analytics: step windows, best so far, early stopping, retention, smoothing."""
from __future__ import annotations

from decimal import Decimal

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from ..sources.scratch import materialize
from . import sampling as S
from .sampling import in_blocks


def epoch_means(log: DataFrame) -> DataFrame:
    return log.groupBy("epoch").agg(F.avg("loss").alias("loss"))


def step_windows(log: DataFrame, every: int, *values: str) -> DataFrame:
    """Means over tumbling windows of ``every`` steps, aligned to step 0. A window whose last step is missing is not given; one that began
    late (after a resume) is."""
    w = log.withColumn("window", F.floor(F.col("step") / every))
    closed = F.max((F.col("step") + 1) % every == 0)
    out = w.groupBy("window").agg(*[F.avg(v).alias(v) for v in values], F.count(F.lit(1)).alias("n"), closed.alias("closed"), F.max(F.col("ts").cast("timestamp")).alias("closed_at"))
    return out.filter("closed").drop("closed")


def _running(rows: DataFrame, order: str, f, value: Column, upto: str, past: str) -> DataFrame:
    """Add the running ``f`` (min or max) of ``value`` along ``order``: ``upto`` with the row itself, ``past`` without it. Inside blocks of rows, and over one
    row for each block."""
    g = in_blocks(rows.withColumn("_v", value), [order])
    w = Window.partitionBy("_b").orderBy("_i")
    per = g.groupBy(F.col("_b").alias("_cb")).agg(f("_v").alias("_all"))
    carry = per.select("_cb", f("_all").over(Window.orderBy("_cb").rowsBetween(Window.unboundedPreceding, -1)).alias("_carry"))
    pick = F.least if f is F.min else F.greatest
    out = g.withColumns({upto: f("_v").over(w.rowsBetween(Window.unboundedPreceding, 0)), past: f("_v").over(w.rowsBetween(Window.unboundedPreceding, -1))}).join(carry.hint("merge"), F.col("_b") == F.col("_cb"))
    return out.withColumns({c: pick(F.col(c), F.col("_carry")) for c in (upto, past)}).drop("_i", "_b", "_v", "_cb", "_carry")


def throughput(windows: DataFrame, start: Column, batch: int) -> DataFrame:
    """Seconds per step and items per second of each window: from the close of the one before (the run's start for the first)."""
    g = in_blocks(windows, ["window"])
    ends = g.groupBy(F.col("_b").alias("_eb")).agg(F.max_by("closed_at", "_i").alias("_end"))
    carry = ends.select((F.col("_eb") + 1).alias("_eb"), "_end")
    out = g.withColumn("_before", F.lag("closed_at").over(Window.partitionBy("_b").orderBy("_i"))).join(carry.hint("merge"), F.col("_b") == F.col("_eb"), "left")
    seconds = (F.unix_micros("closed_at") - F.unix_micros(F.coalesce("_before", "_end", start))) / 1e6
    return out.withColumns({"seconds_per_step": F.try_divide(seconds, F.col("n")), "items_per_second": F.try_divide(batch * F.col("n"), seconds)}).drop("_i", "_b", "_before", "_eb", "_end")


def best_so_far(epochs: DataFrame, value: str, smaller: bool = True) -> DataFrame:
    """Add best (up to this epoch) and is_best: strictly better than all before."""
    out = _running(epochs, "epoch", F.min if smaller else F.max, F.col(value), "best", "_past")
    better = F.col(value) < F.col("_past") if smaller else F.col(value) > F.col("_past")
    return out.withColumn("is_best", F.coalesce(better, F.lit(True))).drop("_past")


def early_stop(epochs: DataFrame, value: str, patience: int) -> DataFrame:
    """The first epoch that comes ``patience`` epochs after the last strict improvement (null: none)."""
    b = _running(best_so_far(epochs, value), "epoch", F.max, F.when(F.col("is_best"), F.col("epoch")), "_last", "_past")
    return b.withColumn("since", F.col("epoch") - F.col("_last")).agg(F.min(F.when(F.col("since") >= patience, F.col("epoch"))).alias("stop_epoch"))


def numbered(names: DataFrame, name: str = "name") -> DataFrame:
    """Rows whose names are whole numbers, with the number."""
    return names.filter(F.col(name).rlike(r"^[0-9]+$")).withColumn("number", F.col(name).cast("bigint"))


def latest(names: DataFrame, name: str = "name") -> DataFrame:
    return numbered(names, name).agg(F.max_by(name, "number").alias("latest"))


def to_remove(names: DataFrame, limit: int, name: str = "name") -> DataFrame:
    """What goes before the next one is written, so that ``limit`` stay with it. The newest are found as a top-k."""
    keep = numbered(names, name).orderBy(F.desc("number")).limit(max(limit - 1, 0)).select(name)
    return numbered(names, name).join(keep, name, "left_anti")


def periodic(log: DataFrame, every: int) -> DataFrame:
    """Every n-th step and the last one."""
    last = log.agg(F.max("step").alias("last"))
    return log.join(F.broadcast(last), ((F.col("step") + 1) % every == 0) | (F.col("step") == F.col("last"))).drop("last")


def _floats(column: pa.Array) -> list[float]:
    """The doubles of a column; a null is NaN."""
    return column.to_numpy(zero_copy_only=False).astype(float).tolist()


def _scanned(key: str):
    """A task's rows, in order, behind which stand _a, _c and _s: x = _a * x + _c within each key, whose first row has _s. Instead of these come _i, the row's place in the task,
    _first (its key is the task's first one), _v (x, if nothing came before the task) and, on the task's last row, _end with _ea and _ec, the one step that
    all rows of the last key come to."""

    def run(batches):
        began, lead, n, now, fa, fc, v, held = False, True, 0, None, 0.0, 0.0, 0.0, None

        def out(last: bool) -> pa.RecordBatch:
            b, firsts, values = held
            k = b.num_rows
            at_end = lambda x: [None] * (k - 1) + [x if last else None]
            more = {"_i": pa.array(range(n - k, n), pa.int64()), "_first": pa.array(firsts, pa.bool_()), "_v": pa.array(values, pa.float64(), from_pandas=True), "_end": pa.array(at_end(True), pa.bool_()),
                    "_ea": pa.array(at_end(fa), pa.float64(), from_pandas=True), "_ec": pa.array(at_end(fc), pa.float64(), from_pandas=True)}
            return pa.RecordBatch.from_arrays([*b.columns[:-3], *more.values()], names=[*b.schema.names[:-3], *more])

        for b in batches:
            if not b.num_rows:
                continue
            if held:
                yield out(False)
            firsts, values = [], []
            for k, ak, ck, sk in zip(b.column(key).to_pylist(), *map(_floats, b.columns[-3:])):
                if began and k == now:
                    fa, fc, v = fa * ak, ak * fc + ck, ak * v + ck
                else:
                    lead, began, now = not began, True, k
                    fa, fc, v = ak, ck, sk
                firsts.append(lead)
                values.append(v)
            held, n = (b, firsts, values), n + b.num_rows
        if held:
            yield out(True)

    return run


def _continued(t: pa.Table) -> pa.Table:
    """Rows of one key and block, which _x came before: _v of each, in place of _i, _x, _a, _c and _b, the last columns."""
    t = t.sort_by("_i")
    x, values = _floats(t.column("_x").slice(0, 1).combine_chunks())[0], []
    for a, c in zip(*(_floats(t.column(n).combine_chunks()) for n in ("_a", "_c"))):
        x = a * x + c
        values.append(x)
    return t.select(t.column_names[:-5]).append_column("_v", pa.array(values, pa.float64(), from_pandas=True))


def _with(rows: DataFrame, **more: str) -> StructType:
    kind = StructType(list(rows.schema.fields))
    for name, of in more.items():
        kind.add(name, of)
    return kind


def affine_scan(rows: DataFrame, key: str, order: str, a: Column, c: Column, start: Column) -> DataFrame:
    """Add _v: x = a * x + c along ``order`` for each ``key``; the first row of a key has ``start``.

    The rows are dealt to blocks, ranges of (key, order), and every task runs along its own. Only the first key of a block can have begun before it. As such steps can be put
    together before they are applied, the last key of every block comes to one step; these, a row for each block, are scanned in the same way, and with the value that so enters a
    block the rows of its first key run once more. So a series of any length is spread over many tasks, and a short one is computed step by step."""
    blocks = max(1, min(-(-rows.count() // S.BLOCK), S.MOST_RANGES))
    steps = rows.withColumns({"_b": F.lit(0).cast("long"), "_a": a.cast("double"), "_c": c.cast("double"), "_s": start.cast("double")})
    dealt = steps.repartitionByRange(blocks, key, order).sortWithinPartitions(key, order).withColumn("_b", F.spark_partition_id().cast("long"))
    done = dealt.mapInArrow(_scanned(key), _with(rows, _b="long", _i="long", _first="boolean", _v="double", _end="boolean", _ea="double", _ec="double"))
    if blocks == 1:
        return done.select(*rows.columns, "_v")
    done = materialize(done, "scan-blocks")
    ends = done.filter("_end").select(F.col(key).alias("k"), F.col("_b").alias("at"), F.col("_ea").alias("sa"), F.col("_ec").alias("sc"), F.col("_v").alias("ss"))
    after = affine_scan(ends, "k", "at", F.col("sa"), F.col("sc"), F.col("ss"))
    # The block before has a key's value, if the key began before. One row for each block, few beside the rows.
    after = materialize(after.select(F.col("k").alias("_ek"), (F.col("at") + 1).alias("_eb"), F.col("_v").alias("_x"), F.lit(True).alias("_enters")), "scan-entries")
    met = done.join(F.broadcast(after), (F.col("_b") == F.col("_eb")) & F.col("_first") & F.col(key).eqNullSafe(F.col("_ek")), "left")
    own = met.filter(F.col("_enters").isNull()).select(*rows.columns, "_v")
    again = met.filter("_enters").select(*rows.columns, "_i", "_x", a.cast("double").alias("_a"), c.cast("double").alias("_c"), "_b")
    return own.unionByName(again.groupBy("_b").applyInArrow(_continued, _with(rows, _v="double")))


def ema(series: DataFrame, key: str, order: str, value: str, decay: float) -> DataFrame:
    """Add ema to every point: the exponential moving average of its key's series up to it, which begins with the first value. Series of any length; points of one
    order stand in any order; a null key is a key; a null value makes the averages from there on null."""
    v = F.col(value).cast("double")
    return affine_scan(series, key, order, F.lit(float(decay)), v * float(1 - Decimal(str(decay))), v).withColumnRenamed("_v", "ema")
