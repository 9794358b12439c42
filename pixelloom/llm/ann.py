"""Approximate nearest neighbours with a hash-prefix forest.

Each tree gives every vector a 64-bit string of signs of random projections; a tree is the sorted array of its strings. A query
descends to its longest prefix in every tree, then the trees ascend together, one bit at a time, until the entries below are as
many as asked for. The entries carry their vectors in one byte a component: with the rounding as a bound, those that cannot be among the nearest are left
out, and the rest are fetched once by id and compared exactly. The arrays are kept in cells (tree, leading bits, salts); the salts
split cells that hold many entries or are visited by many queries, so no task holds more than CELL and VISITS of them.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, release

BITS = 64
#: Entries of a cell in a task, and queries that visit it there.
CELL, VISITS = 20_000, 5_000
_U = np.uint64


def clean(vectors: DataFrame, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """vec_id, v (array of double) of the rows that take part: no null ids, null, empty or zero vectors, none with null or non-finite components."""
    v = F.col(vector).cast("array<double>")
    good = F.col(key).isNotNull() & F.col(vector).isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))) & F.exists(v, lambda x: x != 0)
    return vectors.filter(F.coalesce(good, F.lit(False))).select(F.col(key).cast("long").alias("vec_id"), v.alias("v"))


def _labels(v: np.ndarray, trees: int, seed: int) -> np.ndarray:
    """The bit strings of unit vectors: (n, trees)."""
    rng = np.random.default_rng(seed)
    out = np.empty((len(v), trees), np.uint64)
    weights = _U(1) << np.arange(BITS - 1, -1, -1, dtype=np.uint64)
    for t in range(trees):
        out[:, t] = ((v @ rng.standard_normal((v.shape[1], BITS))) > 0).astype(np.uint64) @ weights
    return out


def _depth(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common prefix of 64-bit strings."""
    x = a ^ b
    n = np.zeros(x.shape, np.int64)
    for s in (32, 16, 8, 4, 2, 1):
        small = x < (_U(1) << _U(BITS - s))
        n += np.where(small, s, 0)
        x = np.where(small, x << _U(s), x)
    return np.where(a == b, BITS, n)


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    a = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(a):
        return np.zeros((0, 0))
    return a.flatten().to_numpy(zero_copy_only=False).reshape(len(a), -1)


def _scores(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Cosines in double precision on the vectors as given: the dot product over the product of the norms."""
    return (q * v).sum(1) / (np.sqrt((q * q).sum(1)) * np.sqrt((v * v).sum(1)))


def _packed(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors in one byte a component, and the step of each."""
    step = np.abs(v).max(1) / 127
    return np.round(v / step[:, None]).astype(np.int8), step.astype(np.float32)


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, trees: int = 32, share: float = 0.65, least: int = 4000, prefix: int | None = None, seed: int = 5) -> DataFrame:
    """``vectors``, ``queries``: vec_id, v (from ``clean``; vectors that differ in length from that of the smallest id take no part). Returns query_id, rank, vec_id, score: the ``k`` nearest found.

    A query ascends until about ``max(least, share * n)`` entries lie below (an entry counts in each tree): the first trees come up to a depth and the others to the
    one below it. It does not go above the ``prefix`` bits that name a cell (default: so many that a cell of an even tree keeps over 1,000 entries, 5 at most,
    since near neighbours in high dimensions share few leading bits). Queries that found fewer than ``k`` are compared with
    all vectors, in blocks. Equal vectors are one entry with its ``k + 1`` smallest ids, which is all that a result can name; ids that stand twice count twice.
    Without vectors or queries the result is empty; other columns are ignored."""
    spark = vectors.sparkSession
    dim = vectors.agg(F.min_by(F.size("v"), "vec_id")).first()[0] or 0
    vectors, queries = vectors.filter(F.size("v") == dim), queries.filter(F.size("v") == dim)
    members = materialize(vectors.withColumn("nth", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).filter(F.col("nth") <= k + 1), "ann-members")
    members = materialize(members.withColumn("entry", F.min("vec_id").over(Window.partitionBy("v"))), "ann-classes")
    entries = materialize(members.filter(F.col("nth") == 1).select("entry", "v"), "ann-entries")
    n = entries.count()
    if prefix is None:
        prefix = int(max(0, min(5, np.floor(np.log2(max(n, 1) / 1000)))))
    wanted = int(max(least, share * n))

    def label(batches, full: bool):
        for b in batches:
            if not b.num_rows:
                continue
            v = _matrix(b.column(1))
            v = v / np.sqrt((v * v).sum(1, keepdims=True))
            rows = pa.array(np.repeat(np.arange(b.num_rows), trees))
            label_ = _labels(v, trees, seed).ravel()
            code, step = _packed(v)
            vector = pa.array(v.astype(np.float32).tolist() if full else [x.tobytes() for x in code], pa.list_(pa.float32()) if full else pa.binary())
            cols = [pa.array(np.tile(np.arange(trees, dtype=np.int32), b.num_rows)), pa.array((label_ >> _U(BITS - prefix)).astype(np.int32) if prefix else np.zeros(len(label_), np.int32)), pa.array(label_.view(np.int64)), b.column(0).take(rows), vector.take(rows)]
            yield pa.RecordBatch.from_arrays(cols if full else [*cols, pa.array(step).take(rows)], names=["tree", "cell", "label", "id", "v", *([] if full else ["step"])])

    schema = "tree int, cell int, label bigint, id bigint, v "
    index = entries.mapInArrow(lambda x: label(x, False), schema + "binary, step float")
    asked = materialize(queries.select("vec_id", "v").mapInArrow(lambda x: label(x, True), schema + "array<float>"), "ann-queries")
    # Crowded cells are split: the entries into salts that a query visits all, the queries into blocks that the entries are copied to.
    visitors = asked.groupBy(F.col("tree").alias("vt"), F.col("cell").alias("vc")).agg((F.count(F.lit(1)) / VISITS + 1).cast("int").alias("blocks"))
    cells = index.groupBy("tree", "cell").agg((F.count(F.lit(1)) / CELL + 1).cast("int").alias("salts"))
    cells = materialize(cells.join(visitors.hint("merge"), (F.col("tree") == F.col("vt")) & (F.col("cell") == F.col("vc"))).drop("vt", "vc"), "ann-cells")
    part = lambda c: F.pmod(F.xxhash64("id"), F.col(c).cast("long")).cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    index = index.join(cells.hint("merge"), ["tree", "cell"]).withColumn("salt", part("salts")).withColumn("block", every("blocks"))
    index = materialize(index.select("tree", "cell", "salt", "block", "label", "id", "v", "step"), "ann-forest")
    visits = asked.join(cells.hint("merge"), ["tree", "cell"]).withColumn("block", part("blocks")).withColumn("salt", every("salts"))
    visits = materialize(visits.select("tree", "cell", "salt", "block", "label", "id", "v"), "ann-visits")
    keys = ["tree", "cell", "salt", "block"]

    def descend(key, left: pa.Table, right: pa.Table) -> pa.Table:
        """How many entries of the cell lie at or below each depth of a query's path: two searches in the sorted array a depth."""
        tree = np.sort(left.column("label").to_numpy().view(np.uint64))
        q = right.column("label").to_numpy().view(np.uint64)
        out = []
        for d in range(prefix, BITS + 1):
            keep = ~_U(0) << _U(BITS - d) if d else _U(0)
            low = q & keep
            high = low | ~keep
            out.append(np.searchsorted(tree, high, "right") - np.searchsorted(tree, low, "left"))
            if not out[-1].any():
                break
        n = np.stack(out, 1) if out else np.zeros((len(q), 1), np.int64)
        r, d = np.nonzero(n)
        return pa.table({"id": right.column("id").to_numpy()[r], "depth": pa.array((d + prefix).astype(np.int32)), "n": pa.array(n[r, d].astype(np.int64))})

    profile = index.select(*keys, "label").groupBy(*keys).cogroup(visits.select(*keys, "label", "id").groupBy(*keys)).applyInArrow(descend, "id bigint, depth int, n bigint")
    profile = profile.groupBy("id", "depth").agg(F.sum("n").alias("n"))
    enough, depth = F.col("n") >= wanted, F.col("depth")
    ascent = profile.groupBy("id").agg(F.max(F.when(enough, depth)).alias("d"), F.min(F.when(enough, F.col("n"))).alias("up"), F.coalesce(F.max(F.when(~enough, F.col("n"))), F.lit(0)).alias("down"))
    # The trees that come up to depth d; the others stay one below.
    risen = F.ceil(trees * (wanted - F.col("down")) / (F.col("up") - F.col("down")))
    ascent = materialize(ascent.select(F.col("id").alias("aid"), F.coalesce("d", F.lit(prefix)).alias("depth"), F.coalesce(risen, F.lit(trees)).cast("int").alias("risen")), "ann-depths")

    def compare(key, left: pa.Table, right: pa.Table) -> pa.Table:
        """The entries below the depth of each query, with bounds of their scores; those that may be among the best of this cell are enough."""
        if not left.num_rows or not right.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "entry": pa.array([], pa.int64()), "low": pa.array([], pa.float64()), "high": pa.array([], pa.float64())})
        order = np.argsort(left.column("label").to_numpy().view(np.uint64), kind="stable")
        tree, entry = left.column("label").to_numpy().view(np.uint64)[order], left.column("id").to_numpy()[order]
        step = left.column("step").to_numpy()[order]
        v = np.frombuffer(b"".join(left.column("v").to_pylist()), np.int8).reshape(len(order), -1)[order].astype(np.float32) * step[:, None]
        slack = step * (np.sqrt(v.shape[1]) / 2) + 1e-5
        q, qid, qv, depth = right.column("label").to_numpy().view(np.uint64), right.column("id").to_numpy(), _matrix(right.column("v")), right.column("depth").to_numpy()
        out = []
        for j in range(len(q)):
            d = int(depth[j])
            keep = ~_U(0) << _U(BITS - d) if d else _U(0)
            a, b = np.searchsorted(tree, q[j] & keep, "left"), np.searchsorted(tree, (q[j] & keep) | ~keep, "right")
            if a == b:
                continue
            s = v[a:b] @ qv[j]
            best = np.arange(b - a)
            if b - a > k + 1:
                best = np.flatnonzero(s + slack[a:b] >= np.partition(s - slack[a:b], b - a - k - 1)[b - a - k - 1])
            out.append((np.full(len(best), qid[j]), entry[a:b][best], (s - slack[a:b])[best].astype(np.float64), (s + slack[a:b])[best].astype(np.float64)))
        cols = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0)]
        return pa.table(dict(zip(("query_id", "entry", "low", "high"), cols)))

    def exact(batches):
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(_scores(_matrix(b.column(2)), _matrix(b.column(3))))], names=["query_id", "entry", "score"])

    def settle(found: DataFrame) -> DataFrame:
        """Of the entries found by a query, those that may be among the best of all, compared exactly."""
        found = found.groupBy("query_id", "entry").agg(F.max("low").alias("low"), F.min("high").alias("high"))
        nth = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("low")))
        edge = F.min(F.when(F.col("nth") <= k + 1, F.col("low"))).over(Window.partitionBy("query_id"))
        few = materialize(found.withColumn("nth", nth).withColumn("edge", edge).filter(F.col("high") >= F.col("edge")).select("query_id", "entry"), "ann-found")
        sided = few.join(entries.hint("merge"), "entry").join(queries.select(F.col("vec_id").alias("query_id"), F.col("v").alias("qv")).distinct().hint("merge"), "query_id")
        return _expand(sided.select("query_id", "entry", "qv", "v").mapInArrow(exact, "query_id bigint, entry bigint, score double"), members, k)

    shape = "query_id bigint, entry bigint, low double, high double"
    deep = visits.join(ascent.hint("merge"), F.col("id") == F.col("aid")).withColumn("depth", F.col("depth") + (F.col("tree") >= F.col("risen")).cast("int")).drop("aid", "risen")
    found = index.groupBy(*keys).cogroup(deep.groupBy(*keys)).applyInArrow(compare, shape)
    top = materialize(settle(found), "ann-top")
    release(spark)
    # Queries with fewer than k results, although there are more vectors: all vectors, in blocks.
    full = top.groupBy("query_id").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") >= k).select("query_id")
    short = materialize(asked.filter("tree = 0").join(full.hint("merge"), F.col("id") == F.col("query_id"), "left_anti").select("id", "v"), "ann-short")
    if not short.limit(1).count():
        return top
    blocks = max(1, n // CELL)
    e = entries.mapInArrow(lambda x: label(x, False), schema + "binary, step float").filter("tree = 0").select(F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("cell"), F.lit(0).cast("bigint").alias("label"), "id", "v", "step")
    s = short.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("cell"), F.lit(0).cast("bigint").alias("label"), "id", "v", F.lit(0).alias("depth"))
    rest = settle(e.groupBy("cell").cogroup(s.groupBy("cell")).applyInArrow(compare, shape))
    return top.join(full.hint("merge"), "query_id", "left_semi").unionByName(rest)


def _expand(found: DataFrame, members: DataFrame, k: int) -> DataFrame:
    """From entries to ids: the best entries of a query, their members, without the query itself."""
    best = found.withColumn("e", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "entry"))).filter(F.col("e") <= 2 * k + 2)
    rows = best.join(members.select("entry", "vec_id").hint("merge"), "entry").filter(F.col("vec_id") != F.col("query_id"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
