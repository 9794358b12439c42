"""SimHash near-dedup by meet-in-the-middle ball hashing.

Two fingerprints within distance ``2 * half`` share a variant: a value within ``half`` bits of both. Every fingerprint goes to the buckets
that its variants fall in (a bucket is the leading bits of a variant), and the variants themselves are made inside the bucket's
task, so a fingerprint is shuffled to dozens of buckets and not as thousands of variants. Equal variants prove a link; each
bucket reports a spanning forest of its links. Linked fingerprints are joined into components by contraction.

``near_duplicates`` links documents by one SimHash of their shingles. ``copy_groups`` finds texts by the overlap of their shingle sets: the same
balls, over several fingerprints whose bits come from min-hashes, give the candidates, and the shingle sets decide.
"""
from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import discard_tables, materialize, release

BITS = 64
#: Fingerprints of a bucket, on average: the number of leading bits that name a bucket follows from it, 8 at least.
BUCKET = 1024
#: Variants that a task holds at a time; a fuller bucket is split by more leading bits.
MOST_VARIANTS = 4_000_000
#: Bytes that a task makes at a time when it copies rows to their buckets.
SPREAD_BYTES = 8 << 20
_U = np.uint64


def fingerprint(text: bytes, k: int) -> int:
    """SimHash of the k-word shingles (repeats included) of a text whose A-Z are lower-cased here; 0 without words."""
    words = text.lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= k:
        return xxhash.xxh64_intdigest(line, 42)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(line[a:b], 42) for a, b in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist())], np.uint64)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(h), 1 << 16):
        block = h[at : at + (1 << 16)]
        ones += np.add.reduce(np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"), axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, k: int = 4, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long) of every row. A null text is empty and has fingerprint 0."""

    def run(batches):
        for b in batches:
            fps = np.array([fingerprint(t, k) for t in b.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("t")).mapInArrow(run, "doc_id bigint, fp bigint")


def _masks(bits: int, most: int, shift: int = 0) -> list[np.ndarray]:
    """Masks with exactly 0, 1, .. ``most`` of ``bits`` bits set, starting at ``shift``."""
    return [np.array([sum(1 << (shift + i) for i in c) for c in combinations(range(bits), n)], np.uint64) for n in range(most + 1)]


def _root(parent: list[int], a: int) -> int:
    while parent[a] != a:
        parent[a] = parent[parent[a]]
        a = parent[a]
    return a


def _variants(fps: np.ndarray, bucket: int, prefix: int, half: int, bits: int):
    """The variants of ``fps`` whose leading ``prefix`` bits are ``bucket``, in parts: sorted variants, and for each the number of its fingerprint. Equal variants are in one part."""
    low = bits - prefix
    spent = np.bitwise_count((fps >> _U(low)) ^ _U(bucket)).astype(np.int64)
    near = np.flatnonzero(spent <= half)
    fps, spent = fps[near], spent[near]
    if len(fps) < 2:
        return
    masks = _masks(low, half)
    sizes = np.cumsum([len(m) for m in masks])
    if sizes[half - spent].sum() > MOST_VARIANTS and low >= 4:
        for sub in range(16):
            for v, w in _variants(fps, (bucket << 4) | sub, prefix + 4, half, bits):
                yield v, near[w]
        return
    tail = fps & _U((1 << low) - 1)
    made, who = [], []
    for s in range(half + 1):
        sel = np.flatnonzero(spent == s)
        if len(sel):
            flips = np.concatenate(masks[: half - s + 1])
            made.append((tail[sel][:, None] ^ flips[None, :]).ravel())
            who.append(np.repeat(sel, len(flips)))
    v, w = np.concatenate(made), np.concatenate(who)
    width = len(fps).bit_length()
    if low + width <= 64:
        v = np.sort((v << _U(width)) | w.astype(np.uint64))
        v, w = v >> _U(width), (v & _U((1 << width) - 1)).astype(np.int64)
    else:
        order = np.argsort(v, kind="stable")
        v, w = v[order], w[order]
    yield v, near[w]


def _meetings(fps: np.ndarray, ids: np.ndarray, bucket: int, prefix: int, half: int, bits: int, groups: np.ndarray | None = None):
    """Pairs (arrays of numbers from ``ids``) of ``fps`` that share a variant whose leading ``prefix`` bits are ``bucket``: of each variant its hub with every
    other, with the hub's weight, or with ``groups`` (by number) all pairs of different groups. A fingerprint weighs as much as it shares variants
    with others, so that the middle of a crowd becomes a hub."""
    for v, w in _variants(fps, bucket, prefix, half, bits):
        d, same = 1, v[1:] == v[:-1]
        if groups is None:
            twin = np.concatenate(([False], same)) | np.concatenate((same, [False]))
            v, w = v[twin], w[twin]
            if len(v):
                starts = np.flatnonzero(np.concatenate(([True], v[1:] != v[:-1])))
                size = np.diff(np.concatenate((starts, [len(v)])))
                weight = np.bincount(w, weights=np.repeat(size - 1, size), minlength=len(fps))
                top = np.repeat(np.maximum.reduceat(weight[w], starts), size)
                hub = np.repeat(np.minimum.reduceat(np.where(weight[w] == top, w, len(fps)), starts), size)
                other = w != hub
                yield ids[hub[other]], ids[w[other]], top[other]
            continue
        while same.any():
            a, b = ids[w[:-d][same]], ids[w[d:][same]]
            apart = groups[a] != groups[b]
            yield a[apart], b[apart]
            d += 1
            same = v[d:] == v[:-d]


def _middle(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """A variant half way between fingerprints: the smaller one with the lower half of the differing bits of the other."""
    x, y = np.minimum(x, y), np.maximum(x, y)
    rest = x ^ y
    take = (np.bitwise_count(rest).astype(np.int64) + 1) // 2
    for k in range(int(take.max(initial=0))):
        low = rest & (~rest + _U(1))
        x = np.where(take > k, x ^ low, x)
        rest ^= low
    return x


def _unique_pairs(meetings) -> np.ndarray:
    """Distinct (smaller, larger) pairs."""
    found = [np.unique(np.minimum(a, b) << 32 | np.maximum(a, b)) for a, b in meetings]
    key = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
    return np.stack((key >> 32, key & 0xFFFFFFFF), 1)


def _forest(n: int, meetings) -> np.ndarray:
    """Of the pairs among ``n`` numbers, those of heavy hubs first, the ones that join two trees."""
    found = list(meetings)
    if not found:
        return np.zeros((0, 2), np.int64)
    a, b, weight = (np.concatenate(x) for x in zip(*found))
    order = np.argsort(-weight, kind="stable")
    key = (np.minimum(a, b) << 32 | np.maximum(a, b))[order]
    _, first = np.unique(key, return_index=True)
    key = key[np.sort(first)]
    parent, edges = list(range(n)), []
    for a, b in zip((key >> 32).tolist(), (key & 0xFFFFFFFF).tolist()):
        x, y = _root(parent, a), _root(parent, b)
        if x != y:
            parent[max(x, y)] = min(x, y)
            edges.append((a, b))
    return np.array(edges, np.int64).reshape(-1, 2)


def _apart(fps: np.ndarray, g: np.ndarray, bucket: int, prefix: int, half: int, bits: int):
    """Meetings (one, other, other's weight) of numbers of ``fps`` of different ``g``: of each variant its hub with those of other groups, those of the hub's own group
    with the heaviest of other groups, and each with the next. Weights are those of ``_meetings``; at most three meetings are made of a variant."""
    n = len(fps)
    for v, w in _variants(fps, bucket, prefix, half, bits):
        same = v[1:] == v[:-1]
        twin = np.concatenate(([False], same)) | np.concatenate((same, [False]))
        v, w = v[twin], w[twin]
        if len(v):
            starts = np.flatnonzero(np.concatenate(([True], v[1:] != v[:-1])))
            size = np.diff(np.concatenate((starts, [len(v)])))
            weight = np.bincount(w, weights=np.repeat(size - 1, size), minlength=n).astype(np.int64)

            def heaviest(of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
                top = np.repeat(np.maximum.reduceat(of, starts), size)
                return top, np.repeat(np.minimum.reduceat(np.where(of == top, w, n), starts), size)

            top, hub = heaviest(weight[w])
            out = g[w] != g[hub]
            yield w[out], hub[out], top[out]
            top, hub = heaviest(np.where(out, weight[w], -1))
            own = ~out & (top >= 0)
            yield w[own], hub[own], top[own]
            a, b = (x[(v[1:] == v[:-1]) & (g[w[1:]] != g[w[:-1]])] for x in (w[:-1], w[1:]))
            yield a, b, weight[b]
            yield b, a, weight[a]


def _near(meetings, every: np.ndarray):
    """The meetings with other weights: bits in which the fingerprints of all tables (the rows of ``every``) agree."""
    for a, b, _ in meetings:
        key = np.unique(a << 32 | b)
        for at in range(0, len(key), 100_000):
            a, b = key[at : at + 100_000] >> 32, key[at : at + 100_000] & 0xFFFFFFFF
            yield a, b, BITS * every.shape[1] - np.bitwise_count(every[a] ^ every[b]).sum(1, dtype=np.int64)


def _heaviest(n: int, meetings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the meetings (one, other, weight) among ``n`` numbers, for every number that takes part its heaviest (of these the smallest) other: number, other, weight."""
    weight, meets = np.full(n, -1, np.int64), np.full(n, n, np.int64)
    for a, b, w in meetings:
        before = weight.copy()
        np.maximum.at(weight, a, w)
        meets[weight > before] = n
        best = w == weight[a]
        np.minimum.at(meets, a[best], b[best])
    took = np.flatnonzero(weight >= 0)
    return took, meets[took], weight[took]


def _pieces(b: pa.RecordBatch, times: int):
    """The batch in pieces of which ``times`` copies hold SPREAD_BYTES at most (or one row)."""
    if b.num_rows > 1 and b.nbytes * times > SPREAD_BYTES:
        for piece in (b.slice(0, b.num_rows // 2), b.slice(b.num_rows // 2)):
            yield from _pieces(piece, times)
    elif b.num_rows:
        yield b


def _spreader(prefix: int, half: int, bits: int):
    """Batches of t, fp and other columns -> batches of bucket, fp and the others, a row for each bucket. A row may be wide, so what is copied at a time is bounded by bytes."""
    tops = np.concatenate(_masks(prefix, half))

    def spread(batches):
        for b in (piece for whole in batches for piece in _pieces(whole, len(tops))):
            t, fp = (b.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            buckets = ((fp.view(np.uint64) >> _U(bits - prefix))[:, None] ^ tops[None, :]).ravel()
            key = np.repeat(t.astype(np.int64) << 40, len(tops)) | buckets.view(np.int64)  # table and bucket in one number
            rows = pa.array(np.repeat(np.arange(b.num_rows), len(tops)))
            yield pa.RecordBatch.from_arrays([pa.array(key), *(c.take(rows) for c in b.columns[1:])], names=["bucket", *b.schema.names[1:]])

    return spread


def _spread(prints: DataFrame, half: int, bits: int) -> tuple[DataFrame, int]:
    """``prints``: t (number of a table of fingerprints), fp, and other columns. A row (bucket, fp, others) for each bucket that the variants of fp
    fall in, where a bucket is a table and leading bits; and the number of leading bits."""
    n = prints.groupBy("t").count().agg(F.max("count")).first()[0] or 0
    prefix = max(8, int(np.ceil(np.log2(max(n, 1) / BUCKET))))
    others = [c for c in prints.columns if c not in ("t", "fp")]
    kind = "bucket bigint, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in prints.select("fp", *others).schema)
    return prints.select("t", "fp", *others).mapInArrow(_spreader(prefix, half, bits), kind), prefix


def links(fps: DataFrame, half: int = 2, bits: int = BITS) -> DataFrame:
    """``fps``: distinct (t, fp), t the number of a table of fingerprints of ``bits`` bits. Edges (t, a, b) of a table, a < b as signed longs, that join every
    pair within ``2 * half`` bits to one component; an edge stands for a chain of such pairs."""
    rows, prefix = _spread(fps.select("t", "fp"), half, bits)

    def meet(key: tuple, table: pa.Table) -> pa.Table:
        f = np.sort(table.column("fp").to_numpy()).view(np.uint64)
        bucket = key[0].as_py()
        edges = _forest(len(f), _meetings(f, np.arange(len(f)), bucket & ((1 << 40) - 1), prefix, half, bits))
        s = f.view(np.int64)
        return pa.table({"t": pa.array(np.full(len(edges), bucket >> 40, np.int32)), "a": pa.array(s[edges[:, 0]]), "b": pa.array(s[edges[:, 1]])})

    return rows.groupBy("bucket").applyInArrow(meet, "t int, a bigint, b bigint")


def hubs(marked: DataFrame, half: int, bits: int) -> DataFrame:
    """``marked``: t, fp, and th and g; without these every fingerprint is its own th and g; and fps (the fingerprints of all tables) or none. Of every (t, th) that lies within
    ``2 * half`` bits of one of another g in its table one row (t, th, hub): of those of another g that it meets as hub or neighbour in a variant the heaviest, with
    fps the nearest by them. So there are no more rows than fingerprints, however large a crowd is, and every g is there that has a candidate of another g."""
    rows, prefix = _spread(marked, half, bits)

    def meet(key: tuple, table: pa.Table) -> pa.Table:
        table, bucket = table.sort_by([(c, "ascending") for c in table.column_names if c in ("fp", "th")]), key[0].as_py()
        f = table.column("fp").to_numpy()
        th, g = (table.column(c).to_numpy() if c in table.column_names else f for c in ("th", "g"))
        meetings = _apart(f.view(np.uint64), g, bucket & ((1 << 40) - 1), prefix, half, bits)
        if "fps" in table.column_names:
            meetings = _near(meetings, table.column("fps").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(len(f), -1))
        a, b, weight = _heaviest(len(f), meetings)
        return pa.table({"t": pa.array(np.full(len(a), bucket >> 40, np.int32)), "th": pa.array(th[a]), "hub": pa.array(th[b]), "weight": pa.array(weight)})

    found = rows.groupBy("bucket").applyInArrow(meet, "t int, th bigint, hub bigint, weight bigint")
    return found.groupBy("t", "th").agg(F.max(F.struct("weight", "hub")).alias("m")).select("t", "th", "m.hub")


def parities(values: np.ndarray) -> np.ndarray:
    """A bit for each class of hashes (of a set, by their trailing bits): whether the set has an odd number of them. Bits in which two sets differ are no more than
    the members that only one of them has, however large what they share. Words of 64 bits, a power of two of them and three bits a member at least,
    up to MOST_PARITY words; folded in half by exclusive or, they are those of half as many classes."""
    words = 1
    while 64 * words < 3 * len(values) and words < MOST_PARITY:
        words *= 2
    odd = np.bincount((values & _U(64 * words - 1)).astype(np.int64), minlength=64 * words) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


class _Parities:
    """The parities of many sets, of different lengths, for comparing pairs of them."""

    def __init__(self, rows: pa.ListArray, size: np.ndarray, similarity: float):
        self.size, self.similarity, self.at = size, similarity, {}
        flat, ends = rows.flatten().to_numpy(zero_copy_only=False).view(np.uint64), np.cumsum(rows.value_lengths().to_numpy(zero_copy_only=False))
        self.length = np.diff(np.concatenate(([0], ends)))
        folded = None
        for n in np.unique(self.length)[::-1].tolist():
            own = np.flatnonzero(self.length == n)
            part = flat[(ends[own] - n)[:, None] + np.arange(n)]
            if folded is not None:
                who, longer = folded
                while longer.shape[1] > n:
                    longer = longer[:, : longer.shape[1] // 2] ^ longer[:, longer.shape[1] // 2 :]
                own, part = np.concatenate((who, own)), np.concatenate((longer, part))
            folded = own, part
            place = np.full(len(size), -1)
            place[own] = np.arange(len(own))
            self.at[n] = place, part

    def may_overlap(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """False for pairs whose overlap (Jaccard) is below ``similarity`` for certain."""
        a, b = self.size[x], self.size[y]
        ok = np.minimum(a, b) >= self.similarity * np.maximum(a, b)
        level = np.minimum(self.length[x], self.length[y])
        for n, (place, part) in self.at.items():
            k = np.flatnonzero(ok & (level == n))
            apart = np.bitwise_count(part[place[x[k]]] ^ part[place[y[k]]]).sum(1, dtype=np.int64)
            # Sets that differ in d members share (a + b - d) / 2, of (a + b + d) / 2 in all.
            ok[k] = a[k] + b[k] - apart >= self.similarity * (a[k] + b[k] + apart)
        return ok


def rivals(marked: DataFrame, half: int, bits: int, most: int, similarity: float) -> DataFrame:
    """``marked``: t, fp, th, g, fps (the fingerprints of all tables), size (members of the set) and sk (their ``parities``). The pairs (a, b) of th, a < b, of different g
    whose fingerprints lie within ``2 * half`` bits in a table and within ``most`` bits in all together, but those whose parities rule out an overlap of ``similarity``. A pair is
    given in the first such table, by the bucket of one variant that both ends agree on."""
    rows, prefix = _spread(marked, half, bits)

    def meet(key: tuple, table: pa.Table) -> pa.Table:
        f, th, g, size = (table.column(c).to_numpy() for c in ("fp", "th", "g", "size"))
        every = table.column("fps").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(len(f), -1)
        sets = _Parities(table.column("sk").combine_chunks(), size, similarity)
        t, bucket = key[0].as_py() >> 40, key[0].as_py() & ((1 << 40) - 1)

        def near():
            for a, b in _meetings(f.view(np.uint64), np.arange(len(f)), bucket, prefix, half, bits, g):
                for at in range(0, len(a), 100_000):
                    x, y = a[at : at + 100_000], b[at : at + 100_000]
                    far = np.bitwise_count(every[x] ^ every[y])
                    ok = (far.sum(1, dtype=np.int64) <= most) & (np.argmax(far <= 2 * half, axis=1) == t) & (_middle(every[x, t], every[y, t]) >> _U(bits - prefix) == _U(bucket))
                    x, y = x[ok], y[ok]
                    ok = sets.may_overlap(x, y)
                    yield x[ok], y[ok]

        pairs = _unique_pairs(near())
        x, y = th[pairs[:, 0]], th[pairs[:, 1]]
        return pa.table({"a": pa.array(np.minimum(x, y)), "b": pa.array(np.maximum(x, y))})

    return rows.groupBy("bucket").applyInArrow(meet, "a bigint, b bigint")


def components(edges: DataFrame) -> DataFrame:
    """``edges``: a, b. Returns (node, root): the component of every node that has an edge. Each round points every node to its smallest
    neighbour, jumps pointers to the ends, and contracts; a written table ends every step, so no lineage grows."""
    spark = edges.sparkSession
    e = materialize(edges.filter(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "cc-edges")
    levels = []
    while e.count():
        both = e.select(F.col("a").alias("x"), F.col("b").alias("y")).unionByName(e.select(F.col("b").alias("x"), F.col("a").alias("y")))
        p = materialize(both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("p")), "cc-parents")
        while True:
            q = p.select(F.col("x").alias("qx"), F.col("p").alias("qp"))
            p2 = materialize(p.join(q.hint("merge"), F.col("p") == F.col("qx"), "left").select("x", F.coalesce("qp", "p").alias("p"), (F.coalesce("qp", "p") != F.col("p")).alias("moved")), "cc-parents")
            moved = p2.filter("moved").limit(1).count()
            p = p2.drop("moved")
            if not moved:
                break
        levels.append(p)
        for side in ("a", "b"):
            e = e.join(p.select(F.col("x").alias("px"), F.col("p").alias("pp")).hint("merge"), F.col(side) == F.col("px")).withColumn(side, F.col("pp")).drop("px", "pp")
        e = materialize(e.filter(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "cc-edges")
    if not levels:
        return spark.createDataFrame([], "node bigint, root bigint")
    out = levels[0].select(F.col("x").alias("node"), F.col("p").alias("root"))
    for p in levels[1:]:
        out = out.join(p.hint("merge"), F.col("root") == F.col("x"), "left").select("node", F.coalesce("p", "root").alias("root"))
    return materialize(out, "cc-roots")


def near_duplicates(docs: DataFrame, k: int = 5, half: int = 2, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: doc_id, fp, component_id (the smallest doc_id of all documents that links of at most
    ``2 * half`` differing bits reach, itself included).

    Documents without words share fingerprint 0. A null doc_id takes part but is no component's id unless all its members are null.
    Repeated rows are returned as often as they stand; other columns are ignored; an empty table gives an empty result."""
    marked = materialize(fingerprints(docs, k, text, key), "simhash-fingerprints")
    classes = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-classes")
    roots = components(links(classes.select(F.lit(0).alias("t"), "fp"), half))
    release(docs.sparkSession)
    joined = classes.join(roots.hint("merge"), F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    table = materialize(_labelled(joined, "component_id").select(F.col("fp").alias("cfp"), "component_id"), "simhash-labels")
    return marked.join(table.hint("merge"), F.col("fp") == F.col("cfp")).select("doc_id", "fp", "component_id")


def _labelled(joined: DataFrame, name: str) -> DataFrame:
    """``joined``: root, first, and more. Adds the smallest ``first`` of each root. The labels are written, so that the join's other side, where one root
    may stand in most rows, is a shuffle of its own, which Spark can split."""
    joined = materialize(joined, "simhash-joined")
    label = materialize(joined.groupBy("root").agg(F.min("first").alias(name)), "simhash-roots")
    return joined.join(label.hint("merge"), "root")


#: Words of parities of a set, at most: of sets up to 10,000 members they tell overlaps of 0.75 from those of 0.8, and of larger ones fewer and fewer.
MOST_PARITY = 512
#: Near copies are texts whose sets of five-word shingles overlap (Jaccard) by SIMILARITY or more. Their fingerprints have one bit for each of PRINT_BITS
#: min-hashes of the shingles, so that a bit differs with probability (1 - overlap) / 2 wherever the edits lie. Candidates lie within four bits
#: in one of TABLES such fingerprints: of pairs that overlap by 0.8, all but 0.53 ** 12 = 5 in 10,000; of those by 0.85, all but one in a million. In crowds they also
#: lie within ALL_BITS in all the fingerprints together: the 58 bits expected at 0.8 and six standard deviations, which 2 in 1,000,000,000 pairs exceed.
SHINGLE, SIMILARITY = 5, 0.8
TABLES, PRINT_BITS, ALL_BITS = 12, 48, 104
#: Times that the groups of a crowd are compared by hubs, before all the candidates that are left are.
ROUNDS = 3
_FACTORS = np.random.default_rng(17).integers(0, 2**31, (TABLES * PRINT_BITS, 1), np.uint32) * np.uint32(2) + np.uint32(1)
_SPREAD = np.uint32(0x9E3779B1)


def _shingles(words: list[bytes]) -> np.ndarray:
    """Sorted distinct hashes of the five-word shingles (of the whole text if it is shorter)."""
    n = max(1, len(words) - SHINGLE + 1) if words else 0
    return np.unique(np.array([xxhash.xxh64_intdigest(b" ".join(words[i : i + SHINGLE]), 7) for i in range(n)], np.uint64))


def _prints(shingles: np.ndarray) -> np.ndarray:
    """The fingerprints of a set of shingles, one of each table."""
    x = (shingles >> _U(32)).astype(np.uint32)
    least = np.full(TABLES * PRINT_BITS, 2**32 - 1, np.uint32)
    for at in range(0, len(x), 512):
        least = np.minimum(least, (_FACTORS * x[None, at : at + 512]).min(axis=1))
    bit = ((least ^ (least >> np.uint32(15))) * _SPREAD >> np.uint32(31)).astype(np.uint64).reshape(TABLES, PRINT_BITS)
    return (bit << np.arange(PRINT_BITS, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)


def _pairs(a: str, b: str, rows: DataFrame) -> DataFrame:
    return rows.filter(F.col(a) != F.col(b)).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))


def _rooted(rows: DataFrame, on: str, roots: DataFrame, name: str) -> DataFrame:
    """Add the root of the node ``on`` (itself without edges)."""
    r = roots.select(F.col("node").alias("rn"), F.col("root").alias("rr"))
    return rows.join(r.hint("merge"), F.col(on) == F.col("rn"), "left").withColumn(name, F.coalesce("rr", on)).drop("rn", "rr")


def _group_pairs(pairs: DataFrame, live: DataFrame) -> DataFrame:
    """The pairs of different groups (a, b) of the pairs' ends. ``live``: th, g."""
    sides = [live.select(F.col("th").alias(c), F.col("g").alias(f"g{c}")).hint("merge") for c in ("a", "b")]
    return _pairs("ga", "gb", pairs.join(sides[0], "a").join(sides[1], "b")).distinct()


def copy_groups(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, th (hash of the lower-cased words), group_id of every row of ``docs``: documents whose words are equal, or whose shingle sets
    overlap by SIMILARITY or more in a chain of candidate pairs, share the smallest doc_id as group_id.

    Texts of equal words are one class. Classes of one fingerprint, and fingerprints within a ball, are candidates, and a candidate is a
    copy if the shingle sets prove it. Every fingerprint is compared with the heaviest hub of its balls first, and of the classes of one
    fingerprint each with the smallest, so that these pairs are a few a class in the largest crowd, too; then groups with the hubs of others; then all candidate pairs that this has
    not brought into one group and whose parities do not rule the overlap out, so none is left out. Documents without words are no copies of each other.
    Null ids take part; a group of null ids alone has a null group_id. Repeated rows are returned as often as they stand; other columns
    are ignored; an empty table gives an empty result."""
    spark = docs.sparkSession

    def prints(batches):
        for b in batches:
            th, fps = [], []
            for t in b.column(1).to_pylist():
                words = t.lower().split()
                th.append(xxhash.xxh64_intdigest(b" ".join(words), 3) if words else None)
                fps.append(_prints(_shingles(words)).view(np.int64) if words else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([None if x is None else x - (1 << 64) * (x >> 63) for x in th], pa.int64()), pa.array(fps, pa.list_(pa.int64()))], names=["doc_id", "th", "fps"])

    body = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("t"))
    marked = materialize(body.mapInArrow(prints, "doc_id bigint, th bigint, fps array<bigint>"), "copies-prints")
    worded = marked.filter(F.col("th").isNotNull())
    classes = materialize(worded.groupBy("th").agg(F.min("doc_id").alias("first"), F.any_value("fps").alias("fps")), "copies-classes")
    keyed = classes.select("th", F.posexplode("fps").alias("t", "fp"))
    balls = materialize(keyed.groupBy("t", "fp").agg(F.min("th").alias("head"), F.max("th").alias("top")), "copies-balls")
    shared = balls.filter("head != top").select("t", "fp", "head")
    met = materialize(hubs(balls.select("t", "fp"), 2, PRINT_BITS), "copies-hubs")
    ends = [balls.select("t", F.col("fp").alias(x), F.col("head").alias(f"h{x}")).hint("merge") for x in ("th", "hub")]
    pairs = _pairs("hth", "hhub", met.join(ends[0], ["t", "th"]).join(ends[1], ["t", "hub"]))
    pairs = materialize(pairs.unionByName(_pairs("head", "th", keyed.join(shared.hint("merge"), ["t", "fp"]))).distinct(), "copies-candidates")
    release(spark)
    nodes = materialize(pairs.select(F.explode(F.array("a", "b")).alias("n")).distinct(), "copies-nodes")

    def sets(batches):
        for b in batches:
            th, rows, size, odd = [], [], [], []
            for t in b.column(0).to_pylist():
                words = t.lower().split()
                x = xxhash.xxh64_intdigest(b" ".join(words), 3)
                th.append(x - (1 << 64) * (x >> 63))
                s = _shingles(words)
                rows.append(s.tobytes())
                size.append(len(s))
                odd.append(parities(s).view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(th, pa.int64()), pa.array(rows, pa.binary()), pa.array(size, pa.int64()), pa.array(odd, pa.list_(pa.int64()))], names=["n", "s", "size", "sk"])

    # One document of each candidate class: its text is found by the class's smallest id (or by the class itself where ids are null).
    chosen = classes.join(nodes.hint("merge"), F.col("th") == F.col("n"), "left_semi").select(F.col("first").alias("cf"))
    chosen = materialize(chosen.distinct(), "copies-chosen")
    shingled = materialize(body.join(chosen.hint("merge"), F.col("doc_id").eqNullSafe(F.col("cf")), "left_semi").select("t").mapInArrow(sets, "n bigint, s binary, size bigint, sk array<bigint>").groupBy("n").agg(F.any_value("s").alias("s"), F.any_value("size").alias("size"), F.any_value("sk").alias("sk")), "copies-shingles")
    release(spark)

    def overlap(batches):
        for b in batches:
            keep = []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= SIMILARITY * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    def prove(edges: DataFrame) -> DataFrame:
        sided = edges.join(shingled.select(F.col("n").alias("a"), F.col("s").alias("sa")).hint("merge"), "a").join(shingled.select(F.col("n").alias("b"), F.col("s").alias("sb")).hint("merge"), "b")
        return sided.select("a", "b", "sa", "sb").mapInArrow(overlap, "a bigint, b bigint")

    roots = components(materialize(prove(pairs), "copies-proved"))
    live = materialize(_rooted(nodes.select(F.col("n").alias("th")), "th", roots, "g"), "copies-live")

    def crowded(of: DataFrame) -> DataFrame:
        """The classes of the groups that ``of`` (th) stand in: their fingerprints, with th and g."""
        groups = of.join(live.select("th", "g").hint("merge"), "th").select(F.col("g").alias("cg")).distinct()
        own = live.join(groups.hint("merge"), F.col("g") == F.col("cg")).select(F.col("th").alias("mth"), "g")
        return materialize(classes.join(own.hint("merge"), F.col("th") == F.col("mth")).select("th", "g", "fps"), "copies-crowd")

    # Where candidates are of different groups, these meet each other's hubs, then the nearest that they find there, as long as that joins some, ROUNDS times at most,
    crowd, tried = classes.join(live.select(F.col("th").alias("mth"), "g").hint("merge"), F.col("th") == F.col("mth")).select("th", "g", "fps"), pairs
    for round_ in range(ROUNDS):
        sided = crowd.select(F.posexplode("fps").alias("t", "fp"), "th", "g", *(["fps"] if round_ else []))
        met = materialize(hubs(sided, 2, PRINT_BITS), "copies-hubs")
        mixed = met.select("th").distinct()
        fresh = materialize(_pairs("th", "hub", met).distinct().join(tried.hint("merge"), ["a", "b"], "left_anti"), "copies-candidates")
        proved = materialize(prove(fresh), "copies-proved")
        joins = proved.limit(1).count() > 0
        if joins:
            more = components(_group_pairs(proved, live))
            live = materialize(_rooted(live.withColumnRenamed("g", "was"), "was", more, "g").select("th", "g"), "copies-live")
        elif not mixed.limit(1).count():
            crowd = None
            break
        crowd, tried = crowded(mixed), tried.unionByName(fresh)
        if round_ and not joins:
            break
    # then all pairs of these groups that are candidates have their turn.
    if crowd is not None:
        crowd = crowd.join(shingled.select("n", "size", "sk").hint("merge"), F.col("th") == F.col("n"))
        crowd = materialize(crowd.select(F.posexplode("fps").alias("t", "fp"), "th", "g", "fps", "size", "sk"), "copies-crowd")
        rest = materialize(rivals(crowd, 2, PRINT_BITS, ALL_BITS, SIMILARITY).distinct().join(tried.hint("merge"), ["a", "b"], "left_anti"), "copies-rest")
        more = components(_group_pairs(materialize(prove(rest), "copies-proved"), live))
        live = _rooted(live.withColumnRenamed("g", "was"), "was", more, "g").select("th", "g")
    joined = _rooted(classes.select("th", "first"), "th", live.select(F.col("th").alias("node"), F.col("g").alias("root")), "root")
    table = materialize(_labelled(joined, "group_id").select(F.col("th").alias("lt"), "group_id"), "copies-labels")
    discard_tables(shingled)
    release(spark)
    return marked.select("doc_id", "th").join(table.hint("merge"), F.col("th") == F.col("lt"), "left").select("doc_id", "th", F.when(F.col("th").isNull(), F.col("doc_id")).otherwise(F.col("group_id")).alias("group_id"))


def drop_copies(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``docs`` with one row of each copy group (that of its smallest id, of repeated rows any one); columns unchanged."""
    low = F.lit(-(2**63))
    groups = materialize(copy_groups(docs, text, key), "copies-groups")
    stays = groups.filter(F.col("doc_id").eqNullSafe(F.col("group_id"))).groupBy("doc_id").agg(F.min("th").alias("th"))
    stays = materialize(stays.select(F.coalesce("doc_id", low).alias("k1"), F.coalesce("th", low).alias("k2")), "copies-stay")

    row = docs.select(F.struct("*").alias("row"), F.coalesce(F.col(key).cast("long"), low).alias("k1"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("t"))

    def hashed(batches):
        for b in batches:
            th = []
            for t in b.column(2).to_pylist():
                words = t.lower().split()
                x = xxhash.xxh64_intdigest(b" ".join(words), 3) if words else 1 << 63
                th.append(x - (1 << 64) * (x >> 63))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(th, pa.int64())], names=["row", "k1", "k2"])

    kind = row.schema["row"].dataType.simpleString()
    keyed = row.mapInArrow(hashed, f"row {kind}, k1 bigint, k2 bigint").join(stays.hint("merge"), ["k1", "k2"])
    one = F.row_number().over(Window.partitionBy("k1", "k2").orderBy(F.lit(1)))
    return keyed.withColumn("one", one).filter(F.col("one") == 1).select("row.*")
