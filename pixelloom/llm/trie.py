"""Prefix trie of conversations by whole-sequence collapse.

Every turn becomes a digest, so that conversations are short rows. Identical conversations are grouped into one weighted sequence with the list of its ends.
Each distinct sequence gives its prefixes, named by a chain of hashes; a sequence that is a proper prefix of another is found by an anti-join, and
those left are the leaves. All figures of a node are sums over the weighted sequences that pass through it: the sequence of the smallest
conversation owns a node, and what counts once a node is counted by its owner.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard_tables, materialize

#: Conversations of one group of so many ids share the turns that its first one begins with; at most SHARED - 1 turns.
GROUP, SHARED = 100, 6
#: Numeric width of the ranges of ids whose lists are joined in one group.
SPAN = 100_000
#: Rows of an Arrow batch of prefixes, about.
BATCH = 20_000
ROOT = b"\0" * 16
PREFIX = "p binary, parent binary, depth bigint, len bigint, rest bigint, seq bigint, weight bigint, last boolean"


def turn_digest(role: Column, text: Column) -> Column:
    """128 bits of the SHA-256 of a turn; the role's length in front keeps role and text apart."""
    return F.unhex(F.left(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256), F.lit(32)))


def conversations(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, turns (digest and code points of each turn, in order). Turns stand by number (null first); equal numbers by role, then digest, and repeated rows all
    count. Null roles and texts are empty. Rows without a conv_id belong to no conversation and are left out. One conversation is one row of 32 bytes a
    turn."""
    r, t = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    rows = turns.filter(F.col(conv).isNotNull()).select(F.col(conv).cast("long").alias("conv_id"), F.struct(F.col(turn).alias("n"), r.alias("role"), turn_digest(r, t).alias("d"), F.length(t).cast("long").alias("len")).alias("t"))
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t")).select("conv_id", F.transform("t", lambda x: F.struct(x["d"].alias("d"), x["len"].alias("len"))).alias("turns"))


def rebuilt(convs: DataFrame) -> DataFrame:
    """Every conversation c with its first h = crc32(c) % SHARED turns taken from the conversation at the start of its group of GROUP ids (those there
    are), then its own turns after the first h. The group's first conversation is joined to GROUP others at most."""
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % SHARED).cast("int")
    base = F.col("conv_id") - F.pmod(F.col("conv_id"), F.lit(GROUP))
    first = convs.filter(F.pmod(F.col("conv_id"), F.lit(GROUP)) == 0).select(F.col("conv_id").alias("b"), F.slice("turns", 1, SHARED - 1).alias("lead"))
    both = convs.join(first.hint("merge"), base == F.col("b"), "left")
    lead = F.coalesce("lead", F.filter("turns", lambda x: F.lit(False)))
    return both.select("conv_id", F.concat(F.slice(lead, F.lit(1), h), F.slice("turns", h + 1, F.size("turns"))).alias("turns"))


def collapse(convs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct sequences (seq: the smallest conversation that has it, turns, weight: how many have it), and their lists of ends (seq, ends_sha256).

    A list may hold most of all ids: it is joined in ranges of ids, and one task hashes the ranges of a list in order, one at a time."""
    key = F.sha2(F.array_join(F.transform("turns", lambda x: F.hex(x["d"])), "").cast("binary"), 256)
    keyed = convs.withColumn("key", key)
    seqs = materialize(keyed.groupBy("key").agg(F.min("conv_id").alias("seq"), F.count(F.lit(1)).alias("weight"), F.first("turns").alias("turns")), "trie-sequences")
    span = F.floor(F.col("conv_id") / SPAN).alias("span")
    ids = keyed.groupBy("key", span).agg(F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))
    ids = ids.join(seqs.select("key", "seq").hint("merge"), "key").select("seq", "span", "ids")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows by seq and span: the digest of each seq's joined lists."""
        now, state, out = None, None, ([], [])
        for b in batches:
            for seq, part in zip(b.column(0).to_pylist(), b.column(2).to_pylist()):
                if seq != now or state is None:
                    if state is not None:
                        out[0].append(now)
                        out[1].append(state.hexdigest())
                    now, state = seq, hashlib.sha256(part.encode())
                else:
                    state.update(b"," + part.encode())
            if len(out[0]) >= BATCH:
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.string())], names=["seq", "ends_sha256"])
                out = ([], [])
        if state is not None:
            out[0].append(now)
            out[1].append(state.hexdigest())
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.string())], names=["seq", "ends_sha256"])

    n = int(convs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ends = ids.repartition(n, "seq").sortWithinPartitions("seq", "span").mapInArrow(hashed, "seq bigint, ends_sha256 string")
    return seqs.drop("key"), ends


def _prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """seq, weight, digests, lengths of sequences -> a row for each of their prefixes, the empty one too. ``rest``: code points of the last turn of the prefix and of
    all that follow."""
    names = ["p", "parent", "depth", "len", "rest", "seq", "weight", "last"]
    kinds = [pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
    out: list[list] = [[] for _ in names]

    def take() -> pa.RecordBatch:
        rows = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=names)
        for c in out:
            c.clear()
        return rows

    for b in batches:
        for seq, weight, digests, lengths in zip(*(b.column(k).to_pylist() for k in range(4))):
            at, up, left, n = ROOT, None, sum(lengths), len(digests)
            for depth in range(n + 1):
                size = lengths[depth - 1] if depth else 0
                if depth:
                    up, at = at, hashlib.sha256(at + digests[depth - 1]).digest()[:16]
                for c, v in zip(out, (at, up, depth, size, left, seq, weight, depth == n)):
                    c.append(v)
                left -= size
                if len(out[0]) >= BATCH:
                    yield take()
    yield take()


def trie(convs: DataFrame) -> DataFrame:
    """``convs``: conv_id (unique), turns (digest d, len). One row per distinct prefix: conv_id (the smallest member), depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256 (see the module). An empty table gives an empty result."""
    seqs, ends = collapse(convs)
    flat = seqs.select("seq", "weight", F.col("turns.d").alias("d"), F.col("turns.len").alias("len"))
    rows = materialize(flat.mapInArrow(_prefixes, PREFIX), "trie-prefixes")
    ends = materialize(ends, "trie-ends")
    whole = rows.filter("last").select("p", "seq")
    # The leaves: sequences that are no proper prefix of another one.
    proper = rows.filter(~F.col("last")).select(F.col("p").alias("pp")).distinct()
    leaves = whole.join(proper.hint("merge"), F.col("p") == F.col("pp"), "left_anti").select(F.col("seq").alias("ls"))
    nodes = rows.groupBy("p").agg(F.min("seq").alias("conv_id"), F.min("depth").alias("depth"), F.min("parent").alias("parent"), F.min_by("rest", "seq").alias("rest"))
    nodes = materialize(nodes, "trie-nodes")
    # What a sequence owns are its nodes from some depth on: there its path leaves those of smaller conversations.
    owned = nodes.groupBy(F.col("conv_id").alias("os")).agg(F.min("depth").alias("from"), F.min_by("rest", "depth").alias("own_rest"), F.min_by("parent", "depth").alias("from_parent"), F.min_by("p", "depth").alias("from_p"))
    owned = materialize(owned.join(leaves.hint("merge"), F.col("os") == F.col("ls"), "left").withColumn("leaf", F.col("ls").isNotNull().cast("long")), "trie-owned")
    # A sequence that is a prefix of a smaller conversation owns nothing.
    through = rows.join(owned.select("os", "from", "own_rest", "leaf").hint("merge"), F.col("seq") == F.col("os"), "left")
    saved = F.col("weight") * F.col("rest") - F.when(F.col("depth") >= F.col("from"), F.col("rest")).otherwise(F.coalesce("own_rest", F.lit(0)))
    sums = through.groupBy("p").agg(F.min("seq").alias("conv_id"), F.min("depth").alias("depth"), F.sum("weight").alias("n_convs"), F.sum(F.coalesce("leaf", F.lit(0))).cast("long").alias("n_leaves"), F.sum(saved).alias("saved_tokens"))
    children = nodes.filter(F.col("parent").isNotNull()).groupBy(F.col("parent").alias("p")).agg(F.count(F.lit(1)).alias("n_children"))
    up = owned.filter(F.col("from_parent").isNotNull()).join(nodes.select(F.col("p").alias("np"), F.col("conv_id").alias("up")).hint("merge"), F.col("from_parent") == F.col("np")).select(F.col("from_p").alias("p"), "up")
    ends = whole.join(ends.withColumnRenamed("seq", "es").hint("merge"), F.col("seq") == F.col("es")).select("p", "ends_sha256")
    parts = sums
    for more in (children, up, ends):
        parts = parts.unionByName(more, allowMissingColumns=True)
    names = ("conv_id", "depth", "up", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    out = parts.groupBy("p").agg(*[F.max(c).alias(c) for c in names])
    none = hashlib.sha256(b"").hexdigest()
    parent = F.coalesce("up", F.when(F.col("depth") > 0, F.col("conv_id")))
    return out.select("conv_id", "depth", parent.alias("parent_conv_id"), "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"), "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"))


def prefix_trie(turns: DataFrame) -> DataFrame:
    """The trie of the rebuilt conversations of ``turns`` (conv_id, turn, role, text; nulls, ties and repeated rows as in ``conversations``; other columns play
    no part and may have any name). Texts of any length are hashed whole."""
    own = materialize(conversations(turns), "trie-conversations")
    again = materialize(rebuilt(own), "trie-rebuilt")
    out = trie(again)
    discard_tables(own)
    return out
