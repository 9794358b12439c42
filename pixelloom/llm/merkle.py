"""Merkle manifest of a table, with a proof for every row.

Rows are leaves of a tree for each group (source), and the groups' roots are leaves of one more tree. Runs of three nodes become
their hash, level by level. The levels are built in blocks of consecutive nodes, several levels a shuffle, so that a group of any size is
spread over many tasks. A node holds the siblings that stand beside it (a step towards its parent). Proofs come from pointer jumping: self-joins of the
node table double the distance to the ancestor that a node points to and put the ancestor's steps behind its own; leaves take one jump of each
length until all have reached the root.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.sampling import global_index
from .common import discard_tables, materialize

#: Nodes of a run, and levels that one block builds: a block starts with 3 ** 6 = 729 nodes at most.
ARITY, LEVELS = 3, 6
#: The tree over the groups is held like that of a group of this number.
TOP = -1
#: Tables whose counted rows are so few are broadcast (a row has a group's name and three numbers, or is counted by its steps of under 200 bytes).
BROADCAST_ROWS = 50_000
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
STEPS = "array<struct<left:binary,right:binary>>"


def leaf_of(*cols: Column) -> Column:
    """Hex SHA-256 of the values one after the other: ``-`` for null, else the length in UTF-8 bytes, a colon, and the value."""
    text = [c.cast("string") for c in cols]
    return F.sha2(F.concat(*[F.when(t.isNull(), "-").otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in text]).cast("binary"), 256)


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof give."""
    return F.aggregate(proof, leaf, lambda d, s: F.sha2(F.concat(F.lower(F.hex(s["left"])), d, F.lower(F.hex(s["right"]))).cast("binary"), 256))


def proof_digest(proof: Column) -> Column:
    """Hex SHA-256 of all siblings of a proof as hex text, from the leaf upwards, left to right."""
    return F.sha2(F.array_join(F.transform(proof, lambda s: F.lower(F.hex(F.concat(s["left"], s["right"])))), "").cast("binary"), 256)


def height_of(n: Column) -> Column:
    """Levels above the leaves of a tree of ``n`` leaves."""
    return F.size(F.filter(F.array(*[F.lit(ARITY**k) for k in range(40)]), lambda p: p < n))


def _parents(level: Column) -> Column:
    last = ((F.size(level) - 1) / ARITY).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.sha2(F.array_join(F.slice(level, i * ARITY + 1, ARITY), "").cast("binary"), 256))


def _blocks(nodes: DataFrame, base: int) -> DataFrame:
    """``nodes``: s (tree), height, idx, digest, row. The nodes of level ``base`` in blocks, with the levels above them as far as a block reaches: s, height,
    block, rows, levels (arrays of digests)."""
    block = F.floor(F.col("idx") / ARITY**LEVELS)
    g = nodes.groupBy("s", "height", block.alias("block")).agg(F.sort_array(F.collect_list(F.struct("idx", "digest", "row"))).alias("m"))
    up = F.slice(F.array(*[F.lit(k) for k in range(LEVELS)]), F.lit(1), F.least(F.lit(LEVELS), F.col("height") - base))
    levels = F.aggregate(up, F.array(F.transform("m", lambda x: x["digest"])), lambda a, _: F.concat(a, F.array(_parents(F.element_at(a, -1)))))
    return materialize(g.select("s", "height", "block", F.transform("m", lambda x: x["row"]).alias("rows"), levels.alias("levels")), "merkle-blocks")


def _steps(level: Column, i: Column, below: Column) -> Column:
    """The step of the i-th node of a level, in a list; empty if ``below`` (the node stands below the top of its tree) is false."""
    at = i % ARITY
    left = F.unhex(F.array_join(F.slice(level, i - at + 1, at), ""))
    right = F.unhex(F.array_join(F.slice(level, i + 2, ARITY - 1 - at), ""))
    return F.when(below, F.array(F.struct(left.alias("left"), right.alias("right")))).otherwise(F.array().cast(STEPS))


def _nodes(blocks: DataFrame, base: int, lowest: int) -> DataFrame:
    """The nodes that ``blocks`` hold from level ``base + lowest`` on: s, height, level, idx, steps. The last level of a block that does not end its tree is
    left to the next blocks."""
    n = F.size("levels") - lowest - F.when(F.col("height") > base + LEVELS, 1).otherwise(0)
    size = F.array(*[F.lit(ARITY ** (LEVELS - k)) for k in range(LEVELS + 1)])
    one = lambda lv, j: F.transform(lv, lambda d, i: F.struct((j + base + lowest).alias("level"), (F.col("block") * F.get(size, j + lowest) + i).alias("idx"), _steps(lv, i, j + base + lowest < F.col("height")).alias("steps")))
    return blocks.select("s", "height", F.inline(F.flatten(F.transform(F.slice("levels", F.lit(lowest + 1), F.greatest(n, F.lit(0))), one))))


def _tree(nodes: DataFrame, highest: int, leaves: bool) -> tuple[list[DataFrame], DataFrame, list[DataFrame]]:
    """Node tables of the trees over ``nodes``, the last digest of each tree (s, digest), and the written blocks. ``leaves``: the leaves are
    nodes too."""
    found, tops, written, base = [], [], [], 0
    while True:
        b = _blocks(nodes, base)
        written.append(b)
        found.append(_nodes(b, base, 0 if base or leaves else 1))
        last = F.get(F.element_at("levels", -1), 0)
        tops.append(b.filter(F.col("height") <= base + LEVELS).select("s", last.alias("digest")))
        if highest <= base + LEVELS:
            break
        nodes = b.filter(F.col("height") > base + LEVELS).select("s", "height", F.col("block").alias("idx"), last.alias("digest"), F.lit(None).cast("int").alias("row"))
        base += LEVELS
    top = tops[0]
    for t in tops[1:]:
        top = top.unionByName(t)
    return found, top, written


def _pointed(nodes: DataFrame) -> DataFrame:
    """Add ps, pl, pi: the node one step above (null at the root). The last node of a group's tree is a leaf of the tree over the groups."""
    inside, leaf = F.col("level") < F.col("height"), F.col("s") != TOP
    return nodes.withColumns({"ps": F.when(inside, F.col("s")).when(leaf, F.lit(TOP)).cast("long"), "pl": F.when(inside, F.col("level") + 1).when(leaf, 0).cast("int"),
                              "pi": F.when(inside, F.floor(F.col("idx") / ARITY)).when(leaf, F.col("s")).cast("long")})


def _jump(rows: DataFrame, nodes: DataFrame, few: bool) -> DataFrame:
    """Every row moves on to what the node points to that it points to, and takes that node's steps behind its own."""
    up = nodes.select(F.col("s").alias("_s"), F.col("level").alias("_l"), F.col("idx").alias("_i"), F.col("steps").alias("_steps"), *[F.col(c).alias(f"_{c}") for c in ("ps", "pl", "pi")])
    on = (F.col("ps") == F.col("_s")) & (F.col("pl") == F.col("_l")) & (F.col("pi") == F.col("_i"))
    out = rows.join(up.hint("broadcast" if few else "merge"), on, "left")
    moved = {c: F.col(f"_{c}") for c in ("ps", "pl", "pi")} | {"steps": F.concat("steps", F.coalesce("_steps", F.array().cast(STEPS)))}
    return out.withColumns(moved).drop("_s", "_l", "_i", "_steps", "_ps", "_pl", "_pi")


def manifest(docs: DataFrame, columns: tuple[str, ...] = COLUMNS, group: str = "source", key: str = "doc_id", carry: dict[str, Column] | None = None) -> DataFrame:
    """One row per row of ``docs``: key, group, leaf, subroot (of its group), root, proof (a step with the siblings on the left and right for each level of
    both trees) and the columns ``carry``. ``fold(leaf, proof)`` is the root.

    Leaves stand by key within their group, groups by name (nulls first in both); rows of one key stand by leaf, and equal rows are leaves of their own. A null
    value is marked as such in the leaf, so it is told from an empty one; texts of any length are hashed whole. Other columns play no part and may have
    any name. An empty table gives an empty result."""
    carry = carry or {}
    row = F.struct(*[c.alias(k) for k, c in carry.items()]) if carry else F.lit(None).cast("int")
    slim = materialize(docs.select(F.col(group).cast("string").alias("g"), F.col(key).alias("k"), leaf_of(*[F.col(c) for c in columns]).alias("digest"), row.alias("c")), "merkle-leaves")
    placed = materialize(global_index(slim, ["g", "k", "digest"], "at"), "merkle-placed")
    groups = placed.groupBy("g").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    groups = materialize(global_index(groups, ["g"], "s").withColumn("height", height_of(F.col("n"))), "merkle-groups")
    n_groups, highest = groups.agg(F.count(F.lit(1)), F.coalesce(F.max("height"), F.lit(0))).first()
    names = "broadcast" if n_groups <= BROADCAST_ROWS else "merge"
    named = placed.join(groups.withColumnRenamed("g", "gg").hint(names), F.col("g").eqNullSafe(F.col("gg"))).select("s", "height", (F.col("at") - F.col("first")).alias("idx"), "digest", F.struct("k", "g", "c").alias("row"))
    nodes, subroots, blocks = _tree(named, highest, leaves=False)
    subroots = materialize(subroots, "merkle-subroots")
    top_height = next(k for k in range(64) if ARITY**k >= n_groups)
    over = subroots.select(F.lit(TOP).cast("long").alias("s"), F.lit(top_height).alias("height"), F.col("s").alias("idx"), "digest", F.lit(None).cast("int").alias("row"))
    top_nodes, root, top_blocks = _tree(over, top_height, leaves=True)
    root = root.first()
    # Links of one step; then of 2, 4, 8 steps. Of the groups' trees only the levels stay on which later jumps land.
    every = nodes[0]
    for t in nodes[1:] + top_nodes:
        every = every.unionByName(t)
    links = [materialize(_pointed(every).drop("height"), "merkle-links")]
    few, depth = [], highest + 1 + top_height
    rounds = max(0, (depth - 1).bit_length())
    for k in range(rounds):
        few.append(links[k].count() << k <= BROADCAST_ROWS)
        if k + 1 < rounds:
            stay = links[k].filter((F.col("s") == TOP) | (F.col("level") % (2 << k) == 0))
            links.append(materialize(_jump(stay, links[k], few[k]), "merkle-links"))
    first = F.get("levels", 0)
    entry = F.transform("rows", lambda r, i: F.struct(r["k"].alias("k"), r["g"].alias("g"), r["c"].alias("c"), F.get(first, i).alias("digest"), (F.col("block") * ARITY**LEVELS + i).alias("idx"), _steps(first, i, F.col("height") > 0).alias("steps")))
    out = blocks[0].select("s", "height", F.lit(0).alias("level"), F.inline(entry))
    out = _pointed(out)
    for k in range(rounds):
        out = _jump(out, links[k], few[k])
    out = out.join(subroots.select(F.col("s").alias("ss"), F.col("digest").alias("subroot")).hint(names), F.col("s") == F.col("ss"))
    discard_tables(slim, placed, groups, *blocks[1:], *top_blocks)
    fields = [F.col(f"c.{k}").alias(k) for k in carry]
    return out.select(F.col("k").alias(key), F.col("g").alias(group), F.col("digest").alias("leaf"), "subroot", F.lit(root["digest"] if root else None).cast("string").alias("root"), F.col("steps").alias("proof"), *fields)
