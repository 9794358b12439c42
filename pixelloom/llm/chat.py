"""Chat formatting: reply trees to conversations.

Messages form trees (each names its parent). Iterative self-joins that double their stride find every message's depth and
the summed score of its path from the root; the leaves of a tree are ranked by that score; the chosen root-to-leaf paths are
enumerated by the same doubled links, so the rows made are those of the chosen paths, and each path is formatted as one
conversation with a loss mask over the assistant's texts.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize

OPEN, SEP, CLOSE = "<s>", "[:]", "</s>"
#: Escapes: after them a text holds neither "<" nor "[", so no control string of any template above can appear in it.
ESCAPES = (("\\", "\\b"), ("<", "\\l"), ("[", "\\s"))


def escape(c: Column) -> Column:
    for a, b in ESCAPES:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def unescape(c: Column) -> Column:
    for a, b in reversed(ESCAPES):
        c = F.replace(c, F.lit(b), F.lit(a))
    return c


def root_paths(messages: DataFrame, per_tree: int | None = 1) -> DataFrame:
    """``messages``: tree, id, parent, score. Returns (tree, path, rank, pos, id): for each chosen leaf (``path`` is its id) the
    messages from the root (pos 0) down. Leaves are ranked by summed score, then by the smaller id; ``per_tree=None`` keeps all.

    A parent that is null or unknown makes a root; a null score counts as 0; a message without an id is left out, and so are
    messages whose parents run in a circle (they hang on no root). ``(tree, id)`` must be unique."""
    m = messages.filter(F.col("id").isNotNull()).select("tree", "id", "parent", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    known = m.select(F.col("tree").alias("kt"), F.col("id").alias("kid"))
    on = F.col("tree").eqNullSafe(F.col("kt")) & (F.col("parent") == F.col("kid"))
    state = materialize(m.join(known, on, "left").select("tree", "id", F.col("kid").alias("up"), "score", F.lit(1).cast("long").alias("depth")), "chat-links")
    first, links, n, stride = state, [], None, 1
    while True:
        active = state.filter(F.col("up").isNotNull())
        n_active = active.count()
        if n is None:
            n = state.count()
        if not n_active or stride > 2 * n:
            break
        links.append(active.select("tree", "id", "up"))
        b = state.select(F.col("tree").alias("bt"), F.col("id").alias("bid"), F.col("up").alias("bup"), F.col("score").alias("bs"), F.col("depth").alias("bd"))
        moved = active.join(b, F.col("tree").eqNullSafe(F.col("bt")) & (F.col("up") == F.col("bid"))).select(
            "tree", "id", F.col("bup").alias("up"), (F.col("score") + F.col("bs")).alias("score"), (F.col("depth") + F.col("bd")).alias("depth"))
        state = materialize(state.filter(F.col("up").isNull()).unionByName(moved), "chat-jump")
        stride *= 2
    done = state.filter(F.col("up").isNull())
    parents = first.filter(F.col("up").isNotNull()).select(F.col("tree").alias("pt"), F.col("up").alias("pid")).distinct()
    leaves = done.join(parents, F.col("tree").eqNullSafe(F.col("pt")) & (F.col("id") == F.col("pid")), "left_anti")
    rank = F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("score"), "id"))
    leaves = leaves.withColumn("rank", rank)
    if per_tree is not None:
        leaves = leaves.filter(F.col("rank") <= per_tree)
    path = leaves.select("tree", F.col("id").alias("path"), "rank", (F.col("depth") - 1).alias("pos"), "id")
    for k, link in enumerate(links):
        up = link.select(F.col("tree").alias("lt"), F.col("id").alias("lid"), "up")
        more = path.join(up, F.col("tree").eqNullSafe(F.col("lt")) & (F.col("id") == F.col("lid"))).select("tree", "path", "rank", (F.col("pos") - 2**k).alias("pos"), F.col("up").alias("id"))
        path = materialize(path.unionByName(more), "chat-path")
    return path


def format_paths(paths: DataFrame, messages: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """One row per path: tree, path, rank, n_turns, formatted, loss_spans (0-based code point ranges [start, end) of the escaped
    assistant texts in ``formatted``). Null roles and texts count as empty."""
    body = messages.select(F.col("tree").alias("mt"), F.col("id").alias("mid"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = paths.join(body, F.col("tree").eqNullSafe(F.col("mt")) & (F.col("id") == F.col("mid")))
    rows = rows.select("tree", "path", "rank", F.struct("pos", F.col("role"), escape(F.col("role")).alias("r"), escape(F.col("text")).alias("t")).alias("turn"))
    conv = rows.groupBy("tree", "path", "rank").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    head = len(OPEN) + len(SEP)
    size = lambda t: F.lit(head + len(CLOSE)) + F.length(t["r"]) + F.length(t["t"])
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"))

    def step(acc: Column, t: Column) -> Column:
        start = acc["at"] + F.lit(head) + F.length(t["r"])
        span = F.array(F.struct(start.cast("long").alias("start"), (start + F.length(t["t"])).cast("long").alias("end")))
        return F.struct((acc["at"] + size(t)).cast("long").alias("at"), F.when(t["role"] == loss_role, F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    text = F.array_join(F.transform("turns", lambda t: F.concat(F.lit(OPEN), t["r"], F.lit(SEP), t["t"], F.lit(CLOSE))), "")
    return conv.select("tree", "path", "rank", F.size("turns").cast("long").alias("n_turns"), text.alias("formatted"), F.aggregate("turns", zero, step)["spans"].alias("loss_spans"))


def parse_turns(formatted: Column) -> Column:
    """The (role, text) turns of a formatted conversation, unescaped."""
    pieces = F.filter(F.split(formatted, CLOSE), lambda x: x != "")
    body = lambda x: F.substring_index(x, SEP, -1)
    role = lambda x: F.substring(F.substring_index(x, SEP, 1), len(OPEN) + 1, 2**31 - 1)
    return F.transform(pieces, lambda x: F.struct(unescape(role(x)).alias("role"), unescape(body(x)).alias("text")))


def masked_text(formatted: Column, spans: Column) -> Column:
    """The unescaped text under the loss mask."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substr(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")


def linear_messages(turns: DataFrame) -> DataFrame:
    """Conversations (conv_id, turn, role, text) as trees: each row answers the one before it. Rows of one conversation stand by
    turn (nulls first); ties and repeated rows stand by role, then text, and all stay. Rows of a null conv_id form one conversation."""
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = turns.select("conv_id", "turn", "role", "text").withColumn("id", F.row_number().over(w).cast("long"))
    return rows.select(F.col("conv_id").alias("tree"), "id", F.when(F.col("id") > 1, F.col("id") - 1).alias("parent"), F.lit(0.0).alias("score"), "role", "text")


def format_conversations(turns: DataFrame) -> DataFrame:
    """Every conversation as one formatted text with its loss mask (columns of ``format_paths``). Nulls, ties and repeated rows are as in
    ``linear_messages``; other columns are ignored; an empty table gives an empty result."""
    messages = materialize(linear_messages(turns), "chat-messages")
    return format_paths(root_paths(messages), messages)
