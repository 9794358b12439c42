"""Quality rules with adaptive thresholds (DataFrame functions only).

Every metric of a document is computed inside its row. KLL sketches of the metrics are built per language and source and
merged per language and over all. The median and the distance of a quartile from it make a group's centre and spread; both are drawn to
those of the language, and these to the corpus's, the more the fewer documents there are. The table of centres and spreads is joined to the documents,
and a document is rejected where a metric lies further from the centre than a multiple of the spread and the sampling error of a
document of its size allow.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, words_of

#: Ratios that are bad when high: (name, what the document has in all of what is counted, so many of which never count as much, and such a
#: share). Repeated words are those beyond what repeated lines explain; the longer a text, the more phrases recur by chance, up to 0.02 of the words
#: in texts of 5,000.
HIGH = (("symbol_ratio", "word_chars", 5.0, 0.0), ("dup_ratio", "n_lines", 2.0, 0.0), ("repeat_ratio", "n_words", 12.0, 0.03), ("upper_ratio", "word_chars", 5.0, 0.0))
#: Metrics with a fence on either side: (name, size). Lengths of words vary by about half their mean.
BOTH = (("word_len", "n_words"),)
#: Spreads, and standard errors of a document's own value, within which it may lie. Quartiles hold as long as less than a quarter of a group is bad.
SPREADS, ERRORS = 6.0, 5.0
#: A group's spread is at most so many times that of its language (and that of a language, the corpus's), or, for ratios, its own centre where that is more, so
#: that a group of which a quarter to a half is bad does not set its own fence.
BOUND = 2.0
#: Documents with which a group's own values weigh as much as those of its language, and a language's as much as the corpus's.
SHRINK = 10
SKETCH_K = 200
#: Up to so many distinct repeated windows a scan of them is cheaper than sorting positions.
FEW = 48
#: Rows of the fence table up to which it is broadcast (under 200 bytes a row).
BROADCAST_ROWS = 20_000
DERIVED = [m[0] for m in HIGH + BOTH]
#: Metric, side of the fence, and the quartile whose distance from the median is the spread on that side.
SIDES = [(m, "max", 0.75) for m in DERIVED] + [(m, "min", 0.25) for m, *_ in BOTH]


def _covered(pos: Column) -> Column:
    """Words covered by 3-word windows that start at the ascending positions ``pos``."""
    steps = F.transform(pos, lambda p, k: F.least(F.lit(3), F.coalesce(F.get(pos, k + 1) - p, F.lit(3))))
    return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x.cast("long"))


def with_metrics(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add ``q`` (a struct of the counts and ratios of each document). A null text counts as empty; no row is lost."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    out = docs.withColumns({
        "_w": words_of(F.col(text)), "_l": lines,
        "_sym": F.length(F.regexp_replace(t, "[^#*$%&|<>]++", "")).cast("long"),
        "_up": F.length(F.regexp_replace(t, "[^\\p{Lu}]++", "")).cast("long"),
    })
    n = F.size("_w")
    w = F.col("_w")
    starts = F.sequence(F.lit(0), n - 3)
    out = out.withColumn("_h", F.when(n >= 3, F.transform(starts, lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))).otherwise(F.array().cast("array<bigint>")))
    h = F.col("_h")
    out = out.withColumn("_s", F.when(F.size(F.array_distinct(h)) < F.size(h), F.sort_array(h)))
    s = F.col("_s")
    out = out.withColumn("_d", F.when(s.isNotNull(), F.array_distinct(F.filter(s, lambda x, i: x == F.get(s, i - 1)))))
    few = F.filter(F.sequence(F.lit(0), F.size(h) - 1), lambda i: F.array_contains(F.col("_d"), F.get(h, i)))
    out = out.withColumn("_z", F.when(F.size("_d") > FEW, F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))))
    z = F.col("_z")
    many = F.sort_array(F.transform(F.filter(z, lambda e, k: (e["x"] == F.get(z, k - 1)["x"]) | (e["x"] == F.get(z, k + 1)["x"])), lambda e: e["i"]))
    out = out.withColumn("_p", F.when(z.isNotNull(), many).when(F.col("_d").isNotNull(), few))
    rep = F.when(F.col("_p").isNotNull(), _covered(F.col("_p"))).otherwise(F.lit(0).cast("long"))
    out = out.withColumns({"_rep": rep, "_chars": F.length(F.array_join(w, "")).cast("long")})
    nl = F.size("_l")
    nw = n.cast("long")
    dup = (nl - F.size(F.array_distinct("_l"))).cast("long")
    q = F.struct(
        nw.alias("n_words"), nl.cast("long").alias("n_lines"), F.col("_chars").alias("word_chars"), F.col("_sym").alias("n_symbols"), dup.alias("n_dup_lines"), F.col("_rep").alias("n_repeat_words"),
        ((nw < 50) | (100 * F.col("_rep") > 50 * nw)).alias("base_failed"),
        (F.col("_sym") / F.greatest(F.col("_chars"), F.lit(1))).alias("symbol_ratio"), (dup / F.greatest(nl, F.lit(1))).alias("dup_ratio"),
        F.greatest(F.col("_rep") / F.greatest(n, F.lit(1)) - 2 * dup / F.greatest(nl, F.lit(1)), F.lit(0.0)).alias("repeat_ratio"), (F.col("_up") / F.greatest(F.col("_chars"), F.lit(1))).alias("upper_ratio"),
        (F.col("_chars") / F.greatest(n, F.lit(1))).alias("word_len"),
    )
    return out.withColumn("q", q).drop("_w", "_l", "_sym", "_up", "_h", "_s", "_d", "_z", "_p", "_rep", "_chars")


def fences(measured: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """One row per (language, source) with the fences of its metrics, from mergeable sketches."""
    ok = measured.filter(~F.col("q.base_failed"))
    per = ok.groupBy(F.col(lang).alias("f_lang"), F.col(source).alias("f_source")).agg(
        F.count(F.lit(1)).alias("n"), *[F.kll_sketch_agg_double(F.col(f"q.{m}"), F.lit(SKETCH_K)).alias(m) for m in DERIVED])
    groups = measured.select(F.col(lang).alias("f_lang"), F.col(source).alias("f_source")).distinct()
    per = materialize(per, "quality-sketches")
    merged = [F.sum("n").alias("n"), *[F.kll_merge_agg_double(m).alias(m) for m in DERIVED]]
    by_lang = per.groupBy("f_lang").agg(*merged)
    overall = per.agg(*merged)

    def level(df: DataFrame) -> DataFrame:
        quant = lambda m, p: F.kll_sketch_get_quantile_double(F.col(m), F.lit(p))
        cols = [quant(m, 0.5).alias(m) for m in DERIVED]
        cols += [F.abs(quant(m, p) - quant(m, 0.5)).alias(f"{m}_{side}") for m, side, p in SIDES]
        keys = [c for c in ("f_lang", "f_source") if c in df.columns]
        return df.filter(F.col("n") > 0).select(*keys, (F.col("n") / (F.col("n") + SHRINK)).alias("w"), F.struct(*cols).alias("f"))

    a, b, c = level(per).alias("a"), level(by_lang).alias("b"), level(overall).alias("c")
    g = groups.alias("g")
    out = g.join(a, F.col("g.f_lang").eqNullSafe(F.col("a.f_lang")) & F.col("g.f_source").eqNullSafe(F.col("a.f_source")), "left")
    out = out.join(b, F.col("g.f_lang").eqNullSafe(F.col("b.f_lang")), "left").join(c.hint("broadcast"), F.lit(True), "left")

    def drawn(up: str, own: Column, parent: Column) -> Column:
        w = F.coalesce(F.col(f"{up}.w"), F.lit(0.0))
        return F.when(own.isNull(), parent).otherwise(w * own + (1 - w) * parent)

    cols = []
    for m in DERIVED:
        centre_b = drawn("b", F.col(f"b.f.{m}"), F.col(f"c.f.{m}"))
        cols.append(drawn("a", F.col(f"a.f.{m}"), centre_b).alias(m))
        own = 1.0 if m in {x for x, *_ in HIGH} else 0.0
        for side in [x for name, x, _ in SIDES if name == m]:
            s = f"{m}_{side}"
            by_b = drawn("b", F.least(F.col(f"b.f.{s}"), F.greatest(BOUND * F.col(f"c.f.{s}"), own * F.col(f"b.f.{m}"))), F.col(f"c.f.{s}"))
            by_a = drawn("a", F.least(F.col(f"a.f.{s}"), F.greatest(BOUND * by_b, own * F.col(f"a.f.{m}"))), by_b)
            cols.append(by_a.alias(s))
    return out.select(F.col("g.f_lang").alias("f_lang"), F.col("g.f_source").alias("f_source"), F.struct(*cols).alias("fence"))


def judge(measured: DataFrame, table: DataFrame, lang: str = "lang", source: str = "source", each: bool = False) -> DataFrame:
    """Add ``kept``, by the written table of ``fences``, and with ``each`` a struct ``outside`` of the metrics that lie outside."""
    table = table.hint("broadcast") if table.count() <= BROADCAST_ROWS else table.hint("shuffle_hash")
    out = measured.join(table, F.col(lang).eqNullSafe(F.col("f_lang")) & F.col(source).eqNullSafe(F.col("f_source")), "left")
    outside = []
    for m, size, events, share in HIGH:
        n, r = F.greatest(F.col(f"q.{size}"), F.lit(1)), F.col(f"fence.{m}")
        slack = ERRORS * F.sqrt(r * F.greatest(1 - r, F.lit(0.0)) / n) + events / n + share
        outside.append(F.col(f"q.{m}") > r + SPREADS * F.col(f"fence.{m}_max") + slack)
    for m, size in BOTH:
        r = F.col(f"fence.{m}")
        slack = ERRORS * r / 2 / F.sqrt(F.greatest(F.col(f"q.{size}"), F.lit(1)))
        outside.append((F.col(f"q.{m}") > r + SPREADS * F.col(f"fence.{m}_max") + slack) | (F.col(f"q.{m}") < r - SPREADS * F.col(f"fence.{m}_min") - slack))
    outside = [F.coalesce(x, F.lit(False)) for x in outside]
    if each:
        out = out.withColumn("outside", F.struct(*[x.alias(m) for m, x in zip(DERIVED, outside)]))
    bad = reduce(lambda x, y: x | y, outside)
    return out.withColumn("kept", ~F.col("q.base_failed") & ~bad).drop("f_lang", "f_source", "fence")


def rejections(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """One row per language and source: its documents, how many fail the base rule, how many of the others lie outside the fence of
    each metric (a document counts for every such metric), and how many are kept."""
    measured = materialize(with_metrics(docs.select(F.col(lang).alias("lang"), F.col(source).alias("source"), F.col(text).alias("text"))).drop("text"), "quality-metrics")
    out = judge(measured, materialize(fences(measured), "quality-fences"), each=True)
    base = F.col("q.base_failed")
    counts = [F.count_if(~base & F.col(f"outside.{m}")).alias(m) for m in DERIVED]
    return out.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"), F.count_if(base).alias("base"), *counts, F.count_if("kept").alias("kept"))


def quality_report(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", key: str = "doc_id") -> DataFrame:
    """The counts and the verdict of every document, without texts.

    Null, empty or blank texts have no words and fail the base rule. Null languages and sources form groups of their own.
    Repeated rows are judged alike and all returned; an empty table gives an empty result; other columns are ignored."""
    slim = docs.select(F.col(key).alias("doc_id"), F.col(lang).alias("lang"), F.col(source).alias("source"), F.col(text).alias("text"))
    measured = materialize(with_metrics(slim).drop("text"), "quality-metrics")
    out = judge(measured, materialize(fences(measured), "quality-fences"))
    return out.select("doc_id", "q.n_words", "q.word_chars", "q.n_symbols", "q.n_dup_lines", "q.n_repeat_words", "q.base_failed", "kept")


def quality_filter(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """The rows of ``docs`` that pass, with their columns unchanged. Nulls, repeated rows and empty tables are treated as in ``quality_report``. The metrics are measured twice, once for the fences and once to
    judge, so that no text is written or shuffled."""
    row = docs.select(F.struct("*").alias("row"), F.col(text).alias("text"), F.col(lang).alias("lang"), F.col(source).alias("source"))
    measured = materialize(with_metrics(row.drop("row")).drop("text"), "quality-metrics")
    # The row number keeps the optimizer from moving the verdict, with all its expressions unfolded, below the metrics.
    again = with_metrics(row).withColumn("_i", F.monotonically_increasing_id())
    return judge(again, materialize(fences(measured), "quality-fences")).filter(F.col("kept") & (F.col("_i") >= 0)).select("row.*")
