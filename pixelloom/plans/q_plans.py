"""Queries over plans, run logs, crop geometry, vectors and experiments."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import buckets as B
from ..operators import experiment as EX
from ..operators import runlog as R
from ..operators import sampling as S
from ..operators import vectors as VE
from . import views as V

QUERIES: dict = {}
SQL: dict = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = V.with_views(sql)
        return fn

    return add


def r6(c):
    return F.round(c, 6)


def micro(x):
    return F.array_join(F.transform(x, lambda v: F.round(v * 1e6).cast("long")).cast("array<string>"), ",")


H = "((doc_id * 1103515245 + {} * 12345) % 2147483648)"
U = "array_to_string(list_transform({}, lambda v: round(v * 1e6)::BIGINT), ',')"


def keys(spark, sf):
    return V.manifest(spark, sf).select("doc_id", "grp", "label")


# --- sampling, splits, shards

@query("l1_sorted_listing", "SELECT image_path, (row_number() OVER (ORDER BY image_path, doc_id) - 1)::BIGINT AS idx FROM manifest")
def l1(spark, sf):
    return S.global_index(V.manifest(spark, sf).select("image_path", "doc_id"), ["image_path", "doc_id"]).select("image_path", "idx")


@query("l2_numeric_order", "SELECT doc_id::VARCHAR AS name, (row_number() OVER (ORDER BY doc_id) - 1)::BIGINT AS idx FROM manifest")
def l2(spark, sf):
    names = V.manifest(spark, sf).select(F.col("doc_id").cast("string").alias("name"))
    return S.global_index(R.numbered(names), ["number"]).select("name", "idx")


@query("l3_exact_sample", f"SELECT doc_id FROM manifest QUALIFY row_number() OVER (ORDER BY {H.format(42)}, doc_id) <= floor((SELECT count(*) FROM manifest) * 0.3)")
def l3(spark, sf):
    return S.exact_sample(keys(spark, sf), "doc_id", 0.3, 42).select("doc_id")


@query("l4_shuffled_prefix", f"SELECT doc_id, (row_number() OVER (ORDER BY {H.format(7)}, doc_id) - 1)::BIGINT AS pos FROM manifest QUALIFY row_number() OVER (ORDER BY {H.format(7)}, doc_id) <= floor((SELECT count(*) FROM manifest) * 0.5)")
def l4(spark, sf):
    k = keys(spark, sf)
    return S.shuffled(k, "doc_id", 7).filter(F.col("pos") < int(k.count() * 0.5)).select("doc_id", "pos")


@query("l5_train_and_validation_order", f"SELECT doc_id, 'train' AS split, (row_number() OVER (ORDER BY {H.format(3)}, doc_id) - 1)::BIGINT AS pos FROM manifest WHERE doc_id % 5 <> 0 UNION ALL SELECT doc_id, 'validation', (row_number() OVER (ORDER BY doc_id) - 1)::BIGINT FROM manifest WHERE doc_id % 5 = 0")
def l5(spark, sf):
    k = keys(spark, sf)
    train = S.shuffled(k.filter(F.col("doc_id") % 5 != 0), "doc_id", 3).select("doc_id", F.lit("train").alias("split"), "pos")
    return train.unionByName(S.global_index(k.filter(F.col("doc_id") % 5 == 0), ["doc_id"], "pos").select("doc_id", F.lit("validation").alias("split"), "pos"))


@query("w1_group_ranges", "SELECT grp, min(idx) AS first, max(idx) AS last, count(*) AS n FROM (SELECT grp, (row_number() OVER (ORDER BY grp, doc_id) - 1)::BIGINT AS idx FROM manifest) GROUP BY grp")
def w1(spark, sf):
    return S.group_ranges(S.global_index(keys(spark, sf), ["grp", "doc_id"]), "grp")


@query("w2_fallback_items", """WITH r AS (SELECT grp, doc_id AS idx, CASE WHEN doc_id % 3 <> 0 THEN doc_id END AS valid FROM manifest)
SELECT idx, coalesce(last_value(valid IGNORE NULLS) OVER (PARTITION BY grp ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), max(valid) OVER (PARTITION BY grp)) AS used FROM r""")
def w2(spark, sf):
    rows = keys(spark, sf).select("grp", F.col("doc_id").alias("idx"), F.when(F.col("doc_id") % 3 != 0, F.col("doc_id")).alias("valid"))
    return S.fallback_items(rows, "grp").select("idx", "used")


_SHARD = """WITH e AS (SELECT doc_id, ep, (row_number() OVER (PARTITION BY ep ORDER BY (doc_id * 1103515245 + (11 + ep) * 12345) % 2147483648, doc_id) - 1) AS pos FROM manifest, range(0, 3) t(ep)),
g AS (SELECT *, ep * (SELECT count(*) FROM manifest) + pos AS g FROM e)
SELECT doc_id, ep::INT AS epoch, pos::BIGINT AS pos, (g % 4)::INT AS worker, (g // 4)::BIGINT AS slot, (g // 4 // 2)::BIGINT AS step FROM g"""


@query("w6_shard_plan", _SHARD)
def w6(spark, sf):
    p = S.shard_plan(keys(spark, sf), "doc_id", 3, 4, 8, 11)
    return p.select(F.col("id").alias("doc_id"), "epoch", "pos", "worker", "slot", "step")


@query("w7_contiguous_chunks", "SELECT item_id, floor((row_number() OVER (ORDER BY item_id) - 1) / ceil((SELECT count(*) FROM benchmark) / 7.0))::INT AS worker FROM benchmark")
def w7(spark, sf):
    b = V.table(spark, sf, "benchmark").select("item_id")
    return S.global_index(b, ["item_id"]).select("item_id", S.chunk_of(F.col("idx"), b.count(), 7).alias("worker"))


@query("w12_split_by_position", "SELECT doc_id, CASE WHEN (row_number() OVER (ORDER BY doc_id) - 1) % 5 = 0 THEN 'validation' ELSE 'train' END AS split FROM manifest")
def w12(spark, sf):
    return S.split_by_position(S.global_index(keys(spark, sf), ["doc_id"])).select("doc_id", "split")


@query("w13_batches", "WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM manifest) SELECT doc_id, (i // 48)::BIGINT AS batch, (i % 48 // 16)::INT AS micro FROM r WHERE i // 48 < (SELECT count(*) // 48 FROM manifest)")
def w13(spark, sf):
    return S.batches(S.global_index(keys(spark, sf), ["doc_id"]), 48, 16, drop_last=True).select("doc_id", "batch", "micro")


@query("w16_seed_list", "SELECT doc_id, array_to_string(CASE WHEN label = 0 THEN [42, 1103527590 % 2147483648, (2::BIGINT * 1103515245 + 12345) % 2147483648] ELSE [doc_id, 1103527590 % 2147483648, (2::BIGINT * 1103515245 + 12345) % 2147483648] END, ',') AS seeds FROM manifest")
def w16(spark, sf):
    given = F.when(F.col("label") == 0, F.array().cast("array<bigint>")).otherwise(F.array("doc_id"))
    return keys(spark, sf).select("doc_id", F.array_join(S.seed_list(given, 3).cast("array<string>"), ",").alias("seeds"))


def _grid_sql() -> str:
    return """WITH c AS (SELECT (row_number() OVER (ORDER BY item_id) - 1) AS idx, item_id FROM benchmark), n AS (SELECT ceil(count(*) / 4.0) AS k FROM benchmark),
    r AS (SELECT * FROM (VALUES ('Square:1024x1024', 1024, 1024), ('Wide 1664x832', 1664, 832)) t(resolution, w, h)), s AS (SELECT * FROM (VALUES (0, 42), (1, 7)) t(i, seed))
    SELECT idx::BIGINT AS idx, resolution, seed::INT AS seed, w::INT AS w, h::INT AS h, (w // 8)::INT AS latent_w, (h // 8)::INT AS latent_h, round(sqrt(w * h / 1048576.0::DOUBLE), 6) AS scale,
      idx || '_res=' || w || 'x' || h || '_' || i || '_seed=' || seed || '_gpu=' || floor(idx / k)::INT || '.png' AS name FROM c, n, r, s"""


def grid(spark, sf):
    b = V.table(spark, sf, "benchmark").select("item_id", "text")
    n = b.count()
    captions = S.global_index(b, ["item_id"]).select("idx", F.col("text").alias("caption"), S.chunk_of(F.col("idx"), n, 4).alias("worker"))
    return S.job_grid(captions, ["Square:1024x1024", "Wide 1664x832"], [42, 7])


@query("j9_job_grid", _grid_sql())
def j9(spark, sf):
    return grid(spark, sf).select("idx", "resolution", "seed", "w", "h", "latent_w", "latent_h", r6(F.col("scale")).alias("scale"), "name")


@query("p11_resolution_geometry", f"SELECT DISTINCT resolution, w, h, latent_w, latent_h, scale FROM ({_grid_sql()})")
def p11(spark, sf):
    return j9(spark, sf).select("resolution", "w", "h", "latent_w", "latent_h", "scale").distinct()


@query("p12_output_names", f"SELECT name, 'out/images/' || name AS absolute_image_path, 'images/' || name AS relative_image_path FROM ({_grid_sql()})")
def p12(spark, sf):
    return grid(spark, sf).select("name", F.concat(F.lit("out/images/"), "name").alias("absolute_image_path"), F.concat(F.lit("images/"), "name").alias("relative_image_path"))


@query("e5_generation_grid", f"SELECT worker, count(*) AS jobs, count(DISTINCT name) AS names FROM (SELECT *, regexp_extract(name, 'gpu=(\\d+)', 1)::INT AS worker FROM ({_grid_sql()})) GROUP BY worker")
def e5(spark, sf):
    return grid(spark, sf).groupBy("worker").agg(F.count(F.lit(1)).alias("jobs"), F.countDistinct("name").alias("names"))


_MIX = f"""WITH s AS (SELECT doc_id, grp, row_number() OVER (PARTITION BY grp ORDER BY {H.format(5)}, doc_id) AS r, count(*) OVER (PARTITION BY grp) AS n FROM manifest),
k AS (SELECT doc_id, grp FROM s WHERE r <= floor(n * CASE WHEN grp < 'src2' THEN 0.5 ELSE 1.0 END))"""


def mixture(spark, sf):
    groups = keys(spark, sf).select("grp").distinct().withColumn("ratio", F.when(F.col("grp") < "src2", 0.5).otherwise(1.0))
    return S.exact_sample_per_group(keys(spark, sf), "grp", "doc_id", groups, 5)


@query("s5_multi_source", _MIX + " SELECT doc_id, grp, 'root/' || grp AS _image_root FROM k")
def s5(spark, sf):
    return mixture(spark, sf).select("doc_id", "grp", F.concat(F.lit("root/"), "grp").alias("_image_root"))


@query("e4_mixture_plan", _MIX + ", i AS (SELECT doc_id, grp, row_number() OVER (ORDER BY grp, doc_id) - 1 AS idx FROM k) SELECT doc_id, grp, idx::BIGINT AS idx, (idx // 32)::BIGINT AS batch FROM i")
def e4(spark, sf):
    return S.batches(S.global_index(mixture(spark, sf).select("doc_id", "grp"), ["grp", "doc_id"]), 32).select("doc_id", "grp", "idx", "batch")


@query("a21_implied_epochs", "SELECT round(64 * 10000 / count(*)::DOUBLE, 6) AS epochs FROM manifest")
def a21(spark, sf):
    return keys(spark, sf).agg(r6(F.try_divide(F.lit(64.0 * 10000), F.count(F.lit(1)))).alias("epochs"))


# --- run log

@query("a13_epoch_loss", "SELECT epoch, round(avg(loss), 6) AS loss FROM run_log GROUP BY epoch")
def a13(spark, sf):
    return R.epoch_means(V.run_log(spark, sf)).select("epoch", r6(F.col("loss")).alias("loss"))


_WIN = "SELECT step // 30 AS win, avg(loss) AS loss, avg(lr) AS lr, count(*) AS n, max(ts) AS closed_at FROM run_log GROUP BY 1 HAVING bool_or((step + 1) % 30 = 0)"


@query("w4_step_windows", f"SELECT win AS \"window\", round(loss, 6) AS loss, round(lr, 9) AS lr, n FROM ({_WIN})")
def w4(spark, sf):
    return R.step_windows(V.run_log(spark, sf), 30, "loss", "lr").select("window", r6(F.col("loss")).alias("loss"), F.round("lr", 9).alias("lr"), "n")


@query("a22_throughput", f"SELECT win AS \"window\", round(s / n, 3) AS seconds_per_step, round(CASE WHEN s <> 0 THEN 64 * n / s END, 3) AS items_per_second FROM (SELECT win, n, (epoch_us(closed_at) - epoch_us(coalesce(lag(closed_at) OVER (ORDER BY win), TIMESTAMP '2024-01-01'))) / 1e6 AS s FROM ({_WIN}))")
def a22(spark, sf):
    w = R.step_windows(V.run_log(spark, sf), 30, "loss")
    return R.throughput(w, F.to_timestamp(F.lit("2024-01-01")), 64).select("window", F.round("seconds_per_step", 3).alias("seconds_per_step"), F.round("items_per_second", 3).alias("items_per_second"))


_EP = "SELECT epoch, avg(loss) AS loss FROM run_log GROUP BY epoch"


@query("w3_best_so_far", f"SELECT epoch, round(min(loss) OVER w, 6) AS best, coalesce(loss < min(loss) OVER (ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS is_best FROM ({_EP}) WINDOW w AS (ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
def w3(spark, sf):
    return R.best_so_far(R.epoch_means(V.run_log(spark, sf)), "loss").select("epoch", r6(F.col("best")).alias("best"), "is_best")


_STOP = f"WITH b AS (SELECT epoch, coalesce(loss < min(loss) OVER (ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS is_best FROM ({_EP})) SELECT min(epoch) FILTER (since >= 8) AS stop_epoch FROM (SELECT epoch, epoch - max(CASE WHEN is_best THEN epoch END) OVER (ORDER BY epoch) AS since FROM b)"


@query("w10_early_stop", _STOP)
def w10(spark, sf):
    return R.early_stop(R.epoch_means(V.run_log(spark, sf)), "loss", 8)


_NAMES = "(SELECT CASE WHEN epoch % 4 = 3 THEN 'e' || epoch ELSE epoch::VARCHAR END AS name FROM run_log GROUP BY epoch)"


def names(spark, sf):
    return V.run_log(spark, sf).groupBy("epoch").count().select(F.when(F.col("epoch") % 4 == 3, F.concat(F.lit("e"), "epoch")).otherwise(F.col("epoch").cast("string")).alias("name"))


@query("w8_retention", f"SELECT name FROM {_NAMES} WHERE regexp_full_match(name, '[0-9]+') QUALIFY row_number() OVER (ORDER BY try_cast(name AS BIGINT) DESC) >= 5")
def w8(spark, sf):
    return R.to_remove(names(spark, sf), 5).select("name")


@query("w9_latest_checkpoint", f"SELECT arg_max(name, try_cast(name AS BIGINT)) AS latest FROM {_NAMES} WHERE regexp_full_match(name, '[0-9]+')")
def w9(spark, sf):
    return R.latest(names(spark, sf))


@query("w11_ema", """WITH RECURSIVE p AS (SELECT step, epoch, loss, row_number() OVER (PARTITION BY epoch ORDER BY step) AS k FROM run_log),
e AS (SELECT step, epoch, k, loss AS v FROM p WHERE k = 1 UNION ALL SELECT p.step, p.epoch, p.k, e.v * 0.9 + p.loss * 0.1 FROM e JOIN p ON p.epoch = e.epoch AND p.k = e.k + 1)
SELECT step, epoch, round(v, 6) AS ema FROM e""")
def w11(spark, sf):
    """Averages of amounts in cents often end in a half at the seventh place, so they are rounded as the SQL's engine does it, after a product and not by their decimals."""
    ema = R.ema(V.run_log(spark, sf).select("step", "epoch", "loss"), "epoch", "step", "loss", 0.9)
    return ema.select("step", "epoch", (F.round(F.col("ema") * 1e6) / 1e6).alias("ema"))


# 0.9 ** 400 is beyond what a double has beside 1.
@query("w11_ema_series", "SELECT a.step, round(sum(b.loss * pow(0.9, a.step - b.step) * CASE WHEN b.step = 0 THEN 1 ELSE 0.1 END), 6) AS ema FROM run_log a JOIN run_log b ON b.step BETWEEN a.step - 400 AND a.step GROUP BY a.step")
def w11_series(spark, sf):
    """All events as one series."""
    log = V.run_log(spark, sf).select(F.lit("run").alias("run"), "step", "loss")
    return R.ema(log, "run", "step", "loss", 0.9).select("step", r6(F.col("ema")).alias("ema"))


@query("w15_periodic_steps", "SELECT step FROM run_log WHERE (step + 1) % 100 = 0 OR step = (SELECT max(step) FROM run_log)")
def w15(spark, sf):
    return R.periodic(V.run_log(spark, sf), 100).select("step")


@query("e10_run_report", f"SELECT count(*) AS epochs, round(min(loss), 6) AS best, arg_min(epoch, loss)::INT AS best_epoch, (SELECT count(*) FROM ({_WIN})) AS windows, (SELECT stop_epoch FROM ({_STOP})) AS stop_epoch FROM ({_EP})")
def e10(spark, sf):
    log = V.run_log(spark, sf)
    ep = R.epoch_means(log)
    one = ep.agg(F.count(F.lit(1)).alias("epochs"), r6(F.min("loss")).alias("best"), F.min_by("epoch", "loss").alias("best_epoch"))
    return one.join(F.broadcast(R.step_windows(log, 30, "loss").agg(F.count(F.lit(1)).alias("windows")))).join(F.broadcast(R.early_stop(ep, "loss", 8)))


# --- crop geometry

_BUCKETS = "(SELECT w * 16 AS w, h * 16 AS h FROM (SELECT w, unnest(range(greatest(1, 256 // (w + 1)), 256 // w + 1)) AS h FROM range(1, 257) t(w)) WHERE greatest(w, h) / least(w, h)::DOUBLE <= 4.0)"


@query("i25_crop_buckets", f"SELECT w::INT AS w, h::INT AS h, (SELECT count(*) FROM image_dims WHERE width >= w AND height >= h) AS fits FROM {_BUCKETS}")
def i25(spark, sf):
    d = V.image_dims(spark, sf).groupBy("width", "height").agg(F.count(F.lit(1)).alias("n"))
    b = B.crop_buckets(spark, 256, 16)
    fits = d.join(F.broadcast(b), (F.col("width") >= F.col("w")) & (F.col("height") >= F.col("h"))).groupBy("w", "h").agg(F.sum("n").alias("n"))
    return b.join(F.broadcast(fits), ["w", "h"], "left").select("w", "h", F.coalesce("n", F.lit(0)).alias("fits"))


_SCORED = f"SELECT image_id, w::INT AS w, h::INT AS h, least(w / width::DOUBLE, h / height::DOUBLE) / greatest(w / width::DOUBLE, h / height::DOUBLE) AS score FROM image_dims, {_BUCKETS} b"
_TOP = f"SELECT image_id, (row_number() OVER (PARTITION BY image_id ORDER BY score DESC, w DESC, h DESC))::INT AS rank, w, h, round(score, 6) AS score FROM ({_SCORED}) QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY score DESC, w DESC, h DESC) <= 3"


@query("j10_bucket_scores", _TOP)
def j10(spark, sf):
    return B.best_buckets(V.image_dims(spark, sf), B.crop_buckets(spark, 256, 16), 3).select("image_id", "rank", "w", "h", r6(F.col("score")).alias("score"))


@query("w5_top_bucket_pick", f"SELECT image_id, w, h FROM ({_TOP}) WHERE rank - 1 = (image_id * 1103515245 + 2 * 12345) % 2147483648 % 3")
def w5(spark, sf):
    top = B.best_buckets(V.image_dims(spark, sf), B.crop_buckets(spark, 256, 16), 3)
    return B.pick_one(top, X.mix_hash(F.col("image_id"), 2)).select("image_id", "w", "h")


_HALF = "CASE WHEN {s} >= 8 * {c} THEN 3 WHEN {s} >= 4 * {c} THEN 2 WHEN {s} >= 2 * {c} THEN 1 ELSE 0 END"


@query("i22_center_geometry", f"SELECT image_id, n AS halvings, sw AS scaled_w, sh AS scaled_h, ((sw - 256) // 2)::INT AS \"left\", ((sh - 256) // 2)::INT AS top FROM (SELECT image_id, n, round_even(w * (256.0::DOUBLE / least(w, h)), 0)::INT AS sw, round_even(h * (256.0::DOUBLE / least(w, h)), 0)::INT AS sh FROM (SELECT image_id, n, width >> n AS w, height >> n AS h FROM (SELECT *, ({_HALF.format(s='least(width, height)', c=256)})::INT AS n FROM image_dims)))")
def i22(spark, sf):
    g = B.center_geometry(F.col("width"), F.col("height"), 256)
    return V.image_dims(spark, sf).select("image_id", *[c.alias(k) for k, c in g.items()])


@query("i23_cover_geometry", f"""SELECT image_id, n AS halvings, sw AS scaled_w, sh AS scaled_h, (k % (sw - 192 + 1))::INT AS "left", (k // 65536 % (sh - 320 + 1))::INT AS top FROM (
 SELECT image_id, n, k, round_even(w * greatest(192.0::DOUBLE / w, 320.0::DOUBLE / h), 0)::INT AS sw, round_even(h * greatest(192.0::DOUBLE / w, 320.0::DOUBLE / h), 0)::INT AS sh FROM (
  SELECT image_id, n, k, width >> n AS w, height >> n AS h FROM (SELECT *, (image_id * 1103515245 + 6 * 12345) % 2147483648 AS k,
   (CASE WHEN width >= 8 * 192 AND height >= 8 * 320 THEN 3 WHEN width >= 4 * 192 AND height >= 4 * 320 THEN 2 WHEN width >= 2 * 192 AND height >= 2 * 320 THEN 1 ELSE 0 END)::INT AS n FROM image_dims)))""")
def i23(spark, sf):
    g = B.cover_geometry(F.col("width"), F.col("height"), 192, 320, X.mix_hash(F.col("image_id"), 6))
    return V.image_dims(spark, sf).select("image_id", *[c.alias(k) for k, c in g.items()])


# --- vectors

def embeddings(spark, sf):
    return V.table(spark, sf, "embeddings").select("vec_id", "label", VE.doubles(F.col("embedding")).alias("v"))


_VH = "((vec_id * 1103515245 + {} * 12345) % 2147483648) / 2147483648.0::DOUBLE"
_E = "(SELECT vec_id, label, list_transform(embedding, lambda e: e::DOUBLE) AS v FROM embeddings)"


@query("v1_draw_times", f"SELECT vec_id, round(u, 6) AS uniform, round(0.2 + (0.9 - 0.2) * u, 6) AS uniform_a_b, round(1 / (1 + exp(-(sqrt(-2 * ln(1 - u)) * cos(2 * pi() * w)))), 6) AS lognorm, round(3 * u / (1 + 2 * u), 6) AS shift_f FROM (SELECT vec_id, {_VH.format(21)} AS u, {_VH.format(22)} AS w FROM embeddings)")
def v1(spark, sf):
    k = F.col("vec_id")
    return embeddings(spark, sf).select("vec_id", r6(VE.draw_time(k, 21)).alias("uniform"), r6(VE.draw_time(k, 21, "uniform_a_b", 0.2, 0.9)).alias("uniform_a_b"), r6(VE.draw_time(k, 21, "lognorm")).alias("lognorm"), r6(VE.draw_time(k, 21, "shift_f", shift=3.0)).alias("shift_f"))


def _pair_sql() -> str:
    coef = {"linear": ("t", "1 - t", "1.0", "-1.0"), "gvp": ("sin(pi() / 2 * t)", "cos(pi() / 2 * t)", "pi() / 2 * cos(pi() / 2 * t)", "-pi() / 2 * sin(pi() / 2 * t)"),
            "vp": ("exp(l)", "sqrt(1 - exp(2 * l))", "d * exp(l)", "-d * exp(2 * l) / sqrt(1 - exp(2 * l))")}
    one = lambda k, c: f"SELECT vec_id, '{k}' AS path, round(sum(({c[0]}) * x1 + ({c[1]}) * x0), 6) AS xt, round(sum(({c[2]}) * x1 + ({c[3]}) * x0), 6) AS ut FROM p GROUP BY vec_id"
    base = f"WITH q AS (SELECT vec_id, 0.05 + 0.9 * ({_VH.format(31)}) AS t, unnest(v) AS x1, unnest(list_reverse(v)) AS x0 FROM {_E}), p AS (SELECT *, -(1 - t) * (1 - t) * 19.9 / 4 - (1 - t) * 0.1 / 2 AS l, (1 - t) * 19.9 / 2 + 0.05 AS d FROM q) "
    return base + " UNION ALL ".join(one(k, c) for k, c in coef.items())


@query("v2_build_pairs", _pair_sql())
def v2(spark, sf):
    t = 0.05 + 0.9 * X.unit(X.mix_hash(F.col("vec_id"), 31))
    total = lambda x: r6(F.aggregate(x, F.lit(0.0), lambda a, y: a + y))
    e = embeddings(spark, sf).withColumns({"t": t, "x0": F.reverse("v")})
    rows = []
    for path in ("linear", "gvp", "vp"):
        xt, ut = VE.build_pair(F.col("v"), F.col("x0"), F.col("t"), path)
        rows.append(F.struct(F.lit(path).alias("path"), total(xt).alias("xt"), total(ut).alias("ut")))
    return e.select("vec_id", F.inline(F.array(*rows)))


@query("f8_time_embedding", f"SELECT vec_id, array_to_string(list_transform(list_concat(list_concat(list_transform(range(0, 4), lambda i: cos(label * exp(-ln(10000.0::DOUBLE) * i / 4))), list_transform(range(0, 4), lambda i: sin(label * exp(-ln(10000.0::DOUBLE) * i / 4)))), [0.0::DOUBLE]), lambda v: round(v * 1e6)::BIGINT), ',') AS emb FROM {_E}")
def f8(spark, sf):
    return embeddings(spark, sf).select("vec_id", micro(X.time_embedding(F.col("label"), 9)).alias("emb"))


@query("a19_masked_pooling", f"SELECT vec_id // 4 AS k, dim::INT AS dim, round(sum(x * m) / sum(m), 6) AS mean FROM (SELECT vec_id, (vec_id % 3 <> 0)::INT::DOUBLE AS m, unnest(range(0, len(v))) AS dim, unnest(v) AS x FROM {_E}) GROUP BY ALL")
def a19(spark, sf):
    e = embeddings(spark, sf).withColumns({"k": F.floor(F.col("vec_id") / 4), "m": (F.col("vec_id") % 3 != 0).cast("int")})
    return VE.pooled(e, "k", "v", "m").select("k", "dim", r6(F.col("mean")).alias("mean"))


@query("a20_norm_and_clip", f"SELECT vec_id, round(n, 6) AS norm, round(least(1.0, 2.0 / n), 6) AS scale FROM embeddings, (SELECT sqrt(sum(x * x)) AS n FROM (SELECT unnest(v) AS x FROM {_E}))")
def a20(spark, sf):
    return VE.with_clip_scale(embeddings(spark, sf), "v", 2.0).select("vec_id", r6(F.col("norm")).alias("norm"), r6(F.col("scale")).alias("scale"))


@query("a23_vector_mse", f"SELECT vec_id, round(avg((x - y) * (x - y)), 6) AS mse FROM (SELECT vec_id, unnest(v) AS x, unnest(list_reverse(v)) AS y FROM {_E}) GROUP BY vec_id")
def a23(spark, sf):
    return embeddings(spark, sf).select("vec_id", r6(VE.mean_square_error(F.col("v"), F.reverse("v"))).alias("mse"))


@query("a24_log_density", f"SELECT vec_id, round(-count(*) / 2.0 * ln(2 * pi()) - sum(x * x) / 2.0, 6) AS logp FROM (SELECT vec_id, unnest(v) AS x FROM {_E}) GROUP BY vec_id")
def a24(spark, sf):
    return embeddings(spark, sf).select("vec_id", r6(VE.log_density(F.col("v"))).alias("logp"))


# --- experiment

CLASSES = list(range(10))


@query("a14_accuracy", "SELECT round(avg((label = pred)::INT), 6) AS accuracy, count(*) AS n FROM predictions")
def a14(spark, sf):
    return EX.accuracy(V.predictions(spark, sf)).select(r6(F.col("accuracy")).alias("accuracy"), "n")


@query("a15_confusion", "SELECT label, " + ", ".join(f"count(*) FILTER (pred = {c}) AS p{c}" for c in CLASSES) + " FROM predictions GROUP BY label")
def a15(spark, sf):
    return EX.confusion(V.predictions(spark, sf), CLASSES)


_CLASS = """WITH c AS (SELECT k, (SELECT count(*) FROM predictions WHERE label = k AND pred = k) AS tp, (SELECT count(*) FROM predictions WHERE pred = k) AS np, (SELECT count(*) FROM predictions WHERE label = k) AS support FROM (SELECT label AS k FROM predictions UNION SELECT pred FROM predictions)),
m AS (SELECT *, CASE WHEN np > 0 THEN tp::DOUBLE / np ELSE 0 END AS pr, CASE WHEN support > 0 THEN tp::DOUBLE / support ELSE 0 END AS re FROM c),
f AS (SELECT *, CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0 END AS f1 FROM m)
SELECT 'Grade ' || k AS name, round(pr, 6) AS precision, round(re, 6) AS recall, round(f1, 6) AS f1, support FROM f
UNION ALL SELECT 'macro avg', round(avg(pr), 6), round(avg(re), 6), round(avg(f1), 6), sum(support)::BIGINT FROM f
UNION ALL SELECT 'weighted avg', round(sum(pr * support) / sum(support), 6), round(sum(re * support) / sum(support), 6), round(sum(f1 * support) / sum(support), 6), sum(support)::BIGINT FROM f
UNION ALL SELECT 'accuracy', round(sum(tp)::DOUBLE / sum(support), 6), round(sum(tp)::DOUBLE / sum(support), 6), round(sum(tp)::DOUBLE / sum(support), 6), sum(support)::BIGINT FROM f"""


@query("a16_classification_report", _CLASS)
def a16(spark, sf):
    return EX.report(V.predictions(spark, sf)).select("name", *[r6(F.col(c)).alias(c) for c in ("precision", "recall", "f1")], "support")


_AB = "SELECT avg((label = pred)::INT) AS b, avg((label = CASE WHEN vec_id % 21 = 0 THEN pred ELSE label END)::INT) AS a FROM predictions"


@query("j11_compare_runs", f"SELECT round(b, 6) AS baseline, round(a, 6) AS augmented, round((a - b) * 100, 6) AS points FROM ({_AB})")
def j11(spark, sf):
    p = V.predictions(spark, sf)
    better = p.withColumn("pred", F.when(F.col("vec_id") % 21 == 0, F.col("pred")).otherwise(F.col("label")))
    return EX.compare_runs(EX.accuracy(p), EX.accuracy(better)).select(*[r6(F.col(c)).alias(c) for c in ("baseline", "augmented", "points")])


@query("a17_improvement", f"SELECT round((a - b) * 100, 6) AS points, CASE WHEN a > b THEN 'improved' WHEN a < b THEN 'worse' ELSE 'unchanged' END AS verdict FROM ({_AB})")
def a17(spark, sf):
    p = V.predictions(spark, sf)
    better = p.withColumn("pred", F.when(F.col("vec_id") % 21 == 0, F.col("pred")).otherwise(F.col("label")))
    return EX.compare_runs(EX.accuracy(p), EX.accuracy(better)).select(r6(F.col("points")).alias("points"), "verdict")


def experiment(spark, sf) -> dict:
    """Train on a half, then on the half with its augmented rows, and judge both on the same validation rows."""
    e = V.table(spark, sf, "embeddings").select("vec_id", "embedding", "label")
    valid, train = e.filter(F.col("vec_id") % 5 == 0), e.filter(F.col("vec_id") % 5 != 0)
    return EX.ab_experiment(train.filter(F.col("vec_id") % 2 == 0), train.filter(F.col("vec_id") % 2 == 1), valid, CLASSES)


@query("e7_ab_experiment")
def e7(spark, sf):
    """The report of each run's last epoch, with its best epoch and accuracy."""
    out = experiment(spark, sf)
    # Two rows of runs beside a report of a row per class.
    return out["report"].join(F.broadcast(out["summary"]), "run").select("run", "best_epoch", "accuracy", "points", "verdict", "name", "precision", "recall", "f1", "support")


@query("e7_epochs")
def e7_epochs(spark, sf):
    return experiment(spark, sf)["epochs"]
