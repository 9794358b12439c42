"""Streams over several micro-batches and restarts, smoothing of long series, masks in any number, catalogues, and the experiment by epoch."""
import json

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelloom.operators import experiment as EX
from pixelloom.operators import kernels as K
from pixelloom.operators import runlog as R
from pixelloom.operators import sampling as S
from pixelloom.sources import readers as RD
from pixelloom.sources import sinks as SK
from pixelloom.streaming import stream as ST

GOOD = '{"image_path": "%s.png", "caption": "x"}'


def arrive(spark, folder, names):
    spark.createDataFrame([(x,) for n in names for x in (GOOD % n, "", "not json", '{"caption": "no path"}')], "v string").coalesce(1).write.mode("append").text(folder)


def names_of(rows):
    return sorted(r["image_path"] for r in rows.collect())


def test_ingest_counts_every_line_once(spark, tmp_path, monkeypatch):
    src, out, cp = (str(tmp_path / x) for x in ("in", "out", "cp"))
    arrive(spark, src, ["a", "b"])
    arrive(spark, src, ["c"])
    ST.ingest_shards(spark, src, out, cp, 1)
    ST.ingest_shards(spark, src, out, cp, 1)  # nothing new
    assert names_of(ST.read_records(spark, out)) == ["a.png", "b.png", "c.png"]
    assert ST.read_counters(spark, out).select("batch").distinct().count() == 2
    arrive(spark, src, ["d"])
    arrive(spark, src, ["e", "f"])
    whole, calls = ST._count, []

    def fails(*a):
        calls.append(a)
        if len(calls) == 2:
            raise RuntimeError("lost")
        whole(*a)

    monkeypatch.setattr(ST, "_count", fails)
    with pytest.raises(Exception, match="lost"):
        ST.ingest_shards(spark, src, out, cp, 1)
    # The batch that was written but not finished is not seen.
    assert len(names_of(ST.read_records(spark, out))) in (4, 5) and ST.read_counters(spark, out).select("batch").distinct().count() == 3
    monkeypatch.setattr(ST, "_count", whole)
    ST.ingest_shards(spark, src, out, cp, 1)
    assert names_of(ST.read_records(spark, out)) == [f"{x}.png" for x in "abcdef"]
    assert {(r["reason"], r["n"]) for r in ST.read_counters(spark, out).groupBy("reason").agg(F.sum("n").alias("n")).collect()} == {("ok", 6), ("blank", 6), ("bad_json", 6), ("missing_key", 6)}
    assert ST.read_counters(spark, out).select("file").distinct().count() == 4
    rejected = {(r["reason"], r["line"]) for r in ST.read_rejected(spark, out).collect()}
    assert rejected == {("blank", ""), ("bad_json", "not json"), ("missing_key", '{"caption": "no path"}')}


def test_monitor_closes_windows_over_restarts(spark, tmp_path):
    src, out, cp = (str(tmp_path / x) for x in ("in", "out", "cp"))

    def add(*steps):
        spark.createDataFrame([(s, float(s)) for s in steps], "step bigint, loss double").coalesce(1).write.mode("append").parquet(src)

    def run():
        ST.step_monitor(spark, src, out, cp, 10, 5, 1)
        return sorted((r["window"], r["loss"], r["n"]) for r in ST.read_windows(spark, out).collect())

    add(*range(4, 10))  # begins late
    add(*range(10, 14))
    assert run() == []
    add(14, 15, 3)  # five steps beyond the first window; step 3 comes late, but in time
    first = run()
    assert first == [(0, sum(range(3, 10)) / 7, 7)]
    add(*range(16, 20), 2)  # too late for its window
    add(*range(20, 29))  # its last step never comes
    add(*range(30, 41))
    second = run()
    assert second == first + [(1, 14.5, 10)]
    add(*range(41, 45))
    assert run() == second  # the window that ends at 40 waits for step 45
    add(45)
    assert run() == second + [(3, 34.5, 10)]
    assert run() == second + [(3, 34.5, 10)]


@pytest.mark.parametrize("block", [1 << 16, 7])
def test_smoothing(spark, monkeypatch, block):
    monkeypatch.setattr(S, "BLOCK", block)
    rng = np.random.default_rng(1)
    rows = [(k, i, float(v)) for k, n in (("long", 400), ("b", 5), ("c", 1), (None, 20)) for i, v in enumerate(rng.normal(size=n))]
    df = spark.createDataFrame([(k, i, v, "x") for k, i, v in rows], "k string, i int, v double, _more string").repartition(3)
    want, at = {}, {}
    for k, i, v in rows:
        at[k] = v if i == 0 else at[k] * 0.8 + v * 0.2
        want[k, i] = at[k]
    got = R.ema(df, "k", "i", "v", 0.8)
    assert got.columns == ["k", "i", "v", "_more", "ema"]
    got = {(r["k"], r["i"]): r["ema"] for r in got.collect()}
    assert got.keys() == want.keys() and np.allclose([got[k] for k in want], list(want.values()))
    assert R.ema(df.limit(0), "k", "i", "v", 0.8).count() == 0
    holes = R.ema(spark.createDataFrame([("a", 0, 1.0), ("a", 1, None), ("a", 2, 2.0)], "k string, i int, v double"), "k", "i", "v", 0.5)
    assert [r["ema"] for r in holes.orderBy("i").collect()] == [1.0, None, None]


def test_smoothing_has_every_bit_of_its_sql(spark, tmp_path):
    """100,000 rows, over two blocks: 68 of them were a millionth off."""
    from pixelloom.plans import registry

    db = duckdb.connect()
    db.execute("CREATE VIEW events AS SELECT * FROM '/root/testdata/sf0.1/events.parquet'")
    registry.QUERIES["w11_ema"](spark, "/root/testdata/sf0.1").write.parquet(f"{tmp_path}/ema")
    both = db.execute(f"SELECT count(*), count(*) FILTER (o.ema IS DISTINCT FROM g.ema) FROM ({registry.SQL['w11_ema']}) o FULL JOIN '{tmp_path}/ema/*.parquet' g USING (step, epoch)")
    assert both.fetchone() == (100_000, 0)


def test_nulls_and_averages_enter_the_next_block(spark, monkeypatch):
    """A null before a block's first row is no fresh start there."""
    monkeypatch.setattr(S, "BLOCK", 4)
    df = spark.createDataFrame([("a", i, None if i == 2 else 1.0) for i in range(12)] + [("b", i, 8.0) for i in range(9)], "k string, i int, v double")
    got = {(r["k"], r["i"]): r["ema"] for r in R.ema(df, "k", "i", "v", 0.5).collect()}
    assert got == {**{("a", i): 1.0 if i < 2 else None for i in range(12)}, **{("b", i): 8.0 for i in range(9)}}


def test_masks_in_any_number(spark, monkeypatch):
    monkeypatch.setattr(K, "HELD", 64)
    rng = np.random.default_rng(3)
    masks = [(int(i), rng.integers(0, 256, 16).tolist() if rng.random() < 0.99 else None) for i in np.where(rng.random(3000) < 0.7, 0, rng.integers(1, 20, 3000))]
    df = spark.createDataFrame([(i, 4, 4, px) for i, px in masks], "image_id int, height int, width int, px array<int>").repartition(6)
    got = {r["image_id"]: list(r["px"]) for r in K.merge_masks(K.pack(df)).collect()}
    want = {i: np.max([px for j, px in masks if j == i and px], 0).tolist() for i, _ in masks}
    assert got == want
    assert K.merge_masks(K.pack(df.limit(0))).count() == 0
    two = spark.createDataFrame([(1, 1, 2, [1, 5]), (1, 2, 1, [3, 4]), (1, 1, 2, [2, 0])], "image_id int, height int, width int, px array<int>")
    assert sorted((r["height"], list(r["px"])) for r in K.merge_masks(K.pack(two)).collect()) == [(1, [2, 5]), (2, [3, 4])]


def test_catalogue(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"{i}.png", "c" if i % 2 else None) for i in range(40)], "k int, image_path string, caption string")
    SK.write_json_arrays(rows.select("image_path", "caption", "k"), f"{tmp_path}/a.json", F.col("k") % 3)
    SK.write_manifest(rows.select("image_path", "caption"), f"{tmp_path}/b.jsonl")
    rows.select("image_path", F.lit("w").alias("wide")).write.parquet(f"{tmp_path}/c.parquet")
    sources = [{"path": f"{tmp_path}/a.json", "ratio": 0.5, "root": "r"}, {"path": f"{tmp_path}/b.jsonl", "type": "t", "ratio": 0.1, "key": "cast(substring_index(image_path, '.', 1) as int)"}, {"path": f"{tmp_path}/c.parquet/", "image_root": "/m"}]
    got = RD.read_catalogue(spark, sources)
    assert {(r["_type"], r["_image_root"], r["wide"], r["n"]) for r in got.groupBy("_type", "_image_root", "wide").agg(F.count(F.lit(1)).alias("n")).collect()} == {("default", None, None, 20), ("t", None, None, 4), ("default", "/m", "w", 40)}
    assert got.filter("image_path like 'r/%'").count() == 20
    table = spark.createDataFrame([(s["path"], s.get("ratio")) for s in sources], "path string, ratio double")
    assert RD.read_catalogue(spark, table).count() == 20 + 4 + 40
    with pytest.raises(ValueError, match="unknown source format"):
        RD.read_catalogue(spark, [*sources, {"path": f"{tmp_path}/d.csv"}])
    rows.select(F.col("k").alias("caption")).write.parquet(f"{tmp_path}/e.parquet")
    with pytest.raises(ValueError, match="column caption of .*e.parquet is int, not string"):
        RD.read_catalogue(spark, [sources[1], {"path": f"{tmp_path}/e.parquet"}])
    one = json.loads(bytes(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{tmp_path}/a.json").select("content").first()[0]))
    assert isinstance(one, list) and set(one[0]) == {"image_path", "caption", "k"}


def test_experiment_by_epoch(spark, tmp_path):
    rng = np.random.default_rng(7)
    centre = rng.normal(size=(3, 6))
    made = [(i, (centre[i % 3] + rng.normal(size=6) * 0.9).tolist(), i % 3) for i in range(900)]
    kind = "vec_id int, embedding array<double>, label int"
    frame = lambda x, n: spark.createDataFrame(x, kind).repartition(n)
    valid = made[:200] + [(5000, None, 1), (5001, [1.0], 2)]
    run = lambda n: EX.ab_experiment(frame(made[200:230] + [(6000, None, 1), (6001, [0.0] * 6, 9)], n), frame(made[230:], n), frame(valid, n), [0, 1, 2], 5, steps=3)
    a, b = run(1), run(4)
    log = [tuple(r) for r in a["epochs"].collect()]
    assert log == [tuple(r) for r in b["epochs"].collect()] and len(log) == 10  # however the rows are dealt
    best = {}
    for name, epoch, accuracy, is_best in log:
        assert is_best == (accuracy > best.get(name, (0, -1.0))[1])
        best[name] = (epoch, accuracy) if is_best else best[name]
    assert {r["run"]: (r["best_epoch"], r["accuracy"]) for r in a["summary"].collect()} == best and best["augmented"][1] > 0.8
    # The mathematics, with all rows in one place.
    x = np.round(np.array([r[1] for r in made[200:]]) * EX.FEATURE) / EX.FEATURE
    x, y = np.concatenate((x, np.ones((700, 1))), 1), np.array([r[2] for r in made[200:]])
    w = np.zeros((3, 7))
    for epoch in range(5):
        deal = (np.array([(r[0] * 1103515245 + epoch * 12345) % 2**31 for r in made[200:]]) >> 8) % 3
        for step in range(3):
            m = deal == step
            p = EX._shares(x[m], w)
            p[np.arange(m.sum()), y[m]] -= 1
            w = w - 2.0 * ((np.round(p * EX.SHARE) / EX.SHARE).T @ x[m] / m.sum() + 1e-4 * w)
    v = np.concatenate((np.round(np.array([r[1] for r in made[:200]]) * EX.FEATURE) / EX.FEATURE, np.ones((200, 1))), 1)
    hits = ((v @ w.T).argmax(1) == np.array([r[2] for r in made[:200]])).sum()
    assert log[-1][2] == pytest.approx(hits / 202)
    # The metrics of the written predictions, by SQL.
    a["predictions"].write.parquet(f"{tmp_path}/p")
    sql = duckdb.connect().execute(f"SELECT run, avg(coalesce(label = pred, false)::INT), count(*) FILTER (label = 1 AND pred = 2) FROM '{tmp_path}/p/*.parquet' GROUP BY run").fetchall()
    assert {r[0]: r[1] for r in sql} == {n: pytest.approx(acc) for n, _, acc, _ in log[-2:]}
    assert {r[0]: r[2] for r in sql} == {r["run"]: r["p2"] for r in a["confusion"].filter("label = 1").collect()}
