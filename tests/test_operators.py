"""Properties and known answers of the operators, and readers and sinks over files."""
import json
import os
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from pixelloom.operators import audit as AU
from pixelloom.operators import buckets as B
from pixelloom.operators import experiment as EX
from pixelloom.operators import manifest as MF
from pixelloom.operators import runlog as R
from pixelloom.operators import sampling as S
from pixelloom.sources import readers as RD
from pixelloom.sources import sinks as K


def png(path, width, height, rows):
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    raw = b"".join(b"\0" + bytes(r) for r in rows)
    head = struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


LINES = ['{"image_path": "a.png", "caption": "x"}', "", "   ", '{"image_path": "b.png", "caption": null, "mask_path": "m.png"}', '{"image_path": "c.png"}', '{"image_path": "d.png", "caption": "y"} trailing', "[1, 2]", "3", "not json", '{"image_path": "e.png", "caption": "z", "mask_path": ""}']


def test_tolerant_lines(spark):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(LINES)], "i int, line string")
    got = {r["i"]: (r["image_path"], r["caption"], r["mask_path"], r["text_only"]) for r in MF.parse_lines(df, "i").collect()}
    assert got == {0: ("a.png", "x", None, True), 3: ("b.png", None, "m.png", False), 9: ("e.png", "z", "", False)}
    reasons = [r["reason"] for r in MF.classify_lines(df).orderBy("i").collect()]
    assert reasons == ["ok", "blank", "blank", "ok", "missing_key", "bad_json", "not_object", "not_object", "bad_json", "ok"]


def test_readers(spark, tmp_path):
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "a.jsonl").write_text("\n".join(LINES))
    (tmp_path / "m" / "skip.csv").write_text(LINES[0])
    assert RD.read_jsonl_folder(spark, str(tmp_path / "m")).count() == 3
    with pytest.raises(ValueError, match=r"bad record \(missing_key\) in .*a.jsonl, line 4: "):
        RD.read_jsonl_strict(spark, str(tmp_path / "m" / "a.jsonl"))
    (tmp_path / "arr.json").write_text(json.dumps([{"image_path": "p", "caption": "c"}] * 8, indent=1))
    assert RD.read_json_array(spark, str(tmp_path / "arr.json")).count() == 8
    assert RD.read_jsonl(spark, str(tmp_path / "arr.json")).count() == 0  # a printed array has no valid lines
    (tmp_path / "caps.txt").write_text("one\n\n  two \n")
    assert [r[0] for r in RD.read_captions(spark, str(tmp_path / "caps.txt")).collect()] == ["one", "two"]
    with pytest.raises(ValueError, match="unknown source"):
        RD.read_catalogue(spark, [{"path": "x.yaml"}])
    cat = RD.read_catalogue(spark, [{"path": str(tmp_path / "arr.json"), "ratio": 0.5, "type": "t", "root": "r"}])
    assert cat.count() == 4 and cat.first()["image_path"] == "r/p"


def test_images(spark, tmp_path):
    png(tmp_path / "x.png", 2, 1, [[255, 0, 0, 10, 20, 30]])
    (tmp_path / "broken.png").write_bytes(b"nothing")
    rows = RD.read_images(spark, str(tmp_path)).collect()
    assert [(r["height"], r["width"], r["channels"], r["px"]) for r in rows] == [(1, 2, 3, [255, 0, 0, 10, 20, 30])]
    assert RD.read_masks(spark, str(tmp_path)).first()["px"] == [76, 18]
    assert RD.list_images(spark, str(tmp_path)).count() == 2


def test_audit(spark):
    rows = [("data/x.json",), ("/home/a/b",), ("/etc/x",), ("cuda",), ("ab",), ("",), (None,), ("model.pth",)]
    df = spark.createDataFrame(rows, "p string")
    got = [(r["l"], r["v"]) for r in df.select(AU.looks_like_path(F.col("p")).alias("l"), AU.is_valid_path(F.col("p"), "/home/a").alias("v")).collect()]
    assert got == [(True, True), (True, True), (True, False), (False, True), (False, True), (False, False), (False, False), (True, True)]
    doc = spark.createDataFrame([(1, '{"a": {"b": [1, {"c": "x"}]}, "d": null}')], "i int, j string")
    assert {r["key"]: r["value"] for r in AU.flatten_config(doc, "j").collect()} == {"a.b[0]": "1", "a.b[1].c": "x", "d": None}
    deep = '{"k": ' * 9 + '{"data_dir": "/etc/x", "files": ["/etc/y"], "log_file": "C:\\\\x", "out_path": "/home/a/z", "rel_path": "z", "name": "/etc/n", "none_dir": null, "empty": {}}' + "}" * 9
    flat = AU.flatten_config(spark.createDataFrame([(1, deep), (2, "broken {"), (3, None), (4, "7")], "i int, j string"), "j")
    assert flat.filter("i = 1").count() == 8 and [r["value"] for r in flat.filter("i > 1").orderBy("i").collect()] == [None, None, "7"]
    assert sorted(r["key"].split(".")[-1] for r in AU.path_settings(flat, "/home/a").collect()) == ["data_dir", "log_file"]


def test_operation_logs(spark):
    lines = ["2024-01-01 12:00:00: Renamed codes to codes_backup", "12:30: Deleted  old_dir", "no colon", "a: b", " ", "1:2:3: renamed to x", "1:2:3: moved a to b", "1:2:3: DELETED x: y"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, line string")
    got = {r["i"]: (r["at"], r["kind"], r["old_path"], r["new_path"], r["path"]) for r in AU.parse_ops(df, "line").collect()}
    assert got == {0: ("2024-01-01 12:00:00", "rename", "codes", "codes_backup", None), 1: ("12:30", "delete", None, None, "old_dir"), 5: ("1:2:3", "unknown", None, None, None),
                   6: ("1:2:3", "unknown", None, None, None), 7: ("1:2:3", "delete", None, None, "x:")}


def test_sampling_properties(spark):
    df = spark.range(1003).withColumnRenamed("id", "k")
    assert S.exact_sample(df, "k", 0.25, 1).distinct().count() == 250
    plan = S.shard_plan(df, "k", 2, 4, 8, 3)
    per = {r["epoch"]: (r["n"], r["m"]) for r in plan.groupBy("epoch").agg(F.countDistinct("id").alias("n"), F.max("pos").alias("m")).collect()}
    assert per == {0: (1003, 1002), 1: (1003, 1002)}
    assert S.global_index(df.limit(0), ["k"]).count() == 0
    given = spark.createDataFrame([([1, 2, 3],)], "s array<bigint>")
    with pytest.raises(Exception, match="more seeds"):
        given.select(S.seed_list(F.col("s"), 2)).collect()


def test_fallback(spark):
    rows = [("a", 0, None), ("a", 1, "x"), ("a", 2, None), ("a", 3, "y"), ("b", 0, None), (None, 0, None), (None, 1, "z")]
    df = spark.createDataFrame(rows, "g string, idx int, valid string")
    got = {(r["g"], r["idx"]): r["used"] for r in S.fallback_items(df, "g").collect()}
    assert got == {("a", 0): "y", ("a", 1): "x", ("a", 2): "x", ("a", 3): "y", ("b", 0): None, (None, 0): "z", (None, 1): "z"}


def test_running_values_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(S, "BLOCK", 4)
    rows = [("a" if i < 30 else "b", i, None if i % 7 and i % 5 else f"v{i}") for i in range(50)]
    df = spark.createDataFrame(rows, "g string, idx int, valid string").repartition(5)
    last, want = {}, {}
    for g, i, v in rows:
        last[g] = v or last.get(g)
        want[g, i] = last[g]
    assert {(r["g"], r["idx"]): r["used"] for r in S.fallback_items(df, "g").collect()} == want
    losses = [(i, float((i * 37 % 23) - i // 6)) for i in range(40)]
    ep = spark.createDataFrame(losses, "epoch int, loss double").repartition(5)
    best, want = float("inf"), {}
    for i, v in losses:
        want[i] = (min(best, v), v < best)
        best = min(best, v)
    assert {r["epoch"]: (r["best"], r["is_best"]) for r in R.best_so_far(ep, "loss").collect()} == want
    w = spark.createDataFrame([(i, 2, 10 * i * i) for i in range(1, 12)], "window int, n int, at int").selectExpr("window", "n", "timestamp_seconds(at) AS closed_at")
    assert [r["seconds_per_step"] for r in R.throughput(w, F.timestamp_seconds(F.lit(0)), 8).orderBy("window").collect()] == [5.0 * (2 * i - 1) for i in range(1, 12)]
    many = spark.createDataFrame([("x" if i % 10 else "y", i) for i in range(100)], "g string, k int")
    ratios = spark.createDataFrame([("x", 0.5)], "g string, ratio double")
    assert {r["g"]: r["count"] for r in S.exact_sample_per_group(many, "g", "k", ratios, 3).groupBy("g").count().collect()} == {"x": 45, "y": 10}
    plan = S.shard_plan(many, "k", 3, 4, 8, 11, max_steps=20, resume_step=5)
    whole = S.shard_plan(many, "k", 3, 4, 8, 11)
    assert plan.count() == whole.filter("step >= 5 AND step < 20").count() == 15 * 8


def test_crop_buckets(spark):
    got = {(r["w"], r["h"]) for r in B.crop_buckets(spark, 64, 1).collect()}
    want, w, h = set(), 64, 1
    while w > 0:
        if max(w, h) / min(w, h) <= 4:
            want.add((w, h))
        if (h + 1) * w <= 64:
            h += 1
        else:
            w -= 1
    assert got == want


def test_run_log(spark):
    names = spark.createDataFrame([("1",), ("20",), ("3",), ("best",)], "name string")
    assert R.latest(names).first()["latest"] == "20"
    assert sorted(r["name"] for r in R.to_remove(names, 3).collect()) == ["1"]
    ep = spark.createDataFrame([(1, 3.0), (2, 2.0), (3, 2.0), (4, 2.5), (5, 2.1)], "epoch int, loss double")
    assert R.early_stop(ep, "loss", 2).first()["stop_epoch"] == 4


def test_experiment(spark):
    """Two separable classes, of which the first run has seen one only in part; the second run has all it needs."""
    point = lambda i, k: (i, [float(k * 2 - 1), float(i % 7) / 7], k)
    base = spark.createDataFrame([point(i, 0) for i in range(40)] + [(100, [-1.0, 0.5], 1)], "vec_id int, embedding array<double>, label int")
    more = spark.createDataFrame([point(200 + i, 1) for i in range(40)], base.schema)
    valid = spark.createDataFrame([point(i, i % 2) for i in range(30)], base.schema)
    out = EX.ab_experiment(base, more, valid, [0, 1])
    got = {r["run"]: r for r in out["summary"].collect()}
    assert got["augmented"]["accuracy"] == 1.0 and got["augmented"]["points"] == pytest.approx(100 * (1 - got["baseline"]["accuracy"])) and got["baseline"]["points"] == 0
    assert got["augmented"]["verdict"] == "improved" and got["baseline"]["accuracy"] == 0.5
    assert {(r["run"], r["label"], r["p0"], r["p1"]) for r in out["confusion"].collect()} == {("baseline", 0, 15, 0), ("baseline", 1, 15, 0), ("augmented", 0, 15, 0), ("augmented", 1, 0, 15)}
    assert {r["support"] for r in out["report"].filter("name = 'accuracy'").collect()} == {30}


def test_sinks_and_streams(spark, tmp_path):
    df = spark.createDataFrame([(1, None, "a"), (2, "m", "b")], "k int, mask_path string, caption string")
    K.write_manifest(df, str(tmp_path / "man"))
    text = "".join(open(tmp_path / "man" / f).read() for f in os.listdir(tmp_path / "man") if f.startswith("part"))
    assert '"mask_path":null' in text
    once = K.materialise_once(df, str(tmp_path / "once"))
    assert K.materialise_once(df.limit(0), str(tmp_path / "once")).count() == once.count() == 2
    assert K.cache_path("x", "a/b.c?!") == "x/a-b-c--"


def test_positions_over_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(S, "RANGE_ROWS", 60)
    rows = [(f"g{i * 7 % 5}" if i % 11 else None, (i * 7919) % 1009 if i % 13 else None, float(i % 3), i) for i in range(1500)]
    df = spark.createDataFrame(rows, "g string, k bigint, v double, i int").repartition(5)
    key = lambda r: ((r[0] is not None, r[0] or ""), (r[1] is not None, r[1] or 0), r[3])
    want = {r[3]: n for n, r in enumerate(sorted(rows, key=key))}
    assert {r["i"]: r["at"] for r in S.global_index(df, ["g", "k", "i"], "at").collect()} == want
    down = {r["i"]: r["idx"] for r in S.global_index(df, [-F.col("i")]).collect()}
    assert down == {i: 1499 - i for i in range(1500)}
    same = S.global_index(df.withColumn("one", F.lit(1)), ["one"]).select("idx").collect()
    assert sorted(r["idx"] for r in same) == list(range(1500))
    assert S.global_index(df.limit(0), ["i"]).count() == 0
    ranges = S.global_index(df, ["i"])._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" in ranges and "_range" in ranges
