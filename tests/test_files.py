"""Files written by row and read back: images, masks, listings, and what goes wrong."""
import os

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pixelloom.functions import text as X
from pixelloom.operators import kernels as K
from pixelloom.plans import registry
from pixelloom.sources import files as FL
from pixelloom.sources import readers as RD

KIND = "name string, height int, width int, channels int, px array<int>"


def image(seed, h, w, c):
    return np.random.default_rng(seed).integers(0, 256, (h, w, c))


def names_in(path):
    return sorted(os.path.relpath(os.path.join(d, f), path).partition("/")[2] for d, _, fs in os.walk(path) for f in fs if not f.startswith(("_", ".")))


def test_images_come_back_pixel_by_pixel(spark, tmp_path):
    path = f"{tmp_path}/images"
    ims = {f"{k}.png": image(k, 5 + k, 9 - k, (1, 3, 3, 1)[k % 4]) for k in range(8)}
    rows = [(n, *im.shape, im.ravel().tolist()) for n, im in ims.items()]
    df = spark.createDataFrame(rows + [("null.png", 2, 2, 1, None), ("misfit.png", 2, 2, 1, [1])], KIND).repartition(3)
    FL.write_images(K.pack(df.filter("px is not null and name <> 'misfit.png'")).unionByName(K.pack(df.filter("px is null or name = 'misfit.png'"))), path)
    (tmp_path / "images" / "noise.png").write_bytes(b"nothing")
    whole = FL.png_bytes(image(1, 40, 40, 3).astype(np.uint8))
    (tmp_path / "images" / "cut.png").write_bytes(whole[: len(whole) // 2])
    got = {r["path"].rpartition("/")[2]: np.array(r["px"]).reshape(r["height"], r["width"], r["channels"]) for r in RD.read_images(spark, path).collect()}
    assert got.keys() == ims.keys() and all((got[n] == ims[n]).all() for n in ims)
    lost = RD.broken_images(FL.walk_files(spark, path), RD.scan_images(spark, path))
    assert sorted(r["name"] for r in lost.collect()) == ["cut.png", "misfit.png", "noise.png", "null.png"]
    masks = {r["path"].rpartition("/")[2]: list(r["px"]) for r in RD.read_masks(spark, path).collect()}
    assert masks["0.png"] == ims["0.png"].ravel().tolist()
    assert masks["1.png"] == [(r * 19595 + g * 38470 + b * 7471 + 32768) >> 16 for r, g, b in ims["1.png"].reshape(-1, 3).tolist()]


def test_small_images_are_scanned_in_few_tasks(spark, tmp_path):
    """1,500 files stand in 47 partitions of the scan; here four tasks a core read them, each file once."""
    names = spark.range(0, 1500, 1, 2).select(F.format_string("%d.png", "id").alias("name"), F.lit(1).alias("height"), F.lit(2).alias("width"), F.lit(1).alias("channels"), F.array((F.col("id") % 256).cast("int"), F.lit(7)).alias("px"))
    FL.write_images(names, f"{tmp_path}/images")
    got = RD.scan_images(spark, f"{tmp_path}/images")
    assert spark.read.format("image").option("recursiveFileLookup", "true").load(f"{tmp_path}/images").rdd.getNumPartitions() > 16 >= got.rdd.getNumPartitions()
    rows = {r["path"].rpartition("/")[2]: bytes(r["px"]) for r in got.collect()}
    assert rows == {f"{i}.png": bytes([i % 256, 7]) for i in range(1500)} and got.count() == 1500


def test_png_of_odd_channels_is_refused():
    with pytest.raises(ValueError):
        FL.png_bytes(np.zeros((2, 2, 2), np.uint8))


def test_files_with_folders_modes_and_listing(spark, tmp_path):
    path = f"file://{tmp_path}/out"
    df = spark.createDataFrame([("a/1.txt", bytearray(b"one")), ("a/2.TXT", None), ("b/c/3.txt", bytearray(b""))], "name string, data binary")
    FL.write_files(df, path)
    assert sorted((r["name"], r["length"]) for r in FL.walk_files(spark, path).collect()) == [("a/1.txt", 3), ("a/2.TXT", 0), ("b/c/3.txt", 0)]
    assert os.path.exists(f"{tmp_path}/out/_SUCCESS") and not os.path.exists(f"{tmp_path}/out/_temporary")
    FL.write_files(df.limit(1), path)
    assert FL.walk_files(spark, path).count() == 4
    FL.write_files(df.limit(1), path, "overwrite")
    assert [r["name"] for r in FL.walk_files(spark, path).collect()] == ["a/1.txt"]
    FL.write_files(df.limit(0), f"{tmp_path}/none")
    assert FL.walk_files(spark, f"{tmp_path}/none").count() == 0 and FL.walk_files(spark, f"{tmp_path}/nowhere").count() == 0
    (tmp_path / "flat").mkdir()
    (tmp_path / "flat" / "x.txt").write_text("x")
    (tmp_path / "flat" / "_y.txt").write_text("y")
    assert [(r["name"], r["length"]) for r in FL.walk_files(spark, f"{tmp_path}/flat").collect()] == [("x.txt", 1)]


@pytest.mark.parametrize("bad", ["a.txt", "../up.txt", "/abs.txt", "", None])
def test_a_failing_task_leaves_nothing(spark, tmp_path, bad):
    df = spark.createDataFrame([("a.txt", bytearray(b"1")), ("b.txt", bytearray(b"2")), (bad, bytearray(b"3"))], "name string, data binary").coalesce(1)
    with pytest.raises(Exception, match="names must be relative and unique|Python"):
        FL.write_files(df, f"{tmp_path}/out")
    assert names_in(tmp_path) == [] and not os.path.exists(f"{tmp_path}/out/_SUCCESS")


def test_a_task_of_many_files_fills_several_folders(spark, tmp_path, monkeypatch):
    """No folder, and so no listing of one, grows with the rows of a task; names stay unique over all its folders."""
    monkeypatch.setattr(FL, "FOLDER_FILES", 10)
    path = f"{tmp_path}/out"
    batch = lambda names: pa.RecordBatch.from_arrays([pa.array(names), pa.array([n.encode() for n in names], pa.binary())], names=["name", "data"])
    names = [f"{'ab'[i % 2]}/{i}.txt" for i in range(95)]
    w = FL.FileWriter(path, False)
    w.commit([w.write(iter([batch(names[:33]), batch(names[33:])])), None, w.write(iter([]))])
    assert sorted(os.listdir(path))[0] == "_SUCCESS" and len(os.listdir(path)) == 11
    assert max(sum(len(fs) for _, _, fs in os.walk(f"{path}/{d}")) for d in os.listdir(path) if d != "_SUCCESS") == 10
    assert sorted((r["name"], r["length"]) for r in FL.walk_files(spark, path).collect()) == sorted((n, len(n)) for n in names)
    for again in (names[0], names[37], names[94]):
        with pytest.raises(ValueError, match="relative and unique"):
            FL.FileWriter(f"{tmp_path}/twice", False).write(iter([batch([*names, again])]))


def test_values_beyond_bytes_are_refused(spark):
    df = spark.createDataFrame([("a", 1, 1, 1, [256])], KIND)
    with pytest.raises(Exception, match="within 0 and 255"):
        K.pack(df).collect()
    back = K.unpack(K.pack(spark.createDataFrame([("a", 1, 2, 1, [0, 255]), ("b", None, None, None, None), ("c", 0, 0, 0, [])], KIND))).collect()
    assert [(r["name"], r["px"]) for r in back] == [("a", [0, 255]), ("b", None), ("c", [])]


@pytest.mark.parametrize("name", ["s1_tolerant_jsonl", "p2_text_only_flag", "e1_ingest"])
def test_a_line_is_parsed_in_two_settings_and_no_more(spark, name):
    plan = registry.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lower().count("parsejson") == 2 or plan.count("parse_json") == 2


@pytest.mark.parametrize("bad", ["3.0", "", "x", "1 2", None])
def test_label_that_is_no_integer_is_an_error(spark, bad):
    good = spark.createDataFrame([(" 3 ",), ("+4",), ("-02",)], "t string").select(X.integer_label(F.col("t"))).collect()
    assert [r[0] for r in good] == [3, 4, -2]
    with pytest.raises(Exception, match="no integer label"):
        spark.createDataFrame([(bad,)], "t string").select(X.integer_label(F.col("t"))).collect()


def test_batch_ids_have_their_form_and_are_unique(spark):
    rows = spark.range(5000).select(X.batch_id(F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") % 3)).alias("b"), "id").collect()
    assert len({r["b"] for r in rows}) == 5000
    import re

    assert all(re.fullmatch(r"\d{8}_\d{6}_[0-9a-f]{8}", r["b"]) for r in rows)
    assert {r["b"][:15] for r in rows} == {"20231114_221320", "20231114_221321", "20231114_221322"}
