"""Pair metrics on packed pixels: plain numpy, known answers, and the array functions."""
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelloom.functions import metrics as M
from pixelloom.operators import kernels as K
from pixelloom.operators import pair_metrics as PM

ALL = ("mse", "mae", "ssim", "windowed_ssim", "dice", "iou")
PAIR = "image_id bigint, height int, width int, channels int, px_a array<int>, px_b array<int>"


def rows_of(ims):
    return [(k, *a.shape, a.ravel().tolist(), b.ravel().tolist()) for k, (a, b) in enumerate(ims)]


def packed(df):
    return K.pack(K.pack(df, "px_a"), "px_b")


def test_large_and_small_pairs_agree_with_plain_numpy(spark, monkeypatch):
    monkeypatch.setattr(K, "STACK", 40_000)
    rng = np.random.default_rng(4)
    shapes = [(64, 48, 3)] * 5 + [(9, 7, 1)] * 40 + [(130, 70, 3), (7, 7, 1)]
    ims = [(a := rng.integers(0, 256, s), np.clip(a + rng.integers(-20, 20, s), 0, 255)) for s in shapes]
    df = spark.createDataFrame(rows_of(ims), PAIR).repartition(2)
    got = {r["image_id"]: r for r in PM.pair_scores(packed(df), ALL).collect()}
    same = {r["image_id"]: r for r in PM.pair_scores(df, ALL).collect()}
    assert got == same
    for k, (a, b) in enumerate(ims):
        x, y = a.astype(float), b.astype(float)
        assert math.isclose(got[k]["mse"], ((x - y) ** 2).mean()) and math.isclose(got[k]["mae"], abs(x - y).mean())
        p, q = x.mean(2).ravel(), y.mean(2).ravel()
        s = (2 * p.mean() * q.mean() + 6.5025) * (2 * np.cov(p, q)[0, 1] + 58.5225) / ((p.mean() ** 2 + q.mean() ** 2 + 6.5025) * (p.var() + q.var() + 58.5225))
        assert math.isclose(got[k]["ssim"], s, rel_tol=1e-9)
        m, n = a > 127.5, b > 127.5
        assert math.isclose(got[k]["dice"], 2 * (m & n).sum() / (m.sum() + n.sum())) and math.isclose(got[k]["iou"], (m & n).sum() / (m | n).sum())


def test_array_functions_agree(spark):
    rng = np.random.default_rng(5)
    df = spark.createDataFrame(rows_of([(rng.integers(0, 256, (6, 5, 1)), rng.integers(0, 256, (6, 5, 1))) for _ in range(6)]), PAIR)
    a, b = F.col("px_a"), F.col("px_b")
    want = {r["image_id"]: r for r in df.select("image_id", M.mse(a, b).alias("mse"), M.mae(a, b).alias("mae"), M.global_ssim(a, b).alias("ssim"), M.dice(a, b).alias("dice"), M.iou(a, b).alias("iou")).collect()}
    names = ("mse", "mae", "ssim", "dice", "iou")
    for r in PM.pair_scores(packed(df), names).collect():
        assert all(math.isclose(r[m], want[r["image_id"]][m], rel_tol=1e-9) for m in names)


def halves(top):
    m = np.zeros((100, 100, 1), int)
    m[top : top + 60] = 255
    return m


@pytest.mark.parametrize(("a", "b", "dice", "iou"), [
    (halves(0), halves(0), 1.0, 1.0), (halves(0) * 0, halves(0) * 0, 1.0, 1.0), (halves(0), halves(0) * 0, 0.0, 0.0), (halves(0), halves(40), 1 / 3, 0.2),
    (halves(0) // 255, halves(0), 1.0, 1.0), (halves(0) // 85, halves(0), 0.0, 0.0)])
def test_known_overlaps(a, b, dice, iou):
    assert np.allclose([PM.dice(a[None], b[None])[0], PM.iou(a[None], b[None])[0]], [dice, iou])


def test_equal_images_and_one_pixel(spark):
    flat, one = np.full((8, 8, 3), 128), np.array([[[7]]])
    ramp = np.arange(64).reshape(8, 8, 1)
    got = PM.pair_scores(packed(spark.createDataFrame(rows_of([(flat, flat), (ramp, ramp)]), PAIR)), ("mse", "ssim", "windowed_ssim")).collect()
    assert [r["mse"] for r in got] == [0.0, 0.0] and got[0]["ssim"] == 1.0 and got[1]["ssim"] > 1.0
    assert PM.pair_scores(packed(spark.createDataFrame(rows_of([(one, one)]), PAIR)), ("mse", "ssim")).first()["ssim"] is None


def test_rows_that_cannot_be_compared_stay(spark):
    df = spark.createDataFrame([(1, 2, 2, 1, [1, 2, 3, 4], [1, 2, 3]), (2, 2, 2, 1, None, [1, 2, 3, 4]), (3, None, 2, 1, [1, 2], [1, 2]), (4, 2, 2, 1, [0, 0, 0, 0], [1, 1, 1, 1]), (4, 2, 2, 1, [0, 0, 0, 0], [1, 1, 1, 1])], PAIR)
    got = sorted(map(tuple, PM.pair_scores(packed(df), ("mse", "mae")).collect()), key=str)
    assert got == [(1, None, None), (2, None, None), (3, None, None), (4, 1.0, 1.0), (4, 1.0, 1.0)]
    assert PM.pair_scores(df.limit(0), ("mse",)).count() == 0


def test_evaluation_with_other_sizes_and_masks(spark):
    rng = np.random.default_rng(6)
    a, b = rng.integers(0, 256, (32, 24, 3)), rng.integers(0, 256, (32, 24, 3))
    small, mask = rng.integers(0, 256, (16, 12, 3)), rng.integers(0, 2, (8, 6, 1)) * 255
    gray = rng.integers(0, 256, (32, 24, 1))
    one = lambda im: (None,) * 4 if im is None else (*im.shape, bytearray(im.astype(np.uint8).tobytes()))
    side = lambda x: f"height_{x} int, width_{x} int, channels_{x} int, px_{x} binary"
    rows = [(1, *one(a), *one(b), *one(mask)), (2, *one(a), *one(b), *one(None)), (3, *one(small), *one(b), *one(mask)), (4, *one(gray), *one(b), *one(mask)), (5, *one(None), *one(b), *one(mask)), (6, *one(b[:5]), *one(b[:5]), *one(None))]
    got = {r["image_id"]: r for r in PM.evaluate(spark.createDataFrame(rows, f"image_id int, {side('a')}, {side('b')}, {side('m')}").repartition(2)).collect()}
    big = np.repeat(np.repeat(mask, 4, 0), 4, 1)[..., 0] > 127
    red = lambda im: im[..., 0] / 255 > 0.5
    dice = lambda m: 2 * (m & big).sum() / (m.sum() + big.sum())
    assert math.isclose(got[1]["mse"], ((a - b) ** 2).mean()) and math.isclose(got[1]["dice"], dice(red(a)))
    assert math.isclose(got[1]["ssim"], K.windowed_ssim(a[None].astype(float), b[None].astype(float))[0]) and got[2]["ssim"] == got[1]["ssim"]
    assert got[2]["dice"] is None and got[2]["mae"] == got[1]["mae"]
    up = K.resample(small[None].astype(float), 32, 24)[0]
    assert math.isclose(got[3]["mae"], abs(up - b).mean()) and math.isclose(got[3]["dice"], dice(red(up)))
    assert all(got[k][m] is None for k in (4, 5) for m in ("mse", "mae", "ssim", "dice", "iou"))
    assert got[6]["mse"] == 0.0 and got[6]["ssim"] is None
    found = {r["image_id"]: r["dice"] for r in PM.structure_scores(spark.createDataFrame([(1, *one(a), *one(mask)), (2, *one(a), *one(None)), (3, *one(gray), *one(mask))], f"image_id int, {side('a')}, {side('m')}")).collect()}
    assert math.isclose(found[1], dice(red(a))) and found[2] is None and math.isclose(found[3], dice(red(gray)))
