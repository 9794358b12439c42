"""Known answers of the column functions and kernels."""
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelloom.functions import image as I
from pixelloom.functions import metrics as M
from pixelloom.functions import text as X
from pixelloom.operators import kernels as K


def one(spark, expr, **arrays):
    df = spark.range(1)
    for k, v in arrays.items():
        df = df.withColumn(k, F.lit(v) if not isinstance(v, list) else F.array(*[F.lit(x) for x in v]))
    return df.select(expr.alias("r")).first()["r"]


A = B = None


@pytest.fixture(autouse=True)
def columns(spark):
    """Columns need a session, so they are made before each test."""
    globals().update(A=F.col("a"), B=F.col("b"))


def test_dice_and_iou_known_answers(spark):
    full, left, right, none = [255] * 100, [255] * 50 + [0] * 50, [0] * 50 + [255] * 50, [0] * 100
    rows60a, rows60b = [255] * 60 + [0] * 40, [0] * 40 + [255] * 60
    for a, b, d, i in ((full, full, 1, 1), (left, right, 0, 0), (rows60a, rows60b, 1 / 3, 0.2), (none, none, 1, 1)):
        assert one(spark, M.dice(A, B), a=a, b=b) == pytest.approx(d)
        assert one(spark, M.iou(A, B), a=a, b=b) == pytest.approx(i)
    # A mask is scaled by 255 only where its own maximum is over 1, so small labels vanish.
    assert one(spark, M.dice(A, B), a=[4] * 9, b=[3] * 9) == 1.0
    assert one(spark, M.dice(A, B), a=[1] * 9, b=[255] * 9) == 1.0


def test_dice_rejects_other_shapes(spark):
    with pytest.raises(Exception, match="differ in shape"):
        one(spark, M.dice(A, B), a=[1] * 4, b=[1] * 9)


def test_quality_metrics(spark):
    assert one(spark, M.mse(A, B), a=[0, 10], b=[0, 0]) == 50
    assert one(spark, M.mae(A, B), a=[0, 10], b=[0, 0]) == 5
    assert math.isinf(one(spark, M.psnr(A, B), a=[3, 4], b=[3, 4]))
    assert one(spark, M.psnr(A, B), a=[255, 255], b=[0, 0]) == pytest.approx(0)
    assert one(spark, M.global_ssim(A, B), a=[1, 50, 200], b=[1, 50, 200]) > 1  # population variance against sample covariance
    assert one(spark, M.band("psnr", A), a=40.0) == "good" and one(spark, M.band("mae", A), a=4.9) == "excellent"
    v = {m: F.lit(x) for m, x in {"psnr": 36.0, "ssim": 0.91, "mae": 9.0, "mse": 150.0, "dice": 0.81, "iou": 0.66}.items()}
    assert one(spark, M.verdict(v)) == "ideal"
    assert one(spark, M.verdict(v | {"iou": F.lit(0.4)})) == "acceptable"


def test_labels(spark):
    for text, want in (("3", X.GRADES[3]), ("3.0", "3.0"), ("9", "Unknown grade: 9"), (" 2 ", X.GRADES[2]), ("+1", X.GRADES[1]), ("mild", "mild"), ("", "")):
        assert one(spark, X.label_to_caption(A), a=text) == want
    assert one(spark, X.strip(A), a="  x\t ") == "x"


def test_images(spark):
    px = list(range(12))
    assert one(spark, I.flip_rows(A, F.lit(2), F.lit(2), 3), a=px) == [3, 4, 5, 0, 1, 2, 9, 10, 11, 6, 7, 8]
    assert one(spark, I.nearest_resize(A, F.lit(2), F.lit(2), 4, 4), a=[1, 2, 3, 4]) == [1, 1, 2, 2, 1, 1, 2, 2, 3, 3, 4, 4, 3, 3, 4, 4]
    assert one(spark, I.unpatch(I.patches(A, 4, 4, 1, 2), 4, 4, 1, 2), a=list(range(16))) == list(range(16))
    assert one(spark, I.lesion_mask(A, "saturation", 0.3), a=[200, 100, 100, 0, 0, 0]) == [1, 0]
    assert one(spark, I.to_bytes(A), a=[-2.0, 0.0, 1.0]) == [0, 127, 255]
    with pytest.raises(ValueError, match="unknown lesion"):
        I.lesion_mask(A, "hue")


def test_kernels():
    im = np.random.default_rng(0).integers(0, 256, (3, 20, 24, 3)).astype(float)
    assert K.gaussian(im, 4).shape == im.shape and K.median(im, 4).shape == im.shape
    assert (K.denoise(im, "other") == im).all()
    flat = np.full((2, 16, 16, 3), 77.0)
    assert (K.resample(flat, 7, 9) == 77).all() and (K.gaussian(flat) == 77).all()
    assert K.center_crop(im, 6).shape == (3, 6, 6, 3)
    assert (K.rotate(im, np.zeros(3)) == im).all()
    colour = np.tile([0.0, 128.0, 255.0], (1, 128, 128, 1))
    assert abs(K.prepare(colour, 64).mean()) < 0.1
    assert K.windowed_ssim(im, im) == pytest.approx(1.0)


def test_kernels_on_odd_and_large_images(monkeypatch):
    """Stacks, odd sides and strips against plain loops over one image."""
    rng = np.random.default_rng(1)
    im = rng.integers(0, 256, (2, 37, 53, 3)).astype(float)
    monkeypatch.setattr(K, "STACK", 9000)
    want = np.array([[[[np.median(np.pad(x, ((2, 2), (2, 2), (0, 0)), mode="edge")[i : i + 5, j : j + 5, c]) for c in range(3)] for j in range(53)] for i in range(37)] for x in im])
    assert (K.median(im, 5) == want).all()
    other = rng.integers(0, 256, im.shape).astype(float)

    def ssim(a, b):
        out = []
        for c in range(3):
            for i in range(31):
                for j in range(47):
                    x, y = a[i : i + 7, j : j + 7, c].ravel(), b[i : i + 7, j : j + 7, c].ravel()
                    v = np.cov(x, y)
                    out.append((2 * x.mean() * y.mean() + 6.5025) * (2 * v[0, 1] + 58.5225) / ((x.mean() ** 2 + y.mean() ** 2 + 6.5025) * (v[0, 0] + v[1, 1] + 58.5225)))
        return np.mean(out)

    assert K.windowed_ssim(im, other) == pytest.approx([ssim(a, b) for a, b in zip(im, other)])
    # A box over an odd side: each of the 18 columns takes 37 / 18 pixels, those at its border or not at all.
    half = K.resample(im, 18, 26, "box")
    assert half.shape == (2, 18, 26, 3) and abs(half.mean() - im.mean()) < 3
    assert K.center_crop(im, 9).shape == (2, 9, 9, 3)
    large = rng.integers(0, 256, (1, 1024, 1024, 3)).astype(float)
    assert K.windowed_ssim(large, large) == pytest.approx([1.0]) and K.center_crop(large, 256).shape == (1, 256, 256, 3)


def test_alignment_of_other_sizes(spark):
    rows = [(1, 4, 4, 1, [7] * 16, 8, 8, 1, [7] * 64), (2, 2, 2, 1, [1, 2, 3, 4], 2, 2, 1, [1, 2, 3, 4]), (3, 16, 4, 1, [9] * 64, 2, 6, 1, [9] * 12), (4, 3, 3, 1, None, 2, 2, 1, [0] * 4)]
    df = spark.createDataFrame(rows, "image_id bigint, height_a int, width_a int, channels_a int, px_a array<int>, height_b int, width_b int, channels_b int, px_b array<int>")
    got = {r["image_id"]: r for r in K.align(df).collect()}
    assert all(got[k]["px_a"] == got[k]["px_b"] for k in (1, 2, 3)) and got[4]["px_a"] is None and (got[3]["height"], got[3]["width"]) == (2, 6)


def test_failing_image_keeps_its_row(spark):
    df = spark.createDataFrame([(1, 2, 2, 1, [1, 2, 3, 4]), (2, 3, 3, 1, [1]), (3, None, None, None, None), (4, 2, 2, 1, [5, 6, 7, 8])], "image_id bigint, height int, width int, channels int, px array<int>")
    got = {r["image_id"]: r["px"] for r in K.map_images(df, lambda im, _: im + 1).collect()}
    assert got == {1: [2, 3, 4, 5], 2: None, 3: None, 4: [6, 7, 8, 9]}

    def picky(im, rows):
        if (im == 1).any():
            raise ValueError("no")
        return im

    assert {r["image_id"]: r["px"] is None for r in K.map_images(df, picky).collect()} == {1: True, 2: True, 3: True, 4: False}
