"""Image metrics over array columns, one expression per pair: no shuffle, no explosion to pixels."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .image import let


def same_shape(a: Column, b: Column, value: Column) -> Column:
    """``value``, or an error where the arrays differ in length."""
    return F.when(F.size(a) == F.size(b), value).otherwise(F.raise_error(F.lit("images differ in shape")).cast("double"))


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda s, v: s + v)


def mse(a: Column, b: Column) -> Column:
    return same_shape(a, b, total(F.zip_with(a, b, lambda x, y: ((x - y) * (x - y)).cast("double"))) / F.size(a))


def mae(a: Column, b: Column) -> Column:
    return same_shape(a, b, total(F.zip_with(a, b, lambda x, y: F.abs(x - y).cast("double"))) / F.size(a))


def psnr_of(mse_: Column, max_value: float = 255.0) -> Column:
    return F.when(mse_ == 0, F.lit(float("inf"))).otherwise(20.0 * F.log10(F.lit(max_value) / F.sqrt(mse_)))


def psnr(a: Column, b: Column, max_value: float = 255.0) -> Column:
    return psnr_of(mse(a, b), max_value)


def global_ssim(a: Column, b: Column, max_value: float = 255.0, k1: float = 0.01, k2: float = 0.03) -> Column:
    """One window over the whole image: population variances with the sample covariance (so equal images score a little over 1)."""
    n = F.size(a).cast("double")
    a, b = (F.transform(v, lambda x: x.cast("double")) for v in (a, b))
    sums = F.aggregate(F.zip_with(a, b, lambda x, y: F.struct(x.alias("x"), y.alias("y"))), F.struct(*[F.lit(0.0).alias(c) for c in ("x", "y", "xx", "yy", "xy")]),
                       lambda s, v: F.struct((s["x"] + v["x"]).alias("x"), (s["y"] + v["y"]).alias("y"), (s["xx"] + v["x"] * v["x"]).alias("xx"), (s["yy"] + v["y"] * v["y"]).alias("yy"), (s["xy"] + v["x"] * v["y"]).alias("xy")))
    c1, c2 = (k1 * max_value) ** 2, (k2 * max_value) ** 2

    def of(s: Column) -> Column:
        mx, my = s["x"] / n, s["y"] / n
        vx, vy = s["xx"] / n - mx * mx, s["yy"] / n - my * my
        cov = F.when(n > 1, (s["xy"] - n * mx * my) / (n - 1))
        return (2 * mx * my + c1) * (2 * cov + c2) / ((mx * mx + my * my + c1) * (vx + vy + c2))

    return same_shape(a, b, let(sums, of))


def overlap_counts(a: Column, b: Column, threshold: float = 0.5) -> Column:
    """(both, in a, in b) after scaling each mask by 255 where its own maximum is over 1, strictly over the threshold."""
    cut = lambda m: F.when(F.array_max(m) > 1, threshold * 255.0).otherwise(threshold)
    limits = F.struct(cut(a).alias("a"), cut(b).alias("b"))
    pairs = let(limits, lambda c: F.zip_with(a, b, lambda x, y: F.struct((x > c["a"]).cast("int").alias("x"), (y > c["b"]).cast("int").alias("y"))))
    return F.aggregate(pairs, F.struct(F.lit(0).alias("both"), F.lit(0).alias("a"), F.lit(0).alias("b")),
                       lambda s, v: F.struct((s["both"] + v["x"] * v["y"]).alias("both"), (s["a"] + v["x"]).alias("a"), (s["b"] + v["y"]).alias("b")))


def _of_counts(a: Column, b: Column, threshold: float, of) -> Column:
    return same_shape(a, b, let(overlap_counts(a, b, threshold), of))


def dice(a: Column, b: Column, threshold: float = 0.5) -> Column:
    return _of_counts(a, b, threshold, lambda s: F.when(s["a"] + s["b"] == 0, 1.0).otherwise(2.0 * s["both"] / (s["a"] + s["b"])))


def iou(a: Column, b: Column, threshold: float = 0.5) -> Column:
    return _of_counts(a, b, threshold, lambda s: F.when(s["a"] + s["b"] - s["both"] == 0, 1.0).otherwise(s["both"] / (s["a"] + s["b"] - s["both"])))


def iou_of_dice(d: Column) -> Column:
    return d / (2.0 - d)


def dice_of_iou(i: Column) -> Column:
    return 2.0 * i / (1.0 + i)


#: A metric is excellent beyond the first bound, good from the second on, acceptable from the third on, else poor.
BANDS = {"psnr": (40.0, 30.0, 20.0), "ssim": (0.95, 0.85, 0.70), "mae": (5.0, 15.0, 30.0), "mse": (100.0, 500.0, 1000.0), "dice": (0.9, 0.7, 0.5), "iou": (0.8, 0.5, 0.3)}
#: Bounds of the verdicts ideal (beyond them), good and acceptable (from them on).
VERDICTS = {"ideal": {"psnr": 35.0, "ssim": 0.90, "mae": 10.0, "mse": 200.0, "dice": 0.80, "iou": 0.65}, "good": {"psnr": 30.0, "ssim": 0.85, "mae": 15.0, "mse": 500.0, "dice": 0.70, "iou": 0.50},
            "acceptable": {"psnr": 25.0, "ssim": 0.75, "mae": 25.0, "mse": 1000.0, "dice": 0.60, "iou": 0.40}}
#: Least PSNR and Dice by modality (to be exceeded), and the extraction method that suits it.
MODALITIES = (("fundus", 30.0, 0.70, "red_channel"), ("ct_mri", 35.0, 0.75, "brightness"), ("pathology", 32.0, 0.70, "saturation"))
_LOW = ("mae", "mse")


def band(metric: str, value: Column) -> Column:
    """The quality band of a metric; null stays null."""
    a, b, c = BANDS[metric]
    if metric in _LOW:
        return F.when(value < a, "excellent").when(value <= b, "good").when(value <= c, "acceptable").when(value.isNotNull(), "poor")
    return F.when(value > a, "excellent").when(value >= b, "good").when(value >= c, "acceptable").when(value.isNotNull(), "poor")


def verdict(values: dict[str, Column]) -> Column:
    """The composite verdict: the best level whose bounds all metrics meet."""
    out = None
    for name, bounds in VERDICTS.items():
        ok = F.lit(True)
        for m, t in bounds.items():
            v = values[m]
            strict = name == "ideal"
            ok = ok & ((v < t if strict else v <= t) if m in _LOW else (v > t if strict else v >= t))
        out = F.when(ok, name) if out is None else out.when(ok, name)
    return out.otherwise("poor")


#: Metrics by name: functions of two array columns. Others may be added.
REGISTRY = {"mse": mse, "mae": mae, "psnr": psnr, "ssim": global_ssim, "dice": dice, "iou": iou}
