"""Metrics of image pairs of any size: numpy over Arrow batches, all metrics of a pair in one pass over its row.

Pixels are packed bytes (or arrays). The pairs of one shape in a batch are stacked, so that small images cost no call each and large ones are
taken a few at a time (``kernels.STACK`` values). A pair that fails, or lacks pixels that fit its shape, keeps its row and gets nulls.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .kernels import _each, nearest, resample, shaped, stacks, windowed_ssim


def mse(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.square(a - b).mean((1, 2, 3))


def mae(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.abs(a - b).mean((1, 2, 3))


def global_ssim(a: np.ndarray, b: np.ndarray, max_value: float = 255.0, k1: float = 0.01, k2: float = 0.03) -> np.ndarray:
    """One window over the mean of the channels: population variances with the sample covariance; undefined for one pixel."""
    a, b = (x.mean(3).reshape(len(x), -1) for x in (a, b))
    n = a.shape[1]
    mx, my = a.mean(1), b.mean(1)
    cov = ((a - mx[:, None]) * (b - my[:, None])).sum(1) / (n - 1) if n > 1 else np.full(len(a), np.nan)
    c1, c2 = (k1 * max_value) ** 2, (k2 * max_value) ** 2
    return (2 * mx * my + c1) * (2 * cov + c2) / ((mx**2 + my**2 + c1) * (a.var(1) + b.var(1) + c2))


def cut(m: np.ndarray, threshold: float = 0.5) -> np.ndarray:
    """Masks strictly over the threshold, each scaled by 255 where its own maximum is over 1."""
    return m > np.where(m.max((1, 2, 3), keepdims=True) > 1, threshold * 255.0, threshold)


def _ratio(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """1 where both masks are empty."""
    return np.where(whole == 0, 1.0, part / np.maximum(whole, 1))


def _counts(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (a & b).sum((1, 2, 3)), a.sum((1, 2, 3)) + b.sum((1, 2, 3))


def dice(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    both, sum_ = _counts(cut(a), cut(b))
    return _ratio(2.0 * both, sum_)


def iou(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    both, sum_ = _counts(cut(a), cut(b))
    return _ratio(both, sum_ - both)


def red_lesions(im: np.ndarray, threshold: float = 0.5) -> np.ndarray:
    """Where the first channel is over the threshold (of 255, where the image's maximum is over 1): 255, else 0. A gray image stands for three equal channels."""
    top = np.where(im.max((1, 2, 3), keepdims=True) > 1, 255.0, 1.0)
    return (im[..., :1] / top > threshold) * 255.0


METRICS = {"mse": mse, "mae": mae, "ssim": global_ssim, "windowed_ssim": windowed_ssim, "dice": dice, "iou": iou}


def _rows(keys: pa.Array, part: np.ndarray, values: np.ndarray | None, names: list[str]) -> pa.RecordBatch:
    """``values``: a row of numbers for each name; what is undefined becomes null."""
    cols = [pa.nulls(len(part), pa.float64()) if values is None else pa.array(v, pa.float64(), from_pandas=True) for v in ([None] * (len(names) - 1) if values is None else values.T)]
    return pa.RecordBatch.from_arrays([keys.take(pa.array(part)), *cols], names=names)


def pair_scores(pairs: DataFrame, metrics: tuple[str, ...], key: str = "image_id") -> DataFrame:
    """``pairs``: key, height, width, channels, px_a, px_b. The key and the ``metrics`` (of METRICS). Where a metric has no value (as windowed similarity has none for an
    image smaller than its window) all of the row's are null; repeated keys stay; an empty table gives an empty result."""
    kind, names, of = pairs.schema[key].dataType.simpleString(), [key, *metrics], [METRICS[m] for m in metrics]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, ims in stacks(b, 2):
                for some, v in _each(lambda x, y, _: np.stack([f(x, y) for f in of], 1), part, ims, {}) if ims else [(part, None)]:
                    yield _rows(b.column(0), some, v, names)

    return pairs.select(key, "height", "width", "channels", "px_a", "px_b").mapInArrow(run, f"{key} {kind}, " + ", ".join(f"{m} double" for m in metrics))


def _with_mask(b: pa.RecordBatch, images: int) -> Iterator[tuple[np.ndarray, list[np.ndarray] | None]]:
    """Batches of key, height, width, channels, px of ``images`` images and then of a mask: the stacks of rows that have a mask, and of those that have
    none."""
    at = lambda c, k: c.column(1 + k)
    there = b.column(b.num_columns - 1).is_valid().to_numpy(zero_copy_only=False)
    for rows, n in ((np.flatnonzero(there), images + 1), (np.flatnonzero(~there), images)):
        if len(rows):
            c = b.take(pa.array(rows))
            for part, ims in shaped([at(c, 4 * k + j) for k in range(n) for j in range(3)], [at(c, 4 * k + 3) for k in range(n)]):
                yield rows[part], ims


def _scored(rows: DataFrame, key: str, of: tuple[str, ...], images: int, fn) -> DataFrame:
    kind, names = rows.schema[key].dataType.simpleString(), [key, *of]
    cols = [f"{c}_{x}" for x in [*"ab"[:images], "m"] for c in ("height", "width", "channels", "px")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, ims in _with_mask(b, images):
                for some, v in _each(lambda *x: fn(*x[:-1]), part, ims, {}) if ims else [(part, None)]:
                    yield _rows(b.column(0), some, v, names)

    return rows.select(key, *cols).mapInArrow(run, f"{key} {kind}, " + ", ".join(f"{m} double" for m in of))


def _structure(found: np.ndarray, mask: np.ndarray | None) -> list[np.ndarray]:
    """Dice and IoU of lesions against a mask, which is resized to them (nearest neighbour) and of which the first channel counts."""
    if mask is None:
        return [np.full(len(found), np.nan)] * 2
    mask = nearest(mask, *found.shape[1:3])[..., :1]
    return [dice(found, mask), iou(found, mask)]


def evaluate(pairs: DataFrame, key: str = "image_id") -> DataFrame:
    """``pairs``: key, and height, width, channels and px of a generated image (``_a``), its reference (``_b``) and its input mask (``_m``, null where it has none). Returns
    key, mse, mae, ssim (windowed), dice, iou (of the generated image's lesions against the mask). A generated image of another size is
    resampled to its reference (Lanczos), a mask to both. A pair that cannot be compared has nulls."""

    def one(a: np.ndarray, b: np.ndarray, mask: np.ndarray | None = None) -> np.ndarray:
        if a.shape[1:3] != b.shape[1:3]:
            a = resample(a, *b.shape[1:3])
        if a.shape != b.shape:
            raise ValueError("images differ in channels")
        small = min(a.shape[1:3]) < 7
        return np.stack([mse(a, b), mae(a, b), np.full(len(a), np.nan) if small else windowed_ssim(a, b), *_structure(red_lesions(a), mask)], 1)

    return _scored(pairs, key, ("mse", "mae", "ssim", "dice", "iou"), 2, one)


def structure_scores(images: DataFrame, key: str = "image_id") -> DataFrame:
    """``images``: key, and height, width, channels and px of an image (``_a``) and its input mask (``_m``, null where it has none). Returns key, dice, iou of the image's red
    lesions against the mask; null where there is no mask or the pair fails."""
    return _scored(images, key, ("dice", "iou"), 1, lambda a, mask=None: np.stack(_structure(red_lesions(a), mask), 1))
