"""Numpy kernels for what array expressions cannot say well, applied to Arrow batches of images.

An image is (height, width, channels, px). The images of one shape in a batch are stacked to (n, h, w, c), and a kernel runs on the
stack; an image that fails keeps its key and gets null pixels, so one bad image never stops a job.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.image import LUMA

#: Values that a stack holds, at most (one image at least).
STACK = 8_000_000


def _values(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All values of a column of pixels (lists, or packed bytes) in a row, and where each image starts and how many values it has (-1: null)."""
    if pa.types.is_binary(col.type):
        n = pc.fill_null(pc.binary_length(col), -1).to_numpy(zero_copy_only=False)
        ends = np.frombuffer(col.buffers()[1], np.int32)[col.offset : col.offset + len(col) + 1]
        return np.frombuffer(col.buffers()[2] or b"", np.uint8), ends[:-1].astype(np.int64), n
    px = col.cast(pa.list_(pa.float64()))
    n = pc.fill_null(pc.list_value_length(px), -1).to_numpy(zero_copy_only=False)
    return px.flatten().to_numpy(zero_copy_only=False), np.cumsum(np.maximum(n, 0)) - np.maximum(n, 0), n


def shaped(shapes: list[pa.Array], pixels: list[pa.Array]) -> Iterator[tuple[np.ndarray, list[np.ndarray] | None]]:
    """Row numbers and the (n, h, w, c) stacks of their images, rows of like shapes together. ``shapes``: height, width, channels of each of the
    ``pixels`` columns, one after the other. Rows of which an image is null or does not fit its shape come with None."""
    shape = np.stack([pc.fill_null(c, 0).to_numpy(zero_copy_only=False) for c in shapes], 1).astype(np.int64)
    sizes = shape.reshape(len(shape), -1, 3).prod(2)
    ok, flat, start = (sizes > 0).all(1), [], []
    for k, col in enumerate(pixels):
        f, s, n = _values(col)
        ok &= n == sizes[:, k]
        flat.append(f)
        start.append(s)
    if (~ok).any():
        yield np.flatnonzero(~ok), None
    rows = np.flatnonzero(ok)
    kinds, which = np.unique(shape[rows], axis=0, return_inverse=True)
    for k, kind in enumerate(kinds):
        mine = rows[which.ravel() == k]
        each = kind.reshape(-1, 3)
        step = max(1, STACK // int(each.prod(1).max()))
        for at in range(0, len(mine), step):
            part = mine[at : at + step]
            yield part, [np.stack([f[a : a + n] for a in s[part]]).astype(np.float64).reshape(-1, *one) for f, s, one, n in zip(flat, start, each, each.prod(1))]


def stacks(b: pa.RecordBatch, images: int) -> Iterator[tuple[np.ndarray, list[np.ndarray] | None]]:
    """``shaped`` for batches of key, height, width, channels, then ``images`` columns of pixels that share the shape."""
    return shaped([b.column(1), b.column(2), b.column(3)] * images, [b.column(4 + k) for k in range(images)])


def _each(fn: Callable, part: np.ndarray, ims: list[np.ndarray], rows: dict) -> Iterator[tuple[np.ndarray, np.ndarray | None]]:
    """``fn`` over the stack, or where that fails, image by image."""
    try:
        yield part, fn(*ims, rows)
    except (TypeError, ValueError):
        for j in range(len(part)):
            try:
                yield part[j : j + 1], fn(*[s[j : j + 1] for s in ims], {c: v[j : j + 1] for c, v in rows.items()})
            except (TypeError, ValueError):
                yield part[j : j + 1], None


def map_images(df: DataFrame, fn: Callable[[np.ndarray, dict], np.ndarray], key: str = "image_id", extra: tuple[str, ...] = (), packed: bool = False) -> DataFrame:
    """key, height, width, channels, px (doubles; ``packed``: bytes) of ``fn(stack, rows)``; ``extra`` names columns whose values ``fn`` gets as arrays in ``rows``."""
    kind = df.schema[key].dataType.simpleString()
    names = [key, "height", "width", "channels", "px"]
    types = [pa.int32(), pa.int32(), pa.int32(), pa.binary() if packed else pa.list_(pa.float64())]

    def run(batches):
        for b in batches:
            for part, ims in stacks(b, 1):
                rows = {c: b.column(5 + k).take(pa.array(part)).to_numpy(zero_copy_only=False) for k, c in enumerate(extra)}
                for some, im in _each(fn, part, ims, rows) if ims else [(part, None)]:
                    n, keys = len(some), b.column(0).take(pa.array(some))
                    if im is None:
                        cols = [pa.nulls(n, t) for t in types]
                    else:
                        ends = pa.array(np.arange(n + 1, dtype=np.int32) * int(np.prod(im.shape[1:])))
                        px = pa.array([x.tobytes() for x in im.astype(np.uint8)], pa.binary()) if packed else pa.ListArray.from_arrays(ends, pa.array(np.ascontiguousarray(im, float).ravel()))
                        cols = [*(pa.array(np.full(n, x, np.int32)) for x in im.shape[1:]), px]
                    yield pa.RecordBatch.from_arrays([keys, *cols], names=names)

    return df.select(key, "height", "width", "channels", "px", *extra).mapInArrow(run, f"{key} {kind}, height int, width int, channels int, px {'binary' if packed else 'array<double>'}")


def _replaced(df: DataFrame, px: str, make: Callable[[pa.Array], pa.Array], kind: str) -> DataFrame:
    fields = ", ".join(f"`{f.name}` {kind if f.name == px else f.dataType.simpleString()}" for f in df.schema)
    at = df.columns.index(px)

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([make(c) if k == at else c for k, c in enumerate(b.columns)], names=b.schema.names)

    return df.mapInArrow(run, fields)


def pack(df: DataFrame, px: str = "px") -> DataFrame:
    """The arrays of pixels in ``px`` as packed bytes, a quarter of the size; the other columns stay. Nulls stay null; values beyond 0 to 255 are an error."""

    def make(col: pa.Array) -> pa.Array:
        flat, start, n = _values(col)
        if len(flat) and (flat.min() < 0 or flat.max() > 255):
            raise ValueError("pixels must lie within 0 and 255")
        flat = flat.astype(np.uint8)
        return pa.array([None if k < 0 else flat[a : a + k].tobytes() for a, k in zip(start, n)], pa.binary())

    return _replaced(df, px, make, "binary")


def unpack(df: DataFrame, px: str = "px") -> DataFrame:
    """Packed bytes as arrays of integers; nulls stay null."""

    def make(col: pa.Array) -> pa.Array:
        flat, start, n = _values(col)
        return pa.array([None if k < 0 else flat[a : a + k].astype(np.int32) for a, k in zip(start, n)], pa.list_(pa.int32()))

    return _replaced(df, px, make, "array<int>")


def to_luma(im: np.ndarray, rows: dict | None = None) -> np.ndarray:
    """One channel: the luma of three or more, else the first."""
    if im.shape[3] < 3:
        return im[..., :1]
    return (im[..., :3].astype(np.int64) @ np.array(LUMA) + 32768 >> 16)[..., None].astype(float)


#: Weights are multiples of 1 / FIXED, so that sums of bytes are exact and no engine rounds a half the other way.
FIXED = 1 << 22


def _weights(size: int, out: int, support: float, kernel) -> np.ndarray:
    """The (out, size) matrix of a separable resampling; shrinking widens the kernel."""
    scale = max(size / out, 1.0)
    centre = (np.arange(out) + 0.5) * size / out
    x = (np.arange(size)[None, :] + 0.5 - centre[:, None]) / scale
    w = np.where(np.abs(x) <= support, kernel(x), 0.0)
    w = w / w.sum(1, keepdims=True)
    return np.trunc(w * FIXED + np.copysign(0.5, w)) / FIXED


def _lanczos(x: np.ndarray) -> np.ndarray:
    return np.sinc(x) * np.sinc(x / 3)


def _cubic(x: np.ndarray) -> np.ndarray:
    a, x = -0.5, np.abs(x)
    return np.where(x < 1, (a + 2) * x**3 - (a + 3) * x**2 + 1, a * x**3 - 5 * a * x**2 + 8 * a * x - 4 * a)


def _box(x: np.ndarray) -> np.ndarray:
    return ((x > -0.5) & (x <= 0.5)).astype(float)


_FILTERS = {"lanczos": (3.0, _lanczos), "bicubic": (2.0, _cubic), "box": (0.5, _box)}


def to_byte(x: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(x + 0.5), 0, 255)


def resample(im: np.ndarray, height: int, width: int, method: str = "lanczos") -> np.ndarray:
    """Along the rows, then along the columns; 8-bit values after each, as 8-bit resamplers have it."""
    support, kernel = _FILTERS[method]
    if im.shape[2] != width:
        im = to_byte(np.einsum("pw,nhwc->nhpc", _weights(im.shape[2], width, support, kernel), im))
    if im.shape[1] != height:
        im = to_byte(np.einsum("oh,nhwc->nowc", _weights(im.shape[1], height, support, kernel), im))
    return im


def nearest(im: np.ndarray, height: int, width: int) -> np.ndarray:
    """Nearest neighbour at half-pixel centres."""
    y, x = (np.minimum(((np.arange(n) + 0.5) * size / n).astype(int), size - 1) for n, size in ((height, im.shape[1]), (width, im.shape[2])))
    return im[:, y][:, :, x]


def _odd(k: int) -> int:
    return k + 1 if k % 2 == 0 else k


def gaussian(im: np.ndarray, kernel_size: int = 5, sigma: float = 1.0) -> np.ndarray:
    """Separable blur with mirrored borders; an even size is taken one larger."""
    r = _odd(kernel_size) // 2
    w = np.exp(-(np.arange(-r, r + 1) ** 2) / (2 * sigma**2))
    w /= w.sum()
    for axis in (1, 2):
        pad = [(0, 0)] * 4
        pad[axis] = (r, r)
        p = np.pad(im, pad, mode="reflect")
        im = sum(c * np.take(p, np.arange(k, k + im.shape[axis]), axis) for k, c in enumerate(w))
    return to_byte(im)


def median(im: np.ndarray, kernel_size: int = 5) -> np.ndarray:
    """Median of the square around each pixel, borders repeated; an even size is taken one larger. A few rows at a time, since every pixel
    becomes a whole square of them."""
    k = _odd(kernel_size)
    p = np.pad(im, ((0, 0), (k // 2, k // 2), (k // 2, k // 2), (0, 0)), mode="edge")
    out = np.empty_like(im)
    step = max(1, STACK // (k * k * im[0, 0].size))
    for one, padded in zip(out, p):
        for at in range(0, len(one), step):
            view = np.lib.stride_tricks.sliding_window_view(padded[at : at + step + k - 1], (k, k), (0, 1))
            one[at : at + step] = np.median(view, axis=(-2, -1))
    return out


def denoise(im: np.ndarray, method: str, kernel_size: int = 5, sigma: float = 1.0) -> np.ndarray:
    """An unknown method leaves the images as they are."""
    return {"gaussian": lambda: gaussian(im, kernel_size, sigma), "median": lambda: median(im, kernel_size)}.get(method, lambda: im)()


def denoise_each(im: np.ndarray, methods: np.ndarray) -> np.ndarray:
    """``denoise`` with a method for each image."""
    out = im.copy()
    for m in set(methods.tolist()):
        out[methods == m] = denoise(im[methods == m], m)
    return out


def prepare(im: np.ndarray, size: int, denoising: str | None = None, normalise: bool = True) -> np.ndarray:
    """The preparation chain: three channels, Lanczos resize, optional denoising, scale to [0, 1], optional [-1, 1]."""
    im = np.repeat(im, 3, axis=3) if im.shape[3] == 1 else im
    im = resample(im, size, size)
    im = denoise(im, denoising) if denoising else im
    im = im / 255.0
    return im * 2 - 1 if normalise else im


def rotate(im: np.ndarray, degrees: np.ndarray) -> np.ndarray:
    """Nearest-neighbour rotation of each image around its centre, zero outside."""
    n, h, w, _ = im.shape
    y, x = np.mgrid[:h, :w]
    a = np.deg2rad(np.asarray(degrees, float))[:, None, None]
    cy, cx = (h - 1) / 2, (w - 1) / 2
    sy = np.floor(np.sin(a) * (x - cx) + np.cos(a) * (y - cy) + cy + 0.5).astype(int)
    sx = np.floor(np.cos(a) * (x - cx) - np.sin(a) * (y - cy) + cx + 0.5).astype(int)
    inside = (sy >= 0) & (sy < h) & (sx >= 0) & (sx < w)
    return np.where(inside[..., None], im[np.arange(n)[:, None, None], np.clip(sy, 0, h - 1), np.clip(sx, 0, w - 1)], 0)


def center_crop(im: np.ndarray, size: int) -> np.ndarray:
    """Halve with boxes while the short side is at least twice ``size`` (odd sides lose half a pixel into its neighbours), scale it to
    ``size``, cut the centre."""
    while min(im.shape[1:3]) >= 2 * size:
        im = resample(im, im.shape[1] // 2, im.shape[2] // 2, "box")
    scale = size / min(im.shape[1:3])
    im = resample(im, round(im.shape[1] * scale), round(im.shape[2] * scale), "bicubic")
    top, left = (im.shape[1] - size) // 2, (im.shape[2] - size) // 2
    return im[:, top : top + size, left : left + size]


def _window_means(x: np.ndarray, window: int) -> np.ndarray:
    """Means of all windows, by running sums along either axis."""
    for axis in (1, 2):
        s = np.cumsum(x, axis=axis)
        cut = lambda a, z: (*[slice(None)] * axis, slice(a, z))  # noqa: B023, E731
        x = s[cut(window - 1, None)].copy()
        x[cut(1, None)] -= s[cut(0, -window)]
    return x / (window * window)


def windowed_ssim(a: np.ndarray, b: np.ndarray, window: int = 7, data_range: float = 255.0) -> np.ndarray:
    """Mean structural similarity of each pair over uniform windows, sample covariances, averaged over channels."""
    if a.shape != b.shape or min(a.shape[1:3]) < window:
        raise ValueError("images differ in shape or are smaller than the window")
    mean = lambda x: _window_means(x, window)
    fix = window * window / (window * window - 1)
    mx, my = mean(a), mean(b)
    vx, vy, cov = fix * (mean(a * a) - mx**2), fix * (mean(b * b) - my**2), fix * (mean(a * b) - mx * my)
    c1, c2 = (0.01 * data_range) ** 2, (0.03 * data_range) ** 2
    return (((2 * mx * my + c1) * (2 * cov + c2)) / ((mx**2 + my**2 + c1) * (vx + vy + c2))).mean((1, 2, 3))


def pair_ssim(pairs: DataFrame, key: str = "image_id", window: int = 7) -> DataFrame:
    """``pairs``: key, height, width, channels, px_a, px_b. Adds ssim; null where shapes differ or the image is smaller than the window."""
    kind = pairs.schema[key].dataType.simpleString()

    def run(batches):
        for b in batches:
            for part, ims in stacks(b, 2):
                for some, s in _each(lambda x, y, _: windowed_ssim(x, y, window), part, ims, {}) if ims else [(part, None)]:
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(some)), pa.nulls(len(some), pa.float64()) if s is None else pa.array(s)], names=[key, "ssim"])

    return pairs.select(key, "height", "width", "channels", "px_a", "px_b").mapInArrow(run, f"{key} {kind}, ssim double")


def align(pairs: DataFrame, key: str = "image_id") -> DataFrame:
    """``pairs``: key, and for a generated image (``_a``) and its reference (``_b``) height, width, channels and px. px_a of another size is
    resampled to that of its reference (Lanczos); the rows keep height, width and channels of the reference."""
    names = [f"{c}_{x}" for x in "ab" for c in ("height", "width", "channels", "px")]
    rest = [c for c in pairs.columns if c not in names]
    odd = (F.col("height_a") != F.col("height_b")) | (F.col("width_a") != F.col("width_b"))
    plain = lambda d, px: d.select(*rest, *[F.col(f"{c}_b").alias(c) for c in ("height", "width", "channels")], px.cast("array<double>").alias("px_a"), F.col("px_b").cast("array<double>").alias("px_b"))

    def fit(im: np.ndarray, rows: dict) -> np.ndarray:
        h, w = {*rows["height_b"].tolist()}, {*rows["width_b"].tolist()}
        if len(h) > 1 or len(w) > 1:
            raise ValueError("targets differ")  # each image by itself
        return resample(im, h.pop(), w.pop())

    other = pairs.filter(odd)
    fitted = map_images(other.select(key, *[F.col(f"{c}_a").alias(c) for c in ("height", "width", "channels", "px")], "height_b", "width_b"), fit, key, ("height_b", "width_b"))
    fitted = fitted.select(F.col(key).alias("_k"), F.col("px").alias("_px"))
    return plain(pairs.filter(~odd), F.col("px_a")).unionByName(plain(other.join(fitted.hint("merge"), F.col(key) == F.col("_k")), F.col("_px")))


def _maxima(key: str, spare: int) -> Callable:
    """Batches of key, salt, height, width, px -> the pixel-wise maximum of the masks of each key and salt. Up to ``spare`` values are held at a time; when there are more, what
    has been gathered is given out, to be merged later."""
    names = [key, "salt", "height", "width", "px"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        room = spare

        def give(kinds) -> pa.RecordBatch:
            cols = [[k[j] for k in held] for j in range(4)] + [[v.tobytes() for v in held.values()]]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=names)

        kinds = None
        for b in batches:
            kinds = [b.column(j).type for j in range(5)]
            for *at, px in zip(*(b.column(j).to_pylist() for j in range(5))):
                new, old = np.frombuffer(px, np.uint8), held.get(tuple(at))
                if old is None:
                    held[tuple(at)] = new.copy()
                    room -= len(new)
                    if room < 0:
                        yield give(kinds)
                        room = spare
                else:
                    np.maximum(old, new, out=old)
        if held:
            yield give(kinds)

    return run


#: Values of masks that a task of ``merge_masks`` holds, and salts over which the masks of one image are spread.
HELD, SALTS = 64_000_000, 32


def merge_masks(masks: DataFrame, key: str = "image_id") -> DataFrame:
    """``masks``: key, height, width, px (packed, one channel). The pixel-wise maximum of all masks of an image: key, height, width, px.

    Each task first merges what it reads, so few rows of an image are shuffled; these meet by image and salt, and then by image. Rows stand by image there, so
    a task holds one mask at a time (before the shuffles: HELD values), and an image may have any number of masks. Masks of one image must share their size, else
    each size gives a row; null pixels are left out; an empty table gives an empty result."""
    kind = f"{key} {masks.schema[key].dataType.simpleString()}, salt int, height int, width int, px binary"
    n = int(masks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salt = F.pmod(F.spark_partition_id(), F.lit(SALTS)).cast("int").alias("salt")
    out = masks.filter(F.col("px").isNotNull()).select(key, salt, "height", "width", "px").mapInArrow(_maxima(key, HELD), kind)
    for by in ([key, "salt"], [key]):
        rows = out.repartition(n, *by).select(key, F.col("salt") if len(by) > 1 else F.lit(0).alias("salt"), "height", "width", "px")
        out = rows.sortWithinPartitions(*by, "height", "width").mapInArrow(_sorted_maxima(key), kind)
    return out.drop("salt")


def _sorted_maxima(key: str) -> Callable:
    """``_maxima`` for rows that stand together by key, salt and size: one mask is held."""
    names = [key, "salt", "height", "width", "px"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, kinds = None, None, None
        for b in batches:
            kinds, done = [b.column(j).type for j in range(5)], []
            for *at, px in zip(*(b.column(j).to_pylist() for j in range(5))):
                new = np.frombuffer(px, np.uint8)
                if held is not None and at == now:
                    np.maximum(held, new, out=held)
                else:
                    if held is not None:
                        done.append((*now, held.tobytes()))
                    now, held = at, new.copy()
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), kinds)], names=names)
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip((*now, held.tobytes()), kinds)], names=names)

    return run


def median_exploded(images: DataFrame, kernel_size: int = 3) -> DataFrame:
    """The median filter of one-channel images as rows: image_id, y, x, v. Every pixel meets its neighbours by a generated offset and
    the border is repeated by clamping, so no join is needed."""
    r = _odd(kernel_size) // 2
    px = F.col("px")
    grid = F.transform(F.sequence(F.lit(0), F.col("height") * F.col("width") - 1), lambda i: F.struct((i / F.col("width")).cast("int").alias("y"), (i % F.col("width")).cast("int").alias("x")))

    def value(p):
        around = [F.get(px, F.greatest(F.lit(0), F.least(F.col("height") - 1, p["y"] + dy)) * F.col("width") + F.greatest(F.lit(0), F.least(F.col("width") - 1, p["x"] + dx))) for dy in range(-r, r + 1) for dx in range(-r, r + 1)]
        return F.struct(p["y"].alias("y"), p["x"].alias("x"), F.get(F.sort_array(F.array(*around)), len(around) // 2).alias("v"))

    return images.select("image_id", F.inline(F.transform(grid, value)))
