"""Images as array columns: ``px`` in row-major order, channels last. Everything here is a Column expression."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

C = Column

#: Luma weights of 8-bit conversion, and the two sets of channel means and deviations.
LUMA = (19595, 38470, 7471)
NORMALIZE = {"imagenet": ((0.485, 0.456, 0.406), (0.229, 0.224, 0.225)), "half": ((0.5, 0.5, 0.5), (0.5, 0.5, 0.5))}


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once per row, and not once per element of a lambda inside."""
    return F.get(F.transform(F.array(value), body), 0)


def _range(n: Column) -> Column:
    """0 .. n - 1, empty for n = 0."""
    return F.when(n > 0, F.sequence(F.lit(0), n.cast("int") - 1)).otherwise(F.array().cast("array<int>"))


def pixels(px: C, channels: int) -> C:
    """One array of channel values per pixel."""
    return F.transform(_range(F.size(px) / channels), lambda i: F.slice(px, i * channels + 1, channels))


def nearest_resize(px: C, height: C, width: C, out_h: C | int, out_w: C | int) -> C:
    """Nearest neighbour at half-pixel centres; label values stay as they are."""
    out_h, out_w = (F.lit(n) if isinstance(n, int) else n for n in (out_h, out_w))
    row = lambda i: F.floor(((i / out_w).cast("int") + 0.5) * height / out_h).cast("int")
    col = lambda i: F.floor((i % out_w + 0.5) * width / out_w).cast("int")
    return F.transform(F.sequence(F.lit(0), out_h * out_w - 1), lambda i: F.get(px, row(i) * width + col(i)))


def gray_to_rgb(px: C) -> C:
    return F.flatten(F.transform(px, lambda p: F.array(p, p, p)))


def rgb_to_luma(px: C) -> C:
    r, g, b = LUMA
    return F.transform(pixels(px, 3), lambda p: F.shiftright(F.get(p, 0) * r + F.get(p, 1) * g + F.get(p, 2) * b + 32768, 16))


def channel_mean(px: C) -> C:
    return F.transform(pixels(px, 3), lambda p: (F.get(p, 0) + F.get(p, 1) + F.get(p, 2)) / 3.0)


def scale_unit(px: C, symmetric: bool = False) -> C:
    """To [0, 1]; ``symmetric``: on to [-1, 1]."""
    return F.transform(px, (lambda p: p / 255.0 * 2.0 - 1.0) if symmetric else (lambda p: p / 255.0))


def standardise(px: C, constants: str = "imagenet") -> C:
    mean, std = (F.array(*[F.lit(x) for x in c]) for c in NORMALIZE[constants])
    return F.transform(px, lambda p, i: (p / 255.0 - F.get(mean, i % 3)) / F.get(std, i % 3))


def to_bytes(x: C) -> C:
    """From [-1, 1] to 0..255: clamped and truncated."""
    return F.transform(x, lambda v: F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (v.cast("double") + 1.0) / 2.0)) * 255.0).cast("int"))


def channel_max(px: C, channels: int) -> C:
    return F.transform(pixels(px, channels), lambda p: F.array_max(p))


def _unit(px: C) -> C:
    return let(F.array_max(px), lambda top: F.transform(px, lambda p: F.when(top > 1, p / 255.0).otherwise(p.cast("double"))))


def lesion_red(px: C, t: float) -> C:
    return let(_unit(px), lambda u: F.transform(pixels(u, 3), lambda p: F.when(F.get(p, 0) > t, 1).otherwise(0)))


def lesion_saturation(px: C, t: float) -> C:
    def one(p: C) -> C:
        hi, lo = F.array_max(p), F.array_min(p)
        return F.when(F.when(hi == lo, 0.0).otherwise((hi - lo) / hi) > t, 1).otherwise(0)

    return let(_unit(px), lambda u: F.transform(pixels(u, 3), one))


def lesion_brightness(px: C, t: float) -> C:
    return let(_unit(px), lambda u: F.transform(pixels(u, 3), lambda p: F.when((F.get(p, 0) + F.get(p, 1) + F.get(p, 2)) / 3.0 < 1.0 - t, 1).otherwise(0)))


LESION_METHODS = {"red_channel": lesion_red, "saturation": lesion_saturation, "brightness": lesion_brightness}


def lesion_mask(px: C, method: str = "red_channel", threshold: float = 0.5) -> C:
    if method not in LESION_METHODS:
        raise ValueError(f"unknown lesion extraction method: {method}")
    return LESION_METHODS[method](px, threshold)


def normalize_mask(px: C, max_value: float = 255.0) -> C:
    return F.transform(px, lambda p: p / max_value)


def binarize_mask(px: C, t: float = 0.5) -> C:
    return F.transform(px, lambda p: F.when(p > t, 1.0).otherwise(0.0))


def bilinear_resize(px: C, height: C, width: C, out_h: int, out_w: int) -> C:
    """Bilinear at half-pixel centres without antialiasing, borders repeated."""

    def axis(k: C, size: C, out: int) -> tuple[C, C, C]:
        at = F.greatest((k + 0.5) * size / out - 0.5, F.lit(0.0))
        low = F.least(F.floor(at), size - 1).cast("int")
        return low, F.least(low + 1, size - 1).cast("int"), at - low

    def one(i: C) -> C:
        y0, y1, fy = axis((i / out_w).cast("int"), height, out_h)
        x0, x1, fx = axis(i % out_w, width, out_w)
        v = lambda y, x: F.get(px, y * width + x).cast("double")
        return (v(y0, x0) * (1 - fx) + v(y0, x1) * fx) * (1 - fy) + (v(y1, x0) * (1 - fx) + v(y1, x1) * fx) * fy

    return F.transform(F.sequence(F.lit(0), F.lit(out_h * out_w - 1)), one)


def zero_mask(px: C, height: C, width: C) -> C:
    return F.coalesce(F.transform(px, lambda p: p.cast("double")), F.array_repeat(F.lit(0.0), (height * width).cast("int")))


def append_mask(px: C, mask: C, channels: int) -> C:
    """The mask as one more channel of every pixel."""
    return F.flatten(F.transform(pixels(px, channels), lambda p, i: F.concat(p, F.array(F.get(mask, i)))))


def crop(px: C, width: C, channels: int, top: C, left: C, out_h: C, out_w: C) -> C:
    return F.flatten(F.transform(_range(out_h), lambda r: F.slice(px, (((top + r) * width + left) * channels + 1).cast("int"), (out_w * channels).cast("int"))))


def flip_rows(px: C, height: C, width: C, channels: int) -> C:
    """Mirror left and right."""
    row = lambda r: F.flatten(F.reverse(F.transform(_range(width), lambda c: F.slice(px, ((r * width + c) * channels + 1).cast("int"), channels))))
    return F.flatten(F.transform(_range(height), row))


def jitter(px: C, brightness: C, contrast: C) -> C:
    """Scale around 0 by ``brightness``, then around the image mean by ``contrast``; clamped and truncated."""
    lit = F.transform(px, lambda p: F.least(F.lit(255.0), p * brightness))

    def spread(x: C) -> C:
        return let(F.aggregate(x, F.lit(0.0), lambda a, v: a + v) / F.size(x), lambda mean: F.transform(x, lambda p: F.floor(F.greatest(F.lit(0.0), F.least(F.lit(255.0), mean + (p - mean) * contrast))).cast("int")))

    return let(lit, spread)


def patches(px: C, height: int, width: int, channels: int, p: int) -> C:
    """The image as a sequence of p x p patches, row by row."""
    def one(k: C) -> C:
        y, x = (k / (width // p)).cast("int") * p, k % (width // p) * p
        return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(p - 1)), lambda r: F.slice(px, (((y + r) * width + x) * channels + 1).cast("int"), p * channels)))

    return F.transform(F.sequence(F.lit(0), F.lit((height // p) * (width // p) - 1)), one)


def unpatch(seq: C, height: int, width: int, channels: int, p: int) -> C:
    """The image of its patches; patches beyond the image (padding) are dropped."""
    def one(i: C) -> C:
        pixel, c = (i / channels).cast("int"), i % channels
        y, x = (pixel / width).cast("int"), pixel % width
        k = (y / p).cast("int") * (width // p) + (x / p).cast("int")
        return F.get(F.get(seq, k), ((y % p) * p + x % p) * channels + c)

    return F.transform(F.sequence(F.lit(0), F.lit(height * width * channels - 1)), one)


def pad_patches(seq: C, longest: C) -> tuple[C, C]:
    """A sequence padded with zero patches to ``longest``, and its flags (1: a patch, 0: padding)."""
    blank = F.transform(F.get(seq, 0), lambda v: F.lit(0).cast("int"))
    n, more = F.size(seq), (longest - F.size(seq)).cast("int")
    return F.concat(seq, F.array_repeat(blank, more)), F.concat(F.array_repeat(F.lit(1), n), F.array_repeat(F.lit(0), more))
