"""Vector columns: pair construction, norms, pooling, scores."""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import mix_hash, unit


def doubles(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def square_sum(v: Column) -> Column:
    return F.aggregate(doubles(v), F.lit(0.0), lambda a, x: a + x * x)


def draw_time(key: Column, seed: int, kind: str = "uniform", low: float = 0.0, high: float = 1.0, shift: float = 1.0) -> Column:
    """Interpolation time by hash: uniform, uniform_a_b, lognorm (logistic of a normal) or shift_f."""
    u = unit(mix_hash(key, seed))
    if kind == "uniform":
        return u
    if kind == "uniform_a_b":
        return low + (high - low) * u
    if kind == "lognorm":
        v = unit(mix_hash(key, seed + 1))
        normal = F.sqrt(-2 * F.log(1 - u)) * F.cos(2 * math.pi * v)
        return 1 / (1 + F.exp(-normal))
    if kind == "shift_f":
        return shift * u / (1 + (shift - 1) * u)
    raise ValueError(f"unknown time distribution: {kind}")


def coefficients(t: Column, path: str) -> tuple[Column, Column, Column, Column]:
    """alpha, sigma and their derivatives at time ``t``."""
    if path == "linear":
        return t, 1 - t, F.lit(1.0), F.lit(-1.0)
    if path == "vp":
        lo, hi = 0.1, 20.0
        s = 1 - t
        log_a = -s * s * (hi - lo) / 4 - s * lo / 2
        d_log = s * (hi - lo) / 2 + lo / 2
        a = F.exp(log_a)
        sig = F.sqrt(1 - F.exp(2 * log_a))
        return a, sig, d_log * a, -d_log * F.exp(2 * log_a) / sig
    if path == "gvp":
        h = math.pi / 2
        return F.sin(h * t), F.cos(h * t), h * F.cos(h * t), -h * F.sin(h * t)
    raise ValueError(f"unknown path: {path}")


def build_pair(x1: Column, x0: Column, t: Column, path: str = "linear") -> tuple[Column, Column]:
    """The interpolated vector and its target velocity."""
    a, s, da, ds = coefficients(t, path)
    mix = lambda p, q: F.zip_with(x1, x0, lambda u, v: p * u + q * v)
    return mix(a, s), mix(da, ds)


def pooled(tokens: DataFrame, key: str, vector: str, mask: str) -> DataFrame:
    """Masked mean of token vectors per key and dimension; null where every token is masked."""
    rows = tokens.select(key, F.col(mask).cast("double").alias("_m"), F.posexplode(vector).alias("dim", "v"))
    return rows.groupBy(key, "dim").agg(F.try_divide(F.sum(F.col("v").cast("double") * F.col("_m")), F.sum("_m")).alias("mean"))


def with_clip_scale(vectors: DataFrame, vector: str, clip: float) -> DataFrame:
    """Add the global L2 norm over all vectors and the factor that brings it under ``clip``."""
    norm = vectors.agg(F.sqrt(F.sum(square_sum(F.col(vector)))).alias("norm"))
    return vectors.join(F.broadcast(norm)).withColumn("scale", F.least(F.lit(1.0), F.try_divide(F.lit(clip), F.col("norm"))))


def log_density(v: Column) -> Column:
    """Log density under a standard normal."""
    return -F.size(v) / 2.0 * math.log(2 * math.pi) - square_sum(v) / 2.0


def mean_square_error(a: Column, b: Column) -> Column:
    d = F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y))
    return F.aggregate(d, F.lit(0.0), lambda s, x: s + x) / F.size(a)
