"""Column expressions over arrays: pixel and embedding arithmetic that stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from patchmill.functions.settings import CHANNEL_MEAN, CHANNEL_STD


def uniform(key: Column | str, seed: int = 0) -> Column:
    """A number in [0, 1) that depends on key and seed only, so a task that runs again draws the same."""
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 52)).cast("double") / float(1 << 52)


def lcg_uniform(key: Column | str) -> Column:
    """A number in [0, 1) that any SQL engine can compute from an integer key."""
    return F.pmod(F.expr(f"{key} * 1103515245 + 12345") if isinstance(key, str) else key * 1103515245 + 12345, F.lit(2147483648)) / 2147483648.0


def brightness(pixels: Column | str, factor: Column | float) -> Column:
    """Pixels times factor, clipped to 0..1."""
    f = factor if isinstance(factor, Column) else F.lit(factor)
    return F.transform(pixels, lambda x: F.greatest(F.least(x * f, F.lit(1.0)), F.lit(0.0)))


def brightness_factor(key: Column | str, low: float, high: float, seed: int = 0) -> Column:
    """One factor in [low, high) for each key."""
    return F.lit(low) + uniform(key, seed) * (high - low)


def channel_normalize(pixels: Column | str, plane: Column | int, mode: str | None = "imagenet") -> Column:
    """(x - mean) / std by channel of a planar 3-channel array, plane values a channel; mode None changes nothing."""
    if mode is None:
        return F.col(pixels) if isinstance(pixels, str) else pixels
    if mode != "imagenet":
        raise ValueError(f"unknown normalization {mode!r}")
    mean, std = (F.array(*map(F.lit, v)) for v in (CHANNEL_MEAN, CHANNEL_STD))
    channel = lambda i: F.floor(i / plane).cast("int") + 1
    return F.transform(pixels, lambda x, i: (x - F.element_at(mean, channel(i))) / F.element_at(std, channel(i)))


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2_normalize(v: Column | str, eps: float = 1e-12) -> Column:
    """v over its length, or over eps if that is less."""
    length = F.greatest(F.sqrt(dot(v, v)), F.lit(eps))
    return F.transform(v, lambda x: x.cast("double") / length)


def euclidean(a: Column | str, b: Column | str) -> Column:
    gap = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.sqrt(F.aggregate(gap, F.lit(0.0), lambda s, x: s + x))
