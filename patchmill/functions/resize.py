"""Resizing of images and score maps: tables of taps for SQL, and the same in numpy."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def bilinear_taps(n: int, out: int) -> list[tuple[int, int, float]]:
    """(output place, input place, weight) along one axis, pixel centres aligned, no antialiasing."""
    taps = []
    for i in range(out):
        at = max(0.0, (i + 0.5) * n / out - 0.5)
        low = min(int(at), n - 1)
        high, f = min(low + 1, n - 1), at - low
        taps += [(i, low, 1.0)] if high == low or f == 0 else [(i, low, 1 - f), (i, high, f)]
    return taps


def _cubic(x: float, a: float = -0.5) -> float:
    x = abs(x)
    if x < 1:
        return ((a + 2) * x - (a + 3)) * x * x + 1
    return (((x - 5) * x + 8) * x - 4) * a if x < 2 else 0.0


def bicubic_taps(n: int, out: int, antialias: bool = True) -> list[tuple[int, int, float]]:
    """(output place, input place, weight); when shrinking with antialias the kernel is as wide as the step."""
    scale = n / out
    wide = max(scale, 1.0) if antialias else 1.0
    taps = []
    for i in range(out):
        centre = (i + 0.5) * scale
        low, high = max(0, int(centre - 2 * wide + 0.5)), min(n, int(centre + 2 * wide + 0.5))
        w = [_cubic((j + 0.5 - centre) / wide) for j in range(low, high)]
        total = sum(w)
        taps += [(i, low + j, v / total) for j, v in enumerate(w) if v]
    return taps


def matrix(taps: list[tuple[int, int, float]], n: int, out: int) -> np.ndarray:
    m = np.zeros((out, n))
    for o, i, w in taps:
        m[o, i] += w
    return m


def resize(image: np.ndarray, height: int, width: int, kind: str = "bilinear") -> np.ndarray:
    """(..., h, w) to (..., height, width)."""
    taps = {"bilinear": bilinear_taps, "bicubic": bicubic_taps}[kind]
    h, w = image.shape[-2:]
    return matrix(taps(h, height), h, height) @ image @ matrix(taps(w, width), w, width).T


def nearest(image: np.ndarray, height: int, width: int) -> np.ndarray:
    h, w = image.shape[-2:]
    return image[..., (np.arange(height) * h // height)[:, None], np.arange(width) * w // width]


def shrunk(height: int, width: int, factor: float) -> tuple[int, int]:
    """The size after a factor, cut to whole pixels."""
    return int(height * factor), int(width * factor)


def binary_mask(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Grey mask (0..255) to 0/1 of another size by the nearest pixel."""
    return (nearest(image, height, width) > 127.5).astype(np.uint8)


def truth_mask(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """0/1 mask resized as whole numbers, bilinear, and taken as true where anything is left."""
    return (np.rint(resize(image.astype(float), height, width)) > 0).astype(np.uint8)


def resize_pixels(pixels: DataFrame, keys: list[str], size: tuple[int, int], to: tuple[int, int], value: str = "score", kind: str = "bilinear") -> DataFrame:
    """(keys, y, x, value) of maps of one size brought to another by weighted sums of their pixels.

    The taps of either axis are at most a few for each output place: their tables are as small as a side of the map.
    """
    spark: SparkSession = pixels.sparkSession
    taps = {"bilinear": bilinear_taps, "bicubic": bicubic_taps}[kind]
    ys = spark.createDataFrame(taps(size[0], to[0]), "oy int, y int, wy double")
    xs = spark.createDataFrame(taps(size[1], to[1]), "ox int, x int, wx double")
    rows = pixels.join(F.broadcast(ys), "y").groupBy(*keys, "oy", "x").agg(F.sum(F.col(value) * F.col("wy")).alias(value))
    out = rows.join(F.broadcast(xs), "x").groupBy(*keys, "oy", "ox").agg(F.sum(F.col(value) * F.col("wx")).alias(value))
    return out.select(*keys, F.col("oy").alias("y"), F.col("ox").alias("x"), value)
