"""Clean-up of score maps: closing along lines, filling of holes, erosion.

Each step exists twice: on arrays in numpy, one map in one task, and on tables of foreground pixels as joins and counts.
Structuring elements are lists of (dy, dx); out(p) looks at in(p + d).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Offsets = list[tuple[int, int]]


def line_kernel(radius: int, angle: float, thickness: int = 1) -> np.ndarray:
    """0/1 square of side 2 * radius + 1 with a line through its centre; 0 degrees lies along x."""
    side = 2 * radius + 1
    rad = math.radians(angle)
    dx, dy = radius * math.cos(rad), radius * math.sin(rad)
    a, b = (np.array([round(radius + s * dy), round(radius + s * dx)], float) for s in (-1, 1))
    y, x = np.mgrid[:side, :side].astype(float)
    along = b - a
    length = max(float(along @ along), 1e-9)
    t = np.clip(((y - a[0]) * along[0] + (x - a[1]) * along[1]) / length, 0, 1)
    gap = np.hypot(y - a[0] - t * along[0], x - a[1] - t * along[1])
    return (gap <= (0.5 if thickness <= 1 else thickness / 2) + 1e-9).astype(np.uint8)


def ellipse_kernel(size: int) -> np.ndarray:
    """0/1 filled ellipse of odd side `size`; of side 3 it is a cross."""
    r = size // 2
    k = np.zeros((size, size), np.uint8)
    for i in range(size):
        dx = round(r * math.sqrt(max(0.0, (r * r - (i - r) ** 2) / (r * r)))) if r else 0
        k[i, r - dx : r + dx + 1] = 1
    return k


def offsets(kernel: np.ndarray) -> Offsets:
    """The kernel's set places, counted from its centre (of an even side, the place after the middle)."""
    h, w = kernel.shape
    return [(int(y) - h // 2, int(x) - w // 2) for y, x in zip(*np.nonzero(kernel))]


def _shift(image: np.ndarray, dy: int, dx: int, outside: bool) -> np.ndarray:
    h, w = image.shape
    out = np.full((h, w), outside)
    y0, y1, x0, x1 = max(0, -dy), min(h, h - dy), max(0, -dx), min(w, w - dx)
    if y0 < y1 and x0 < x1:
        out[y0:y1, x0:x1] = image[y0 + dy : y1 + dy, x0 + dx : x1 + dx]
    return out


def dilate(image: np.ndarray, by: Offsets) -> np.ndarray:
    """True where any place of the kernel is; outside counts as false."""
    out = np.zeros(image.shape, bool)
    for d in by:
        out |= _shift(image, *d, False)
    return out


def erode(image: np.ndarray, by: Offsets) -> np.ndarray:
    """True where all places of the kernel are; outside counts as true."""
    out = np.ones(image.shape, bool)
    for d in by:
        out &= _shift(image, *d, True)
    return out


def closing_kernels(radius: int, angles: int) -> list[tuple[Offsets, Offsets]]:
    """(dilation's, erosion's) places for each angle: the thick line made a pixel thicker, and the thick line."""
    out = []
    for i in range(angles):
        line = line_kernel(radius, 180.0 * i / angles, thickness=2)
        out.append((offsets(dilate(line > 0, offsets(np.ones((2, 2)))).astype(np.uint8)), offsets(line)))
    return out


def close_lines(scores: np.ndarray, threshold: float, radius: int, angles: int, lower: float | None = None) -> np.ndarray:
    """The map above threshold, joined across gaps along lines of any angle.

    The result of each angle is taken from the map itself, and all are united with it; with lower, only pixels above
    threshold * lower stay.
    """
    pad = radius + 1
    above = np.pad(scores > threshold, pad)
    out = above.copy()
    for wide, line in closing_kernels(radius, angles):
        out |= erode(dilate(above, wide), line)
    out = out[pad:-pad, pad:-pad]
    return out if lower is None else out & (scores > threshold * lower)


def fill_holes(image: np.ndarray) -> np.ndarray:
    """image with every background region that does not touch the border (by its four sides) filled."""
    free = np.pad(~image, 1, constant_values=True)
    reached = np.zeros_like(free)
    reached[0] = reached[-1] = True
    reached[:, 0] = reached[:, -1] = True
    while True:
        before = int(reached.sum())
        for view, room in ((reached, free), (reached.T, free.T)):
            for v, r in ((view, room), (view[:, ::-1], room[:, ::-1])):
                # a pixel is reached if one is since the last wall before it
                place = np.arange(v.shape[1])
                wall = np.maximum.accumulate(np.where(r, -1, place), axis=1)
                seen = np.maximum.accumulate(np.where(v, place, -1), axis=1)
                v |= r & (seen > wall)
        if int(reached.sum()) == before:
            return ~reached[1:-1, 1:-1]


def clean(scores: np.ndarray, threshold: float, radius: int, angles: int, lower: float | None, erosion: int) -> np.ndarray:
    """The whole chain: closing, filling, erosion by an ellipse of side 2 * erosion + 1."""
    out = fill_holes(close_lines(scores, threshold, radius, angles, lower))
    return erode(out, offsets(ellipse_kernel(2 * erosion + 1))) if erosion else out


def half(scores: np.ndarray) -> np.ndarray:
    """Scores as half-precision numbers would hold them."""
    return scores.astype(np.float16).astype(np.float32)


# Tables: one row for each foreground pixel, keys and y, x.


def dilate_pixels(pixels: DataFrame, keys: list[str], by: Offsets, height: int, width: int) -> DataFrame:
    """(keys, y, x) of the dilated maps, within height x width. Each pixel becomes len(by) rows, then distinct ones."""
    at = F.array(*[F.struct(F.lit(-dy).alias("dy"), F.lit(-dx).alias("dx")) for dy, dx in by])
    out = pixels.select(*keys, "y", "x", F.explode(at).alias("_d")).select(*keys, (F.col("y") + F.col("_d.dy")).alias("y"), (F.col("x") + F.col("_d.dx")).alias("x"))
    return out.where((F.col("y") >= 0) & (F.col("y") < height) & (F.col("x") >= 0) & (F.col("x") < width)).distinct()


def erode_pixels(pixels: DataFrame, keys: list[str], by: Offsets, height: int, width: int) -> DataFrame:
    """(keys, y, x) of the eroded maps; places outside height x width count as foreground."""
    at = F.array(*[F.struct(F.lit(-dy).alias("dy"), F.lit(-dx).alias("dx")) for dy, dx in by])
    votes = pixels.select(*keys, "y", "x").distinct().select(*keys, "y", "x", F.explode(at).alias("_d")).select(*keys, (F.col("y") + F.col("_d.dy")).alias("y"), (F.col("x") + F.col("_d.dx")).alias("x"))
    inside = sum((((F.col("y") + dy).between(0, height - 1)) & ((F.col("x") + dx).between(0, width - 1))).cast("int") for dy, dx in by)
    counted = votes.groupBy(*keys, "y", "x").agg(F.count("*").alias("_n"))
    return counted.where((F.col("_n") == inside) & F.col("y").between(0, height - 1) & F.col("x").between(0, width - 1)).select(*keys, "y", "x")


def close_line_pixels(pixels: DataFrame, keys: list[str], by: Offsets, height: int, width: int) -> DataFrame:
    """Pixels united with their closing by one symmetric kernel; the map is padded so that its border plays no part."""
    pad = max(max(abs(dy), abs(dx)) for dy, dx in by) + 1
    wide = pixels.select(*keys, (F.col("y") + pad).alias("y"), (F.col("x") + pad).alias("x"))
    h, w = height + 2 * pad, width + 2 * pad
    closed = erode_pixels(dilate_pixels(wide, keys, by, h, w), keys, by, h, w)
    back = closed.select(*keys, (F.col("y") - pad).alias("y"), (F.col("x") - pad).alias("x")).where(F.col("y").between(0, height - 1) & F.col("x").between(0, width - 1))
    return pixels.select(*keys, "y", "x").unionByName(back).distinct()


def _maps(pixels: DataFrame, keys: list[str], height: int, width: int, value: str | None, work) -> DataFrame:
    """(keys, y, x) where work() on each whole map says so. A map, which height x width bounds, is one row with its
    places as an array, so a batch holds many maps."""
    place = (F.col("y") * width + F.col("x")).cast("int")
    rows = pixels.groupBy(*keys).agg(F.collect_list(F.struct(place.alias("p"), F.col(value).cast("double").alias("v")) if value else place).alias("_at"))
    rows = rows.select(*keys, "_at.p", "_at.v") if value else rows.select(*keys, F.col("_at").alias("p"))
    out = T.StructType([*(pixels.schema[c] for c in keys), T.StructField("_p", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(len(keys))
            ends, places = at.offsets.to_numpy(), at.values.to_numpy(zero_copy_only=False)
            values = batch.column(len(keys) + 1).values.to_numpy(zero_copy_only=False) if value else None
            found = []
            for a, b in zip(ends[:-1], ends[1:]):
                m = np.zeros(height * width) if value else np.zeros(height * width, bool)
                m[places[a:b]] = values[a:b] if value else True
                found.append(np.flatnonzero(work(m.reshape(height, width))).astype(np.int32))
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, found)]).astype(np.int32)), pa.array(np.concatenate(found) if found else np.zeros(0, np.int32)))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], lists], names=out.names)

    each = rows.mapInArrow(run, out).select(*keys, F.explode("_p").alias("_p"))
    return each.select(*keys, F.floor(F.col("_p") / width).cast("int").alias("y"), (F.col("_p") % width).alias("x"))


def fill_holes_pixels(pixels: DataFrame, keys: list[str], height: int, width: int) -> DataFrame:
    """(keys, y, x) of the maps with their holes filled. One map of height x width is one task's group."""
    return _maps(pixels, keys, height, width, None, fill_holes)


def clean_pixels(scores: DataFrame, keys: list[str], height: int, width: int, threshold: float, radius: int, angles: int, lower: float | None, erosion: int, value: str = "score") -> DataFrame:
    """(keys, y, x) of the foreground after clean(); scores has a row for each pixel, missing ones count as 0."""
    return _maps(scores, keys, height, width, value, lambda m: clean(m, threshold, radius, angles, lower, erosion))
