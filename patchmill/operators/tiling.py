"""Overlapping tiles of a long axis, and the token grid put together again from the tiles' results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def check_plan(tile: int, overlap: int, token: int) -> None:
    """Raises if tiles of these sizes (in pixels) can't be laid."""
    if not 0 < 2 * overlap < tile or tile % token or overlap % token:
        raise ValueError("a tile must be larger than twice its overlap, and both whole numbers of tokens")


def _half_up(x: Column) -> Column:
    return F.floor((x + 1) / 2)


def axis_tiles(dims: DataFrame, size: str, tile: int, overlap: int, token: int = 1) -> DataFrame:
    """dims with a row for each tile of the axis of `size` pixels, all in tokens.

    Added: tile, n_tiles, start and stop of the tile's input, keep_from and keep_to within the tile, out_from and out_to
    on the whole axis. Tiles begin at evenly spread places; where two overlap, the first gives up the smaller half. Each
    token of the axis lies in one tile's kept part. An axis shorter than a tile gives no row.
    """
    check_plan(tile, overlap, token)
    p, o = tile // token, overlap // token
    rows = dims.where(F.col(size) >= tile).withColumn("_d", F.floor(F.col(size) / token).cast("long"))
    n = F.ceil((F.col("_d") - p) / F.lit(p - 2 * o)).cast("long") + 1
    rows = rows.withColumn("n_tiles", n).withColumn("tile", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_tiles") - 1)))
    start = lambda i: F.floor(i * (F.col("_d") - p) / F.greatest(F.lit(1), F.col("n_tiles") - 1)).cast("long")
    i = F.col("tile")
    before, after = start(i - 1) + p - start(i), start(i) + p - start(i + 1)
    keep_from = F.when(i == 0, 0).otherwise(_half_up(before)).cast("long")
    keep_to = F.when(i == F.col("n_tiles") - 1, p).otherwise(p - F.floor(after / 2)).cast("long")
    out = rows.select(*dims.columns, "tile", "n_tiles", start(i).alias("start"), (start(i) + p).alias("stop"), keep_from.alias("keep_from"), keep_to.alias("keep_to"))
    return out.withColumn("out_from", F.col("start") + F.col("keep_from")).withColumn("out_to", F.col("start") + F.col("keep_to"))


def plan_tiles(sizes: list[int], tile: int, overlap: int, token: int = 1) -> dict[int, list[dict[str, int]]]:
    """axis_tiles() of a few sizes in plain Python."""
    check_plan(tile, overlap, token)
    p, o, plans = tile // token, overlap // token, {}
    for size in sizes:
        d = size // token
        n = -((p - d) // (p - 2 * o)) + 1 if size >= tile else 0
        starts = [i * (d - p) // max(1, n - 1) for i in range(n)]
        plans[size] = rows = []
        for i, s in enumerate(starts):
            low = 0 if not i else (starts[i - 1] + p - s + 1) // 2
            high = p if i == n - 1 else p - (s + p - starts[i + 1]) // 2
            rows.append({"tile": i, "start": s, "stop": s + p, "keep_from": low, "keep_to": high, "out_from": s + low, "out_to": s + high})
    return plans


def cut_tiles(tokens: DataFrame, plan_y: DataFrame, plan_x: DataFrame, size_y: str = "height", size_x: str = "width") -> DataFrame:
    """Each token (y, x) of the grid once for each tile that holds it: tile_y, tile_x, and ty, tx within the tile.

    plan_y and plan_x are axis_tiles() of the distinct sizes: a few rows, joined by size and then cut by place.
    """
    y = F.broadcast(plan_y.select(size_y, F.col("tile").alias("tile_y"), F.col("start").alias("_y0"), F.col("stop").alias("_y1")))
    x = F.broadcast(plan_x.select(size_x, F.col("tile").alias("tile_x"), F.col("start").alias("_x0"), F.col("stop").alias("_x1")))
    rows = tokens.join(y, size_y).where("y >= _y0 and y < _y1").join(x, size_x).where("x >= _x0 and x < _x1")
    return rows.withColumn("ty", F.col("y") - F.col("_y0")).withColumn("tx", F.col("x") - F.col("_x0")).drop("_y0", "_y1", "_x0", "_x1", "y", "x")


def stitch_tiles(results: DataFrame, plan_y: DataFrame, plan_x: DataFrame, size_y: str = "height", size_x: str = "width") -> DataFrame:
    """Results by tile and place in it (tile_y, tile_x, ty, tx) as a grid (y, x): each token from the tile that owns it."""
    y = F.broadcast(plan_y.select(size_y, F.col("tile").alias("tile_y"), F.col("start").alias("_y0"), F.col("keep_from").alias("_yf"), F.col("keep_to").alias("_yt")))
    x = F.broadcast(plan_x.select(size_x, F.col("tile").alias("tile_x"), F.col("start").alias("_x0"), F.col("keep_from").alias("_xf"), F.col("keep_to").alias("_xt")))
    rows = results.join(y, [size_y, "tile_y"]).where("ty >= _yf and ty < _yt").join(x, [size_x, "tile_x"]).where("tx >= _xf and tx < _xt")
    rows = rows.withColumn("y", F.col("ty") + F.col("_y0")).withColumn("x", F.col("tx") + F.col("_x0"))
    return rows.drop("tile_y", "tile_x", "ty", "tx", "_y0", "_yf", "_yt", "_x0", "_xf", "_xt")
