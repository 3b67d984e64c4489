"""Images as rows: decoding by the built-in image source, pixels as planar arrays, and the pluggable embedder."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from patchmill.functions.resize import binary_mask, resize, shrunk
from patchmill.runtime import bounded_batches

IMAGE = "image_path string, height int, width int, pixels array<float>"


def read_images(spark: SparkSession, folder: str | list[str], size: tuple[int, int] | None = None) -> DataFrame:
    """(image_path, height, width, pixels): RGB in [0, 1], channel by channel.

    The built-in source decodes with the channels blue first; grey images give three equal channels. Files that are no
    images are dropped. With size each image is resized.
    """
    bounded_batches(spark)
    raw = spark.read.format("image").option("dropInvalid", True).load(folder).select("image.*")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.itertuples():
                x = np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, r.nChannels)
                x = x[..., [0, 0, 0]] if r.nChannels == 1 else x[..., 2::-1]
                x = x.transpose(2, 0, 1) / 255.0
                if size:
                    x = resize(x, *size)
                rows.append((r.origin.removeprefix("file://"), x.shape[1], x.shape[2], x.ravel().astype(np.float32)))
            yield pd.DataFrame(rows, columns=["image_path", "height", "width", "pixels"])

    return raw.mapInPandas(run, IMAGE)


def bytes_to_pixels(samples: DataFrame, image: str = "image", height: str = "height", width: str = "width") -> DataFrame:
    """samples with `pixels`: RGB bytes row by row as planar floats in [0, 1]; null where the length does not fit."""
    bounded_batches(samples.sparkSession)
    out = T.StructType([*samples.schema.fields, T.StructField("pixels", T.ArrayType(T.FloatType()))])
    at = [samples.columns.index(c) for c in (image, height, width)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for d, h, w in zip(*(batch.column(i).to_pylist() for i in at)):
                good = d is not None and h is not None and w is not None and h > 0 and w > 0 and len(d) == 3 * h * w
                found.append((np.frombuffer(d, np.uint8).reshape(h * w, 3).T.ravel() / 255.0).astype(np.float32) if good else None)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(pa.float32()))], names=out.names)

    return samples.mapInArrow(run, out)


def preprocess(images: DataFrame, factor: float) -> DataFrame:
    """Images shrunk by factor to whole pixels, bicubic with antialiasing."""
    bounded_batches(images.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                h, w = shrunk(r.height, r.width, factor)
                x = np.asarray(r.pixels, float).reshape(3, r.height, r.width)
                out.append((r.image_path, h, w, resize(x, h, w, "bicubic").ravel().astype(np.float32)))
            yield pd.DataFrame(out, columns=["image_path", "height", "width", "pixels"])

    return images.select("image_path", "height", "width", "pixels").mapInPandas(run, IMAGE)


def decode_mask(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """A grey or RGB mask image as 0/1 of the image's size."""
    grey = image if image.ndim == 2 else image @ np.array([0.299, 0.587, 0.114])
    return binary_mask(grey, height, width)


#: Turns tiles (n, 3, side, side) into token features of each layer, (layers, n, tokens, features).
Embedder = Callable[[np.ndarray], np.ndarray]


def patch_means(side: int, layers: list[int]) -> Embedder:
    """A stand-in embedder without weights: mean and deviation of each channel in each side x side patch."""

    def run(tiles: np.ndarray) -> np.ndarray:
        n, c, h, w = tiles.shape
        p = tiles.reshape(n, c, h // side, side, w // side, side)
        f = np.concatenate([p.mean((3, 5)), p.std((3, 5))], axis=1)
        f = f.reshape(n, 2 * c, -1).transpose(0, 2, 1)
        return np.stack([f * (1 + i) for i in range(len(layers))])

    return run


def embed(images: DataFrame, embedder: Embedder, layers: list[int], tile: int, overlap: int, token: int) -> DataFrame:
    """(image_path, layer, ty, tx, embedding) of each token: images are cut into overlapping tiles, embedded, and the
    tokens taken from the tile that owns them. Images smaller than a tile in either direction give no row."""
    from patchmill.operators.tiling import plan_tiles

    bounded_batches(images.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples():
                x = np.asarray(r.pixels, np.float32).reshape(3, r.height, r.width)
                plan = plan_tiles([r.height, r.width], tile, overlap, token)
                ys, xs = plan[r.height], plan[r.width]
                if not ys or not xs:
                    continue
                tiles = np.stack([x[:, a["start"] * token : a["stop"] * token, b["start"] * token : b["stop"] * token] for a in ys for b in xs])
                side = tile // token
                got = embedder(tiles)
                got = got.reshape(got.shape[0], len(ys), len(xs), side, side, -1)
                for i, layer in enumerate(layers):
                    for j, a in enumerate(ys):
                        for k, b in enumerate(xs):
                            own = got[i, j, k, a["keep_from"] : a["keep_to"], b["keep_from"] : b["keep_to"]]
                            ty, tx = np.mgrid[a["out_from"] : a["out_to"], b["out_from"] : b["out_to"]]
                            yield pd.DataFrame({"image_path": r.image_path, "layer": np.int32(layer), "ty": ty.ravel().astype(np.int32), "tx": tx.ravel().astype(np.int32), "embedding": list(own.reshape(-1, own.shape[-1]).astype(np.float32))})

    return images.select("image_path", "height", "width", "pixels").mapInPandas(run, "image_path string, layer int, ty int, tx int, embedding array<float>")


def batches(images: DataFrame, size: int = 32, shuffle: bool = False, seed: int = 42) -> DataFrame:
    """images with `batch`, a number for each `size` rows of a partition, in a hash order of the paths if shuffled."""
    rows = images.repartition(F.xxhash64("image_path", F.lit(seed))).sortWithinPartitions(F.xxhash64("image_path", F.lit(seed + 1))) if shuffle else images
    place = F.monotonically_increasing_id()
    return rows.withColumn("batch", F.shiftright(place, 33) * (1 << 33) + F.floor((place % (1 << 33)) / size))
