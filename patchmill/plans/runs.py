"""The three runs over a dataset folder: train, test and submit. `python -m patchmill train settings.json`."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patchmill.functions import arrays
from patchmill.functions.settings import SAMPLE, Settings
from patchmill.operators import validation
from patchmill.plans.model import AnomalyModel, Params, evaluate
from patchmill.runtime import written
from patchmill.sources import catalog, images, predictions
from patchmill.sources.codecs import read_png

TOKEN = 16


def params_of(settings: Settings, dim: int) -> Params:
    s = settings
    return Params(dim=dim, bank_size=s.max_database_size, subsets=s.subsampling_iterations, percentile=s.threshold_percentile, factor=s.threshold_factor, downscale=s.evaluation_downscale, closing_radius=s.closing_radius, closing_angles=s.closing_angles, closing_lower=s.closing_lower_threshold, erosion=s.binary_erosion)


def read_samples(spark: SparkSession, settings: Settings, split: str) -> DataFrame:
    """The catalog of a split over all categories of the settings, with image_id."""
    root = settings.folder("datasets_dir", create=False)
    out = spark.createDataFrame([], SAMPLE)
    for c in settings.categories:  # eight at most
        out = out.unionByName(catalog.read_catalog(spark, root, c, split))
    return out.withColumn("image_id", F.xxhash64("image_path"))


def read_tokens(spark: SparkSession, samples: DataFrame, settings: Settings, embedder: images.Embedder, token: int = TOKEN, bright: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(tokens, sizes) of the samples' images: category, layer, image_id, ty, tx, embedding; and image_id, height, width.

    Images are shrunk so that a tile covers 1024 pixels of the original and normalised by channel. bright is a condition:
    images that meet it get a random brightness first."""
    folders = [r.f for r in samples.select(F.regexp_replace("image_path", "/[^/]*$", "").alias("f")).distinct().collect()]  # a few for each category
    raw = images.read_images(spark, folders).join(samples, "image_path")
    low, high = settings.brightness_augmentation
    factor = F.lit(1.0) if bright is None else F.when(F.expr(bright), arrays.brightness_factor("image_id", low, high)).otherwise(1.0)
    lit = raw.withColumn("pixels", arrays.brightness("pixels", factor))
    small = images.preprocess(lit, settings.patch_size / 1024)
    ready = small.withColumn("pixels", arrays.channel_normalize("pixels", F.col("height") * F.col("width")))
    found = images.embed(ready, embedder, settings.layers, settings.patch_size, settings.patch_overlap, token)
    tokens = found.join(samples.select("image_path", "category", "image_id"), "image_path").drop("image_path")
    return tokens, raw.select("image_id", "height", "width")


def read_masks(samples: DataFrame, sizes: DataFrame) -> DataFrame:
    """image_id, label, height, width, mask of labelled samples; without a mask file all pixels are good."""
    spark = samples.sparkSession
    named = samples.where("label <> -1").join(sizes, "image_id")
    folders = [r.f for r in named.where("mask_path is not null").select(F.regexp_replace("mask_path", "/[^/]*$", "").alias("f")).distinct().collect()]
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.png").load(folders).select(F.regexp_replace("path", "^file:/+", "/").alias("mask_path"), "content") if folders else spark.createDataFrame([], "mask_path string, content binary")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            masks = [None if c is None else images.decode_mask(read_png(c), h, w).ravel() for c, h, w in zip(pdf["content"], pdf["height"], pdf["width"])]
            yield pdf.drop(columns="content").assign(mask=masks)

    return named.join(files, "mask_path", "left").select("image_id", "label", "height", "width", "content").mapInPandas(run, "image_id long, label int, height int, width int, mask array<int>")


def train(spark: SparkSession, settings: Settings, embedder: images.Embedder, dim: int, token: int = TOKEN) -> AnomalyModel:
    """Fits the model on the train split and saves it in the models folder."""
    samples = catalog.train_stride(read_samples(spark, settings, "train"), ["category"], ["image_path"], settings.train_fraction)
    samples = written(catalog.holdout(samples, settings.threshold_fraction))
    tokens, sizes = read_tokens(spark, samples, settings, embedder, token, "part = 'bank'")
    model = AnomalyModel.fit(written(tokens), sizes.join(samples.select("image_id", "part"), "image_id"), params_of(settings, dim))
    model.save(os.path.join(settings.folder("models_dir"), "model"))
    return model


def test(spark: SparkSession, settings: Settings, embedder: images.Embedder, token: int = TOKEN) -> dict[str, DataFrame]:
    """Maps of the test splits; files if asked for, and for splits with labels the score table, also as CSV."""
    model = AnomalyModel.load(spark, os.path.join(settings.folder("models_dir"), "model"))
    tables = {}
    for split in settings.test_split:
        samples = written(catalog.to_score(read_samples(spark, settings, split), settings.evaluate_good_images))
        tokens, sizes = read_tokens(spark, samples, settings, embedder, token)
        maps = written(model.transform(tokens, sizes))
        if settings.save_predictions:
            named = maps.join(samples.select("image_id", "split", catalog.stem("image_path").alias("stem")), "image_id")
            predictions.export_maps(named, settings.folder("results_dir"))
        labelled = catalog.with_ground_truth(samples)
        if not labelled.isEmpty():
            tables[split] = written(evaluate(maps, read_masks(labelled, sizes)))
            predictions.write_scores(tables[split], settings.scores_csv(split))
    return tables


def submit(spark: SparkSession, settings: Settings, counts: dict[str, int] | None = None) -> str:
    """Checks the results folder, once, and packs it under a name with the time."""
    results = settings.folder("results_dir", create=False)
    validation.check_folder(spark, results, counts)
    return predictions.pack(results, predictions.archive_name(settings.folder("submissions_dir")))
