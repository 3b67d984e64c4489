"""The catalog of images: listing of a dataset folder, labels and masks by place, splits for training and hold-out."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from patchmill.functions.settings import BAD, CATEGORIES, GOOD, SAMPLE, SPLITS, UNKNOWN, known
from patchmill.runtime import is_folder, written


def list_files(spark: SparkSession, folder: str, suffix: str = ".png") -> DataFrame:
    """(path) of the files right in a folder, or below it by a pattern; a folder that is missing has none.

    The executors list and nothing is opened: only the path column of binaryFile is read.
    """
    jvm = spark.sparkContext._jvm
    pattern = jvm.org.apache.hadoop.fs.Path(folder)
    found = pattern.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(pattern)
    if not found:
        return spark.createDataFrame([], "path string")
    return spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").load(folder).select(F.regexp_replace("path", "^file:/+", "/").alias("path"))


def stem(path: Column | str) -> Column:
    """File name without folder and last suffix."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"\.[^.]*$", "")


def mask_name(image_stem: Column) -> Column:
    return F.concat(image_stem, F.lit("_mask.png"))


def catalog(paths: DataFrame) -> DataFrame:
    """category, split, image_path, label, mask_path, from paths of the layout .../category/split/...

    train and validation: <split>/good, label 0. test_public: good (0) and bad (1), a bad image with the mask
    ground_truth/bad/<stem>_mask.png if there is one. Private splits: right in <split>, label -1. Other paths are no images.
    """
    categories, splits = "|".join(CATEGORIES), "|".join(SPLITS)
    where = rf"^(.*?/)?({categories})/({splits})/(.*)$"
    part = lambda i: F.regexp_extract("path", where, i)
    parts = paths.select("path", part(1).alias("root"), part(2).alias("category"), part(3).alias("split"), part(4).alias("rest")).where("category <> '' and rest like '%.png'")
    good = F.col("split").isin("train", "validation", "test_public") & F.col("rest").rlike(r"^good/[^/]*$")
    bad = (F.col("split") == "test_public") & F.col("rest").rlike(r"^bad/[^/]*$")
    private = F.col("split").isin("test_private", "test_private_mixed") & F.col("rest").rlike(r"^[^/]*$")
    label = F.when(good, GOOD).when(bad, BAD).when(private, UNKNOWN)
    images = parts.withColumn("label", label).where("label is not null").withColumn("stem", stem("path"))
    masks = parts.where("split = 'test_public'").where(F.col("rest").rlike(r"^ground_truth/bad/[^/]*_mask\.png$"))
    masks = masks.select("root", "category", "split", F.regexp_replace(stem("path"), "_mask$", "").alias("stem"), F.lit(BAD).alias("label"), F.col("path").alias("mask_path"))
    out = images.join(masks, ["root", "category", "split", "stem", "label"], "left")
    return out.select("category", "split", F.col("path").alias("image_path"), "label", "mask_path").to(SAMPLE)


def read_catalog(spark: SparkSession, root: str, category: str, split: str) -> DataFrame:
    """The catalog of one category and split in a dataset folder, good before bad and by path.

    Unknown names raise ValueError, a missing category folder FileNotFoundError, and a split without images ValueError.
    """
    known(category, CATEGORIES, "category"), known(split, SPLITS, "split")
    base = os.path.join(root, category)
    if not is_folder(base):
        raise FileNotFoundError(base)
    below = {"train": ["good"], "validation": ["good"], "test_public": ["good", "bad", "ground_truth/bad"]}.get(split, [""])
    paths = None
    for b in below:
        part = list_files(spark, os.path.join(base, split, b))
        paths = part if paths is None else paths.unionByName(part)
    out = catalog(paths)
    if out.isEmpty():
        raise ValueError(f"no images of {category}/{split} in {root}")
    return out.orderBy("label", "image_path")


def with_position(samples: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """samples with `position`, counted from 0 in each group.

    The rows are sorted by ranges, written once, and numbered within each range; a range's first number in a group comes
    from the counts of the ranges before it. So no task sorts a whole group. keys and order must tell rows apart.
    """
    by = [*keys, *order]
    ranged = samples.repartitionByRange(*by).sortWithinPartitions(*by)
    at = written(ranged.withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    runs = at.groupBy(*keys, part.alias("_p")).agg(F.count("*").alias("_c"), F.min("_at").alias("_first"))
    before = Window.partitionBy(*keys).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("_base", F.coalesce(F.sum("_c").over(before), F.lit(0))).drop("_c")
    same = [F.col(k).eqNullSafe(F.col(f"_g{i}")) for i, k in enumerate(keys)]
    runs = runs.select(*[F.col(k).alias(f"_g{i}") for i, k in enumerate(keys)], F.col("_p").alias("_q"), "_first", "_base")
    found = at.withColumn("_p", part).join(runs, [*same, F.col("_p") == F.col("_q")])
    return found.select(*samples.columns, (F.col("_at") - F.col("_first") + F.col("_base")).cast("int").alias("position"))


def train_stride(samples: DataFrame, keys: list[str], order: list[str], fraction: int) -> DataFrame:
    """Every fraction-th sample of each group, from the first on, with its new `position`."""
    at = with_position(samples, keys, order).where(F.col("position") % fraction == 0)
    return at.withColumn("position", F.floor(F.col("position") / fraction).cast("int"))


def holdout(samples: DataFrame, fraction: int) -> DataFrame:
    """samples with `part`: 'threshold' where position is a multiple of fraction, else 'bank'."""
    if fraction < 2:
        raise ValueError("a threshold fraction under 2 leaves nothing for the bank")
    return samples.withColumn("part", F.when(F.col("position") % fraction == 0, "threshold").otherwise("bank"))


def to_score(samples: DataFrame, good_images: bool = False) -> DataFrame:
    """The samples to predict: good ones only if asked for."""
    return samples if good_images else samples.where(F.col("label") != GOOD)


def with_ground_truth(samples: DataFrame) -> DataFrame:
    """The samples that can be evaluated, private ones left out."""
    return samples.where(F.col("label") != UNKNOWN)
