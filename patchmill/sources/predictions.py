"""Prediction files: where a map may lie, reading and writing of maps, scores and archives."""

from __future__ import annotations

import os
import tarfile
import time
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patchmill.runtime import write_file
from patchmill.sources.codecs import read_png, read_tiff, write_png, write_tiff

MOST_SCORES = 10_000

# Fixed layouts of a public test map, in the order in which they are tried.
LAYOUTS = [
    "anomaly_images/{category}/test_public/bad/{stem}.tiff",
    "anomaly_images/{category}/test_public/{stem}.tiff",
    "{category}/test_public/bad/{stem}.tiff",
    "{category}/test_public/{stem}.tiff",
]


def resolve_predictions(wanted: DataFrame, paths: DataFrame) -> DataFrame:
    """(category, stem, path) for each wanted (category, stem): the first layout that is among the paths (relative to the
    predictions folder), or null."""
    tries = F.array(*[F.struct(F.lit(i).alias("priority"), F.format_string(t.replace("{category}", "%1$s").replace("{stem}", "%2$s"), "category", "stem").alias("path")) for i, t in enumerate(LAYOUTS)])
    each = wanted.select("category", "stem", F.inline(tries)).join(paths.select("path").distinct().withColumn("_there", F.lit(True)), "path", "left")
    return each.groupBy("category", "stem").agg(F.min_by("path", F.when(F.col("_there"), F.col("priority"))).alias("path"))


def read_maps(spark: SparkSession, folder: str) -> DataFrame:
    """(path, height, width, kind, dtype, ndim, values) of the TIFF and PNG files below a folder; a broken file has a
    null kind."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).where(F.col("path").rlike(r"\.(tiff|png)$"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.itertuples():
                kind = r.path.rsplit(".", 1)[1]
                try:
                    x = (read_tiff if kind == "tiff" else read_png)(r.content)
                    rows.append((r.path, x.shape[0], x.shape[1], kind, str(x.dtype), x.ndim, x.ravel().astype(np.float32)))
                except (ValueError, KeyError, IndexError):
                    rows.append((r.path, None, None, None, None, None, None))
            out = pd.DataFrame(rows, columns=["path", "height", "width", "kind", "dtype", "ndim", "values"])
            yield out.astype({"height": "Int32", "width": "Int32", "ndim": "Int32"})

    return files.select(F.regexp_replace("path", "^file:/+", "/").alias("path"), "content").mapInPandas(run, "path string, height int, width int, kind string, dtype string, ndim int, values array<float>")


def map_path(results: str, kind: str, category: str, split: str, name: str) -> str:
    """Where a map lies: kind 'score' is a TIFF, 'binary' a PNG."""
    folder, suffix = {"score": ("anomaly_images", "tiff"), "binary": ("anomaly_images_thresholded", "png")}[kind]
    return os.path.join(results, folder, category, split, f"{name}.{suffix}")


def export_maps(maps: DataFrame, results: str) -> int:
    """Writes each row (category, split, stem, height, width, scores, flags) as a half-precision TIFF and a 0/255 PNG from
    the executors; the folder must be shared by them. Gives the number of rows. A row written again gives equal files."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples():
                shape = (r.height, r.width)
                for kind, data in (("score", write_tiff(np.asarray(r.scores, float).reshape(shape).astype(np.float16))), ("binary", write_png(np.asarray(r.flags, bool).reshape(shape).astype(np.uint8) * 255))):
                    write_file(map_path(results, kind, r.category, r.split, r.stem), data)
            yield pd.DataFrame({"n": [len(pdf)]})

    return maps.mapInPandas(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def write_scores(table: DataFrame, path: str) -> None:
    """The score table (a row for each category and the mean) as a CSV with a leading unnamed index; more than MOST_SCORES
    rows are an error."""
    pdf = table.limit(MOST_SCORES + 1).toPandas()
    if len(pdf) > MOST_SCORES:
        raise ValueError(f"more than {MOST_SCORES} rows of scores")
    mean = pdf["Category"] == "mean"
    pdf = pd.concat([pdf[~mean].sort_values("Category"), pdf[mean]], ignore_index=True)
    if len(pdf):
        write_file(path, pdf.to_csv().encode())


def summary(scores: dict[str, float], mean: float, what: str = "SegF1") -> str:
    """Scores by category as a table of characters."""
    names = sorted(scores)
    wide = max([len("Category"), *map(len, names)])
    rule = f"+{'-' * (wide + 2)}+{'-' * (len(what) + 2)}+"
    line = lambda a, b: f"| {a:<{wide}} | {b:>{len(what)}} |"
    return "\n".join([rule, line("Category", what), rule, *(line(n, f"{scores[n]:.4f}") for n in names), rule, line("MEAN", f"{mean:.4f}"), rule])


def archive_name(folder: str, at: float | None = None) -> str:
    """A name with the local time in it."""
    return os.path.join(folder, time.strftime("submission_%Y-%m-%d_%H-%M-%S.tar.gz", time.localtime(at)))


def pack(results: str, archive: str | None = None) -> str:
    """A tar.gz of the folder under its own name; a last suffix that is not .tar.gz is replaced by it."""
    results = os.path.normpath(results)
    archive = archive or results + ".tar.gz"
    if not archive.endswith(".tar.gz"):
        archive = os.path.splitext(archive)[0] + ".tar.gz"
    os.makedirs(os.path.dirname(os.path.abspath(archive)), exist_ok=True)
    with tarfile.open(archive, "w:gz") as tar:
        tar.add(results, arcname=os.path.basename(results))
    return archive
