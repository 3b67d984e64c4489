"""The scoring model: a thinned bank for each category and layer, a threshold, maps and their evaluation."""

from __future__ import annotations

import json
import os
from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from patchmill.functions.resize import resize, truth_mask
from patchmill.functions.settings import BANK
from patchmill.operators import metrics, morphology
from patchmill.operators.knn import anomaly_scores, knn_join
from patchmill.operators.thinning import thin
from patchmill.runtime import read_file, write_file, written

MAPS = "category string, image_id long, height int, width int, scores array<float>"


@dataclass
class Params:
    """Numbers that a model is made with."""

    dim: int
    neighbours: int = 1
    normalize: bool = False
    bank_size: int = 100_000
    subsets: int = 100
    thinning_neighbours: int = 100
    percentile: float = 95
    factor: float = 1.421
    downscale: int = 4
    closing_radius: int = 26
    closing_angles: int = 16
    closing_lower: float | None = 0.8
    erosion: int = 1
    seed: int = 42


def token_scores(tokens: DataFrame, bank: DataFrame, params: Params) -> DataFrame:
    """(category, layer, image_id, ty, tx, score) of tokens (category, layer, image_id, ty, tx, embedding)."""
    keys = ["category", "layer"]
    # a token's number in place of its four parts, so the join carries one id
    rows = tokens.withColumn("token", F.struct("image_id", "ty", "tx"))
    near = knn_join(rows, bank, query_id="token", bank_id="proto_id", vector="embedding", k=params.neighbours, keys=keys, normalize=params.normalize)
    return anomaly_scores(near, keys, "token", params.dim).select(*keys, "token.image_id", "token.ty", "token.tx", "score")


def score_maps(scores: DataFrame, images: DataFrame, downscale: int) -> DataFrame:
    """A map for each image: its token grids brought to (height / downscale) x (width / downscale), bilinear, and averaged
    over layers. images has image_id, height and width. One image is one task's group."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        h, w = int(pdf["height"].iat[0]) // downscale, int(pdf["width"].iat[0]) // downscale
        layers = []
        for _, g in pdf.groupby("layer"):
            grid = np.zeros((int(g["ty"].max()) + 1, int(g["tx"].max()) + 1))
            grid[g["ty"].to_numpy(), g["tx"].to_numpy()] = g["score"].to_numpy()
            layers.append(resize(grid, h, w))
        return pd.DataFrame([(pdf["category"].iat[0], pdf["image_id"].iat[0], h, w, np.mean(layers, axis=0).ravel().astype(np.float32))], columns=["category", "image_id", "height", "width", "scores"])

    return scores.join(images.select("image_id", "height", "width"), "image_id").groupBy("category", "image_id").applyInPandas(run, MAPS)


def pixels(maps: DataFrame, value: str = "scores", name: str = "score") -> DataFrame:
    """(category, image_id, y, x, name): a row for each pixel."""
    each = maps.select("category", "image_id", "width", F.posexplode(value).alias("_p", name))
    return each.select("category", "image_id", F.floor(F.col("_p") / F.col("width")).cast("int").alias("y"), (F.col("_p") % F.col("width")).alias("x"), name)


class AnomalyModel:
    """What fit() gives; saved and loaded as Parquet by category and layer beside a JSON file."""

    def __init__(self, bank: DataFrame, thresholds: dict[str, float], params: Params):
        self.bank, self.thresholds, self.params = bank, thresholds, params

    @classmethod
    def fit(cls, tokens: DataFrame, images: DataFrame, params: Params) -> AnomalyModel:
        """tokens: category, layer, image_id, ty, tx, embedding of good images. images: image_id, height, width, part, which
        is 'bank' or 'threshold'. An empty bank is an error."""
        parts = tokens.join(images.select("image_id", "part"), "image_id")
        rows = parts.where("part = 'bank'").select("category", "layer", F.xxhash64("category", "layer", "image_id", "ty", "tx").alias("proto_id"), "embedding")
        bank = thin(rows, ["category", "layer"], bank_id="proto_id", vector="embedding", target=params.bank_size, subsets=params.subsets, neighbours=params.thinning_neighbours, seed=params.seed).to(BANK)
        bank = written(bank)  # what follows reads it several times
        if bank.isEmpty():
            raise ValueError("the bank is empty")
        model = cls(bank, {}, params)
        held = score_maps(token_scores(parts.where("part = 'threshold'"), bank, params), images, params.downscale)
        found = metrics.anomaly_threshold(pixels(held), ["category"], "score", params.percentile, params.factor)
        model.thresholds = {r.category: r.threshold for r in found.collect()}  # a row for each category
        return model

    def transform(self, tokens: DataFrame, images: DataFrame) -> DataFrame:
        """(category, image_id, height, width, scores, flags): map and cleaned binary map of each image. A category without
        threshold has no flags."""
        p, thresholds = self.params, dict(self.thresholds)
        schema = T.StructType([*T._parse_datatype_string(MAPS).fields, T.StructField("flags", T.ArrayType(T.BooleanType()))])

        def run(batches):
            for pdf in batches:
                flags = []
                for r in pdf.itertuples():
                    t = thresholds.get(r.category)
                    m = np.asarray(r.scores, float).reshape(r.height, r.width)
                    flags.append(None if t is None else morphology.clean(m, t, p.closing_radius, p.closing_angles, p.closing_lower, p.erosion).ravel())
                yield pdf.assign(flags=flags)

        return score_maps(token_scores(tokens, self.bank, p), images, p.downscale).mapInPandas(run, schema)

    def save(self, path: str) -> None:
        self.bank.write.mode("overwrite").partitionBy("category", "layer").parquet(os.path.join(path, "bank"))
        write_file(os.path.join(path, "model.json"), json.dumps({"constructor": asdict(self.params), "trained": {"thresholds": self.thresholds}}, indent=2).encode())

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> AnomalyModel:
        meta = json.loads(read_file(os.path.join(path, "model.json")))
        return cls(spark.read.schema(BANK).parquet(os.path.join(path, "bank")), meta["trained"]["thresholds"], Params(**meta["constructor"]))


def evaluate(maps: DataFrame, masks: DataFrame, max_fpr: float = 0.05) -> DataFrame:
    """(Category, AU, F1) over all pixels of each category and their means.

    masks: image_id, label, height, width, mask (0/1 by row, or null for none). Maps are rounded to half precision first,
    masks resized to the map. Images of label -1 are left out.
    """
    rows = maps.join(masks.where("label <> -1").select("image_id", "mask", F.col("height").alias("_h"), F.col("width").alias("_w")), "image_id")
    schema = "category string, image_id long, score array<float>, flag array<boolean>, truth array<boolean>"

    def run(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                n = r.height * r.width
                truth = np.zeros(n, bool) if r.mask is None else truth_mask(np.asarray(r.mask).reshape(r.h_, r.w_), r.height, r.width).ravel() > 0
                flags = np.zeros(n, bool) if r.flags is None else np.asarray(r.flags, bool)
                out.append((r.category, r.image_id, morphology.half(np.asarray(r.scores)), flags, truth))
            yield pd.DataFrame(out, columns=["category", "image_id", "score", "flag", "truth"])

    told = rows.withColumnsRenamed({"_h": "h_", "_w": "w_"}).mapInPandas(run, schema).select("category", "image_id", F.inline(F.arrays_zip("score", "flag", "truth")))
    return metrics.score_table(metrics.partial_auc(told, ["category"], "score", "truth", max_fpr), metrics.f1(told, ["category"], "flag", "truth"))


def map_problems(maps: DataFrame, masks: DataFrame) -> DataFrame:
    """(category, image_id, problem): masks whose map is 'missing' or has another 'size'."""
    both = masks.select("category", "image_id", F.col("height").alias("_h"), F.col("width").alias("_w")).join(maps.select("image_id", "height", "width", F.col("scores").isNotNull().alias("_there")), "image_id", "left")
    problem = F.when(~F.coalesce("_there", F.lit(False)), "missing").when((F.col("height") != F.col("_h")) | (F.col("width") != F.col("_w")), "size")
    return both.select("category", "image_id", problem.alias("problem")).where("problem is not null")


def evaluate_local(maps: DataFrame, masks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((category, image_id, best_f1), (category, best_f1) with a 'mean' row) of maps and the bad images' masks.

    Each mask needs a map of its own size; a missing one or another size raises ValueError.
    """
    bad = map_problems(maps, masks).first()
    if bad is not None:
        raise ValueError(f"no map of {bad.category}/{bad.image_id} in the size of its mask")
    both = masks.select("image_id", "mask").join(maps, "image_id")
    each = both.select("category", "image_id", F.inline(F.arrays_zip(F.col("scores").alias("score"), F.col("mask").alias("truth"))))
    per_image = metrics.best_f1(each.toDF("category", "image_id", "score", "truth"), ["category", "image_id"], "score", F.col("truth") > 0, bounded=True)
    return per_image, metrics.mean_of_means(per_image, "category", "best_f1")
