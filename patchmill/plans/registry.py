"""The queries of the scoring pipeline's own operators. Their SQL is in oracles.py."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patchmill.functions import arrays, resize
from patchmill.functions.resize import resize_pixels
from patchmill.operators import metrics, morphology, thinning, tiling, validation
from patchmill.operators.knn import anomaly_scores, knn_join
from patchmill.plans.model import AnomalyModel, Params, evaluate, pixels, score_maps, token_scores
from patchmill.plans.model import map_problems as find_map_problems
from patchmill.plans.oracles import SQL
from patchmill.runtime import shared_dir, table, write_file
from patchmill.sources import catalog as catalogs
from patchmill.sources import images, predictions
from patchmill.sources.codecs import write_png
from patchmill.sources.predictions import resolve_predictions
from patchmill.streaming.scoring import score_stream

DIM = 64
LINE = [(0, -1), (0, 0), (0, 1)]
CROSS = [(-1, 0), (0, -1), (0, 0), (0, 1), (1, 0)]


def _clean(name: str):
    return F.lower(F.trim(name)).alias(name)


def _bank(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(bank, queries): normal vectors but for every eighth, and all others."""
    rows = table(spark, sf_dir, "embeddings")
    kept = (F.col("label") <= 6) & (F.col("vec_id") % 8 != 0)
    return rows.where(kept), rows.where(~kept)


def _top(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    bank, queries = _bank(spark, sf_dir)
    return knn_join(queries, bank, query_id="vec_id", bank_id="vec_id", vector="embedding", k=k)


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return anomaly_scores(_top(spark, sf_dir, 1), [], "vec_id", DIM).join(table(spark, sf_dir, "embeddings").select("vec_id", "label"), "vec_id")


def knn_top1_score(spark, sf_dir):
    return _top(spark, sf_dir, 1).select("vec_id", "neighbour", F.round(F.col("distance") / DIM, 9).alias("score"))


def knn_topk_mean(spark, sf_dir):
    return anomaly_scores(_top(spark, sf_dir, 5), [], "vec_id", DIM).select("vec_id", F.round("score", 9).alias("score"))


def knn_normalized(spark, sf_dir):
    bank, queries = _bank(spark, sf_dir)
    near = knn_join(queries, bank, query_id="vec_id", bank_id="vec_id", vector="embedding", k=3, normalize=True)
    return near.select("vec_id", "neighbour", "rank", F.round("distance", 7).alias("distance"))


def knn_self_join(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    near = knn_join(rows, rows, query_id="vec_id", bank_id="vec_id", vector="embedding", k=3, keys=["label"], exclude_self=True)
    return near.select("label", "vec_id", "rank", F.round("distance", 9).alias("distance"))


def anomaly_threshold(spark, sf_dir):
    held = _scored(spark, sf_dir).where("label <= 6")
    return metrics.anomaly_threshold(held, [], "score").select("n", F.round("threshold", 9).alias("threshold"))


def flagship(spark, sf_dir):
    """Score of every query, and whether it passes the threshold of the held-out normal ones."""
    scored = _scored(spark, sf_dir)
    limit = metrics.anomaly_threshold(scored.where("label <= 6").withColumn("all", F.lit(1)), ["all"], "score")
    out = scored.withColumn("all", F.lit(1)).join(F.broadcast(limit), "all")  # one row
    return out.select("vec_id", "label", F.round("score", 9).alias("score"), (F.col("score") > F.col("threshold")).alias("flag"))


def pixel_threshold(spark, sf_dir):
    rows = table(spark, sf_dir, "pixel_scores").select(_clean("category"), "score").where("score <> -1 and not isnan(score) and abs(score) < double('infinity')")
    return metrics.anomaly_threshold(rows, ["category"], "score").select("category", "n", F.round("threshold", 9).alias("threshold"))


def _samples(spark, sf_dir) -> DataFrame:
    """Each sample once, names evened out."""
    rows = table(spark, sf_dir, "industrial_samples").select("sample_id", _clean("category"), _clean("split"), "image_path", "label", "mask_path")
    return rows.groupBy("sample_id").agg(*[F.min(c).alias(c) for c in rows.columns[1:]])


def train_stride(spark, sf_dir):
    rows = _samples(spark, sf_dir).where("split = 'train'")
    return catalogs.train_stride(rows, ["category"], ["sample_id"], 3).select("category", "sample_id", "position")


def holdout_split(spark, sf_dir):
    rows = _samples(spark, sf_dir).where("split = 'train'")
    return catalogs.holdout(catalogs.train_stride(rows, ["category"], ["sample_id"], 2), 8).select("category", "sample_id", "part")


def scored_labels(spark, sf_dir):
    rows = catalogs.to_score(_samples(spark, sf_dir))
    return rows.groupBy("category", "split", "label").agg(F.count("*").alias("n"), F.count("mask_path").alias("masks"))


def catalog_build(spark, sf_dir):
    rows = table(spark, sf_dir, "industrial_samples")
    paths = rows.select(F.col("image_path").alias("path")).unionByName(rows.select(F.col("mask_path").alias("path"))).where("path is not null").distinct()
    return catalogs.catalog(paths)


def prediction_paths(spark, sf_dir):
    rows = _samples(spark, sf_dir).where("split = 'test_public' and label = 1").select("category", F.col("sample_id").cast("string").alias("stem"), (F.col("sample_id") % 6).alias("m"))
    layout = lambda form: F.format_string(form, "category", "stem")
    some = rows.select(F.explode(F.array(F.when(F.col("m").isin(0, 1), layout("%s/test_public/%s.tiff")), F.when(F.col("m").isin(1, 2), layout("anomaly_images/%s/test_public/%s.tiff")), F.when(F.col("m").isin(2, 3), layout("anomaly_images/%s/test_public/bad/%s.tiff")), F.when(F.col("m") == 4, layout("%s/test_public/bad/%s.tiff")))).alias("path")).where("path is not null")
    return resolve_predictions(rows.select("category", "stem"), some)


def layer_scores(spark, sf_dir):
    """Bank and queries within each category and layer: every eighth sample of a category is held out."""
    rows = table(spark, sf_dir, "prototype_embeddings").select("proto_id", _clean("category"), "layer", "sample_id", "ty", "tx", "embedding")
    finite = "size(embedding) = 32 and forall(embedding, v -> v is not null and not isnan(v) and abs(v) < float('infinity')) and exists(embedding, v -> v <> 0)"
    rows = rows.where(finite).dropDuplicates(["proto_id"])
    places = catalogs.with_position(rows.select("category", "sample_id").distinct(), ["category"], ["sample_id"])
    rows = rows.join(places, ["category", "sample_id"]).withColumn("held", F.col("position") % 8 == 0)
    tokens = rows.where("held").select("category", "layer", F.col("proto_id").alias("image_id"), "ty", "tx", "embedding")
    scores = token_scores(tokens, rows.where("not held").select("category", "layer", "proto_id", "embedding"), Params(dim=32))
    return scores.select("category", "layer", F.col("image_id").alias("proto_id"), F.round("score", 6).alias("score"))


def _events(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.concat(F.lit("c"), F.col("user_id") % 8).alias("category"), F.col("user_id").alias("image"), F.col("value").alias("score"), (F.col("event_type") == "error").alias("truth"))


def partial_auc(spark, sf_dir):
    out = metrics.partial_auc(_events(spark, sf_dir), ["category"], "score", "truth")
    return out.withColumn("auc", F.round("auc", 9))


def full_auc(spark, sf_dir):
    return metrics.partial_auc(_events(spark, sf_dir), [], "score", "truth", 1.0).withColumn("auc", F.round("auc", 9))


def best_f1(spark, sf_dir):
    return metrics.best_f1(_events(spark, sf_dir), ["category", "image"], "score", "truth", bounded=True).withColumn("best_f1", F.round("best_f1", 9))


def f1_fixed_threshold(spark, sf_dir):
    return metrics.f1(_events(spark, sf_dir), ["category"], "score > 20", "truth").withColumn("f1", F.round("f1", 9))


def mean_of_category_means(spark, sf_dir):
    each = metrics.best_f1(_events(spark, sf_dir), ["category", "image"], "score", "truth", bounded=True)
    return metrics.mean_of_means(each, "category", "best_f1").withColumn("best_f1", F.round("best_f1", 9))


def score_table(spark, sf_dir):
    rows = _events(spark, sf_dir)
    out = metrics.score_table(metrics.partial_auc(rows, ["category"], "score", "truth"), metrics.f1(rows, ["category"], "score > 20", "truth"))
    return out.select("Category", F.round("AU", 9).alias("AU"), F.round("F1", 9).alias("F1"))


def density_subsample(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    return thinning.thin(rows, [], bank_id="vec_id", vector="embedding", target=100, subsets=1, chance=arrays.lcg_uniform("vec_id"), fill=False).select("vec_id")


def density_subsample_filled(spark, sf_dir):
    """The whole thinning, with several subsets and filling up: the rows that stay in each category and layer."""
    rows = table(spark, sf_dir, "prototype_embeddings").select(_clean("category"), "layer", "proto_id", "embedding").where("size(embedding) = 32").dropDuplicates(["proto_id"])
    finite = rows.where("forall(embedding, v -> v is not null and not isnan(v) and abs(v) < float('infinity'))")
    late = arrays.lcg_uniform(F.col("proto_id") * 31 + 7)
    kept = thinning.thin(finite, ["category", "layer"], bank_id="proto_id", vector="embedding", target=40, subsets=4, neighbours=5, chance=arrays.lcg_uniform("proto_id"), part=F.col("proto_id"), order=late)
    return kept.select("category", "layer", "proto_id")


def tile_plan(spark, sf_dir):
    dims = table(spark, sf_dir, "part").select((F.col("p_size") * 48 + 560).alias("size")).distinct()
    return tiling.axis_tiles(dims, "size", 640, 128, 16)


def _maps(spark, sf_dir) -> DataFrame:
    """Each embedding as a map of 8 x 8 pixels."""
    each = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("p", "v"))
    return each.select("vec_id", F.floor(F.col("p") / 8).cast("int").alias("y"), (F.col("p") % 8).alias("x"), F.col("v").cast("double").alias("score"))


def tile_cut_stitch(spark, sf_dir):
    """Maps cut into overlapping tiles, changed within the tiles, and put together again."""
    tokens = _maps(spark, sf_dir).withColumn("height", F.lit(8)).withColumn("width", F.lit(8))
    dims = spark.createDataFrame([(8,)], "height int")
    py, px = tiling.axis_tiles(dims, "height", 4, 1), tiling.axis_tiles(dims.withColumnRenamed("height", "width"), "width", 5, 1)
    cut = tiling.cut_tiles(tokens, py, px).withColumn("score", F.col("score") * 2)
    return tiling.stitch_tiles(cut, py, px).select("vec_id", F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), F.round("score", 7).alias("score"))


def bilinear_resize(spark, sf_dir):
    return resize_pixels(_maps(spark, sf_dir), ["vec_id"], (8, 8), (16, 12)).withColumn("score", F.round("score", 7))


def layer_mean(spark, sf_dir):
    """Token grids of two layers (the halves of a vector) brought to 8 x 16 and averaged."""
    tokens = _maps(spark, sf_dir).select(F.lit("c").alias("category"), F.floor(F.col("y") / 4).cast("int").alias("layer"), F.col("vec_id").alias("image_id"), (F.col("y") % 4).alias("ty"), F.col("x").alias("tx"), "score")
    sizes = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image_id"), F.lit(32).alias("height"), F.lit(64).alias("width"))
    return pixels(score_maps(tokens, sizes, 4)).select(F.col("image_id").alias("vec_id"), "y", "x", (F.round(F.col("score").cast("double"), 7) + F.lit(0.0)).alias("score"))


def _front(spark, sf_dir) -> DataFrame:
    return _maps(spark, sf_dir).where("score > 0.08").select("vec_id", "y", "x")


def dilation(spark, sf_dir):
    return morphology.dilate_pixels(_front(spark, sf_dir), ["vec_id"], CROSS, 8, 8)


def line_closing(spark, sf_dir):
    return morphology.close_line_pixels(_front(spark, sf_dir), ["vec_id"], LINE, 8, 8)


def ellipse_erosion(spark, sf_dir):
    return morphology.erode_pixels(_front(spark, sf_dir), ["vec_id"], morphology.offsets(morphology.ellipse_kernel(3)), 8, 8)


def fill_holes(spark, sf_dir):
    rows = _maps(spark, sf_dir).where("score > 0.0").select("vec_id", "y", "x")
    return morphology.fill_holes_pixels(rows, ["vec_id"], 8, 8)


def clean_maps(spark, sf_dir):
    """The whole chain of closing along lines of all angles, filling and erosion."""
    return morphology.clean_pixels(_maps(spark, sf_dir), ["vec_id"], 8, 8, 0.08, 2, 8, 0.5, 1)


def _exploded(rows: DataFrame, array, digits: int = 7) -> DataFrame:
    return rows.select("vec_id", F.posexplode(array).alias("place", "v")).select("vec_id", "place", F.round(F.col("v").cast("double"), digits).alias("value"))


def brightness_clip(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").withColumn("e", F.col("embedding").cast("array<double>"))
    return _exploded(rows, arrays.brightness("e", F.lit(0.8) + arrays.lcg_uniform("vec_id") * 0.4))


def channel_normalize(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").withColumn("e", F.col("embedding").cast("array<double>"))
    return _exploded(rows, arrays.channel_normalize("e", 22))


def l2_normalize(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").withColumn("e", F.transform("embedding", lambda x, i: x.cast("double") * (i + 1)))
    return _exploded(rows, arrays.l2_normalize("e"))


def _names(spark, sf_dir) -> DataFrame:
    rows = _samples(spark, sf_dir).select("sample_id", "category", "split", catalogs.stem(F.regexp_replace(F.trim("image_path"), r"\\", "/")).alias("name"))
    return validation.parsed_names(rows)


def name_validation(spark, sf_dir):
    return _names(spark, sf_dir).select("sample_id", "name", "index", "suffix")


def index_coverage(spark, sf_dir):
    names = _names(spark, sf_dir)
    wanted = names.groupBy("category", "split").agg((F.countDistinct("index") + F.length(F.first("category")) % 4).cast("int").alias("expected"))
    out = validation.index_coverage(names, wanted, ["category", "split"])
    return out.select("category", "split", F.concat_ws(",", F.transform("missing", lambda v: v.cast("string"))).alias("missing"), F.concat_ws(",", F.transform("extra", lambda v: v.cast("string"))).alias("extra"))


def prediction_violations(spark, sf_dir):
    """Violations of a prediction set that the samples' names stand for."""
    names = _names(spark, sf_dir).where("split in ('test_private', 'test_private_mixed')")
    base = names.select("category", "split", "name", "sample_id")
    files = base.select("category", "split", F.lit("tiff").alias("kind"), "name", F.when(F.col("sample_id") % 50 == 0, "float32").otherwise("float16").alias("dtype"), F.lit(2).alias("ndim"), F.lit(None).cast("boolean").alias("binary_values"))
    files = files.unionByName(base.select("category", "split", F.lit("png").alias("kind"), "name", F.lit("uint8").alias("dtype"), F.when(F.col("sample_id") % 70 == 0, 3).otherwise(2).alias("ndim"), (F.col("sample_id") % 60 != 0).alias("binary_values")))
    found = validation.violations(files, validation.expected(spark))
    return found.groupBy("rule", "category", "split").agg(F.count("*").alias("n"))


def stream_scores(spark, sf_dir):
    """Embeddings as a stream, scored against the bank; the rows are those of knn_top1_score."""
    bank, _ = _bank(spark, sf_dir)
    path = os.path.join(sf_dir, "embeddings.parquet")
    reader = spark.readStream.schema(bank.schema)
    stream = reader.parquet(path) if os.path.isdir(path) else reader.option("pathGlobFilter", "embeddings.parquet").parquet(sf_dir)
    out = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    queries = stream.where((F.col("label") > 6) | (F.col("vec_id") % 8 == 0))
    score_stream(queries, bank, f"{out}/scores", f"{out}/checkpoint", query_id="vec_id", bank_id="vec_id", vector="embedding", dim=DIM, threshold=0.015).awaitTermination()
    return spark.read.parquet(f"{out}/scores").select("vec_id", F.round("score", 9).alias("score"), "flag")


def _over_maps(rows: DataFrame, work, value: str = "double") -> DataFrame:
    """(vec_id, place, value) of work() on each embedding as a map of 8 x 8."""

    def run(batches):
        for batch in batches:
            found = [np.asarray(work(np.array(v, np.float32).reshape(8, 8))).ravel() for v in batch.column(1).to_pylist()]
            kind = {"double": pa.float64(), "int": pa.int32()}[value]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f.tolist() for f in found], pa.list_(kind))], names=["vec_id", "v"])

    return rows.select("vec_id", "embedding").mapInArrow(run, f"vec_id long, v array<{value}>").select("vec_id", F.posexplode("v").alias("place", "value"))


def half_scores(spark, sf_dir):
    """Scores as half-precision maps hold them."""
    return _over_maps(table(spark, sf_dir, "embeddings"), morphology.half)


def truth_resize(spark, sf_dir):
    """Truth masks of 8 x 8 brought to 5 x 3."""
    return _over_maps(table(spark, sf_dir, "embeddings"), lambda m: resize.truth_mask((m > 0.08).astype(np.uint8), 5, 3), "int")


def mask_decode(spark, sf_dir):
    """Grey masks of 8 x 8 as 0/1 of 12 x 20."""
    return _over_maps(table(spark, sf_dir, "embeddings"), lambda m: images.decode_mask(np.where(m > 0, 200.0, 90.0), 12, 20), "int")


def _pictures(spark, sf_dir) -> DataFrame:
    """Each sample's image once, as planar floats; unusable ones left out."""
    rows = table(spark, sf_dir, "industrial_samples").where("image is not null and sample_id is not null").select("sample_id", "height", "width", "image").dropDuplicates(["sample_id"])
    return images.bytes_to_pixels(rows).where("pixels is not null")


def channel_means(spark, sf_dir):
    """Images of raw bytes as pixels: the sum of each channel."""
    each = _pictures(spark, sf_dir).select("sample_id", F.posexplode("pixels").alias("p", "v"), (F.col("height") * F.col("width")).alias("n"))
    return each.groupBy("sample_id", F.floor(F.col("p") / F.col("n")).cast("int").alias("channel")).agg(F.round(F.sum(F.col("v").cast("double") * 255)).cast("long").alias("total"), F.count("*").alias("n"))


def image_files(spark, sf_dir):
    """Images written as PNG by the executors, listed, read by the image source and summed up."""
    folder = f"{shared_dir(spark)}/images-{uuid.uuid4().hex}"
    rows = _pictures(spark, sf_dir).select("sample_id", "height", "width", "image")

    def run(batches):
        for batch in batches:
            for i, h, w, d in zip(*(c.to_pylist() for c in batch.columns)):
                write_file(f"{folder}/{i}.png", write_png(np.frombuffer(d, np.uint8).reshape(h, w, 3)))
            yield pa.RecordBatch.from_arrays([batch.column(0)], names=["sample_id"])

    rows.mapInArrow(run, "sample_id long").write.format("noop").mode("overwrite").save()
    number = lambda c: F.regexp_extract(c, r"(\d+)\.png$", 1).cast("long").alias("sample_id")
    read = images.read_images(spark, folder).select(number("image_path"), "height", "width", F.round(F.aggregate("pixels", F.lit(0.0), lambda s, x: s + x * 255)).cast("long").alias("total"), F.round(F.col("pixels")[0] * 255).cast("int").alias("red"))
    return catalogs.list_files(spark, folder).select(number("path")).join(read, "sample_id")


def patch_tokens(spark, sf_dir):
    """Images of 16 x 16 cut into overlapping tiles, embedded, and flattened to tokens: the first channel's mean of each."""
    rows = _pictures(spark, sf_dir).where("height = 16 and width = 16").select(F.col("sample_id").cast("string").alias("image_path"), "height", "width", "pixels")
    found = images.embed(rows, images.patch_means(4, [7]), [7], 12, 4, 4)
    return found.select(F.col("image_path").cast("long").alias("sample_id"), "layer", "ty", "tx", F.round(F.col("embedding")[0].cast("double") * 255 * 16).cast("long").alias("red"))


def bicubic_resize(spark, sf_dir):
    """Images shrunk by a factor to whole pixels, bicubic with antialiasing."""
    rows = _pictures(spark, sf_dir).select(F.col("sample_id").cast("string").alias("image_path"), "height", "width", "pixels")
    out = images.preprocess(rows, 0.625)
    each = out.select(F.col("image_path").cast("long").alias("sample_id"), "height", "width", F.posexplode("pixels").alias("place", "v"))
    return each.groupBy("sample_id", "height", "width", F.floor(F.col("place") / (F.col("height") * F.col("width"))).cast("int").alias("channel")).agg(F.round(F.sum(F.col("v").cast("double") * (F.col("place") % 7 + 1)), 3).alias("total"))


def batch_sizes(spark, sf_dir):
    """Batches of at most 32 images, in an order by hash."""
    rows = _samples(spark, sf_dir).where("image_path is not null")
    sizes = images.batches(rows, 32, shuffle=True).groupBy("batch").agg(F.count("*").alias("n"))
    return sizes.agg(F.sum("n").alias("n"), (F.max("n") <= 32).alias("bounded"))


def map_files(spark, sf_dir):
    """Maps written as half-precision TIFF and PNG by the executors and read again."""
    folder = f"{shared_dir(spark)}/maps-{uuid.uuid4().hex}"
    rows = table(spark, sf_dir, "embeddings").select(F.lit("can").alias("category"), F.lit("test_public").alias("split"), F.col("vec_id").cast("string").alias("stem"), F.lit(8).alias("height"), F.lit(8).alias("width"), F.col("embedding").alias("scores"), F.transform("embedding", lambda x: x > 0.1).alias("flags"))
    predictions.export_maps(rows, folder)
    found = predictions.read_maps(spark, folder).select(F.regexp_extract("path", r"(\d+)\.[a-z]+$", 1).cast("long").alias("vec_id"), "kind", "dtype", F.posexplode("values").alias("place", "v"))
    return found.select("vec_id", "kind", "dtype", "place", F.col("v").cast("double").alias("value"))


def scores_csv(spark, sf_dir):
    """The score table as a CSV with its index, read again."""
    path = f"{shared_dir(spark)}/scores-{uuid.uuid4().hex}/scores.csv"
    predictions.write_scores(score_table(spark, sf_dir), path)
    return spark.read.csv(path, header=True, schema="place int, Category string, AU double, F1 double")


def fit_transform(spark, sf_dir):
    """A model of two layers (the halves of a vector) fitted on normal vectors, saved, loaded, and used on all others."""
    rows = table(spark, sf_dir, "embeddings").withColumn("category", F.concat(F.lit("c"), F.col("label") % 2))
    halves = F.explode(F.array(*[F.struct(F.lit(i + 1).alias("layer"), F.slice("embedding", 32 * i + 1, 32).alias("embedding")) for i in (0, 1)]))
    tokens = rows.select("category", "label", F.col("vec_id").alias("image_id"), F.lit(0).alias("ty"), F.lit(0).alias("tx"), halves.alias("h")).select("category", "label", "h.layer", "image_id", "ty", "tx", "h.embedding")
    sizes = rows.select(F.col("vec_id").alias("image_id"), F.lit(4).alias("height"), F.lit(4).alias("width"), F.when(F.col("vec_id") % 8 == 0, "threshold").otherwise("bank").alias("part"))
    model = AnomalyModel.fit(tokens.where("label <= 6").drop("label"), sizes, Params(dim=32, subsets=2, thinning_neighbours=5))
    folder = f"{shared_dir(spark)}/model-{uuid.uuid4().hex}"
    model.save(folder)
    out = AnomalyModel.load(spark, folder).transform(tokens.where("label > 6 or image_id % 8 = 0").drop("label"), sizes)
    return out.select("category", F.col("image_id").alias("vec_id"), F.round(F.col("scores")[0].cast("double"), 9).alias("score"), F.col("flags")[0].alias("flag"))


def evaluate_maps(spark, sf_dir):
    """Score table of maps against truth masks, of which every third is missing and so all good."""
    rows = table(spark, sf_dir, "embeddings")
    maps = rows.select(F.concat(F.lit("c"), F.col("label") % 4).alias("category"), F.col("vec_id").alias("image_id"), F.lit(8).alias("height"), F.lit(8).alias("width"), F.col("embedding").alias("scores"), F.transform("embedding", lambda x: x > 0.1).alias("flags"))
    truth = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda p: ((F.col("vec_id") * 7 + p * 13) % 10 < 2).cast("int"))
    masks = rows.select(F.col("vec_id").alias("image_id"), F.when(F.col("vec_id") % 11 == 0, -1).otherwise(1).alias("label"), F.lit(8).alias("height"), F.lit(8).alias("width"), F.when(F.col("vec_id") % 3 != 0, truth).alias("mask"))
    out = evaluate(maps, masks)
    return out.select("Category", F.round("AU", 9).alias("AU"), F.round("F1", 9).alias("F1"))


def map_problems(spark, sf_dir):
    """Masks whose map is missing or of another size."""
    rows = table(spark, sf_dir, "embeddings").select(F.concat(F.lit("c"), F.col("label")).alias("category"), F.col("vec_id").alias("image_id"), F.lit(8).alias("height"), F.lit(8).alias("width"), F.col("embedding").alias("scores"))
    maps = rows.where("image_id % 5 <> 0").withColumn("height", F.when(F.col("image_id") % 7 == 0, 4).otherwise(8))
    return find_map_problems(maps, rows)


_QUERIES = [
    flagship, knn_top1_score, knn_topk_mean, knn_normalized, knn_self_join, layer_scores, anomaly_threshold, pixel_threshold, train_stride, holdout_split, scored_labels, catalog_build, prediction_paths, partial_auc, full_auc, best_f1,
    f1_fixed_threshold, mean_of_category_means, score_table, density_subsample, density_subsample_filled, tile_plan, tile_cut_stitch, bilinear_resize, layer_mean, dilation, line_closing, ellipse_erosion, fill_holes, clean_maps, brightness_clip,
    half_scores, truth_resize, mask_decode, channel_means, image_files, patch_tokens, bicubic_resize, batch_sizes, map_files, scores_csv, fit_transform, evaluate_maps, map_problems,
    channel_normalize, l2_normalize, name_validation, index_coverage, prediction_violations, stream_scores,
]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _QUERIES}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
