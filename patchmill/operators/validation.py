"""Checks of a prediction set before it is packed: rows for what is wrong, or an error for the first of them."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patchmill.functions.settings import CATEGORIES, EXPECTED_COUNTS, SUBMISSION_SPLITS
from patchmill.runtime import is_folder

VIOLATION = "rank int, rule string, category string, split string, detail string"
#: In the order in which they are reported.
RULES = ["missing_folder", "tiff_count", "png_count", "tiff_name", "tiff_suffix", "tiff_index", "png_name", "png_suffix", "png_index", "tiff_shape", "tiff_type", "png_shape", "png_values"]
# Fixed value: the pattern of map names.
NAME = r"^(\d{3})_(regular|mixed)$"


def expected(spark: SparkSession, counts: dict[str, int] | None = None) -> DataFrame:
    """(category, split, expected): how many maps each category must have in each split."""
    counts = EXPECTED_COUNTS if counts is None else counts
    return spark.createDataFrame([(c, s, n) for c, n in counts.items() for s in SUBMISSION_SPLITS], "category string, split string, expected int")


def parsed_names(files: DataFrame, name: str = "name") -> DataFrame:
    """files with `index` and `suffix` of a well-formed name, else null."""
    ok = F.col(name).rlike(NAME)
    return files.withColumn("index", F.when(ok, F.regexp_extract(name, NAME, 1).cast("int"))).withColumn("suffix", F.when(ok, F.regexp_extract(name, NAME, 2)))


def index_coverage(files: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, missing, extra): the first five indices that lack and that are too many; groups without either give no row.

    wanted has keys and `expected`; the indices must be 0 to expected - 1. The two sets are compared by one outer join.
    """
    want = wanted.where("expected > 0").select(*keys, F.explode(F.sequence(F.lit(0), F.col("expected") - 1)).alias("index"))
    have = files.where("index is not null").select(*keys, "index").distinct()
    both = want.withColumn("_w", F.lit(True)).join(have.withColumn("_h", F.lit(True)), [*keys, "index"], "full_outer").where("_w is null or _h is null")
    # ranks, so that only five of each kind are ever gathered
    from pyspark.sql import Window

    r = F.row_number().over(Window.partitionBy(*keys, F.col("_w").isNull()).orderBy("index"))
    first = both.withColumn("_r", r).where(F.col("_r") <= 5)
    gather = lambda c: F.array_sort(F.collect_list(F.when(c, F.col("index"))))
    return first.groupBy(*keys).agg(gather(F.col("_h").isNull()).alias("missing"), gather(F.col("_w").isNull()).alias("extra"))


def violations(files: DataFrame, wanted: DataFrame) -> DataFrame:
    """(rank, rule, category, split, detail) of a set of files.

    files: category, split, kind ('tiff' or 'png'), name (without suffix), dtype, ndim, binary_values (whether all values
    are 0 or 255). wanted: category, split, expected. A split in which a kind has no file at all counts as missing.
    """
    keys = ["category", "split"]
    rank = F.create_map(*[v for i, r in enumerate(RULES) for v in (F.lit(r), F.lit(i))])
    rows = parsed_names(files.join(wanted.select(*keys), keys, "left_semi"))

    def say(cond, rule, detail):
        return F.when(cond, F.struct(rule.alias("rule"), detail.alias("detail")))

    def told(df: DataFrame, *said) -> DataFrame:
        each = df.select(*keys, F.explode(F.array_compact(F.array(*said))).alias("_s"))
        return each.select(F.element_at(rank, F.col("_s.rule")).alias("rank"), F.col("_s.rule").alias("rule"), *keys, F.col("_s.detail").alias("detail"))

    # what single files show
    kind, two = F.col("kind"), F.coalesce(F.col("ndim") == 2, F.lit(False))
    of = lambda what: F.concat(kind, F.lit(what))
    suffix = F.when(F.col("split") == "test_private", "regular").otherwise("mixed")
    single = told(
        rows.where(kind.isin("tiff", "png")),
        say(F.col("index").isNull(), of("_name"), F.col("name")),
        say(F.col("suffix") != suffix, of("_suffix"), F.col("name")),
        say(~two, of("_shape"), F.col("name")),
        say((kind == "tiff") & two & (F.coalesce("dtype", F.lit("")) != "float16"), F.lit("tiff_type"), F.concat("name", F.lit(" "), F.coalesce("dtype", F.lit("unknown")))),
        say((kind == "png") & two & ~F.coalesce("binary_values", F.lit(False)), F.lit("png_values"), F.col("name")),
    )
    # what a split shows: numbers of files, and indices, of which the name pattern allows a thousand
    counts = rows.groupBy(*keys).agg(*[f for k in ("tiff", "png") for f in (F.count_if(kind == k).alias(k), F.collect_set(F.when(kind == k, F.col("index"))).alias(f"_{k}"))])
    none = F.array().cast("array<int>")
    counted = wanted.join(counts, keys, "left").na.fill(0, ["tiff", "png"]).withColumn("_want", F.when(F.col("expected") > 0, F.sequence(F.lit(0), F.col("expected") - 1)).otherwise(none))
    said = [say((F.col("expected") > 0) & ((F.col("tiff") == 0) | (F.col("png") == 0)), F.lit("missing_folder"), F.when(F.col("tiff") == 0, F.lit("anomaly_images")).otherwise("anomaly_images_thresholded"))]
    five = lambda a: F.to_json(F.slice(F.array_sort(a), 1, 5))
    for k in ("tiff", "png"):
        have = F.coalesce(f"_{k}", none)
        lack, more = F.array_except("_want", have), F.array_except(have, F.col("_want"))
        said.append(say(F.col(k) != F.col("expected"), F.lit(f"{k}_count"), F.concat(F.col(k), F.lit(" of "), F.col("expected"))))
        said.append(say((F.size(lack) > 0) | (F.size(more) > 0), F.lit(f"{k}_index"), F.concat(F.lit("missing "), five(lack), F.lit(" extra "), five(more))))
    return single.unionByName(told(counted, *said))


def check(found: DataFrame) -> None:
    """Raises ValueError with the first violation by category, split and rule."""
    first = found.orderBy("category", "split", "rank", "detail").first()
    if first is not None:
        raise ValueError(f"{first.rule} in {first.category}/{first.split}: {first.detail}")


def check_folder(spark: SparkSession, results: str, counts: dict[str, int] | None = None) -> None:
    """check() of a results folder; missing folders raise FileNotFoundError first."""
    from patchmill.sources.predictions import read_maps

    roots = [results, *(os.path.join(results, d) for d in ("anomaly_images", "anomaly_images_thresholded"))]
    for c in (counts or EXPECTED_COUNTS) if counts is not None else CATEGORIES:
        roots += [os.path.join(results, d, c, s) for s in SUBMISSION_SPLITS for d in ("anomaly_images", "anomaly_images_thresholded")]
    for r in roots:
        if not is_folder(r):
            raise FileNotFoundError(r)
    where = r"(anomaly_images|anomaly_images_thresholded)/([^/]+)/([^/]+)/([^/]+)\.(tiff|png)$"
    part = lambda i: F.regexp_extract("path", where, i)
    maps = read_maps(spark, results)
    files = maps.where(F.col("path").rlike(where)).select(part(2).alias("category"), part(3).alias("split"), part(5).alias("kind"), part(4).alias("name"), "dtype", "ndim", F.forall("values", lambda v: v.isin(0.0, 255.0)).alias("binary_values"), part(1).alias("folder"))
    files = files.where("(kind = 'tiff') = (folder = 'anomaly_images')")
    check(violations(files, expected(spark, counts)))
