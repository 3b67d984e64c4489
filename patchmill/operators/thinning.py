"""Density-adaptive thinning of a bank of embeddings: crowded places lose most, isolated vectors stay."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from patchmill.functions.arrays import uniform
from patchmill.operators.knn import knn_join, nearest, query_block
from patchmill.operators.running import grouped
from patchmill.runtime import written

MAX_STEPS = 400
SUBSET_ROWS = 20_000


def keep_by_density(distances: np.ndarray, u: np.ndarray, target: int, growth: float = 1.1) -> np.ndarray:
    """Which rows stay: each with chance 1 / (1 + number of its neighbours within r), at the least r that leaves target.

    distances are each row's to its k nearest, itself included; u is one number in [0, 1) for each row. r starts at a
    tenth of the mean distance and grows by a tenth. Where no r of MAX_STEPS leaves so few (all distances 0, or a target
    below what k neighbours can thin to) the target rows of least u stay.
    """
    r = float(np.mean(distances)) / 10
    for _ in range(MAX_STEPS):
        keep = u < 1.0 / ((distances < r).sum(1) + 1)
        if keep.sum() <= target:
            return keep
        r *= growth
    keep = np.zeros(len(u), bool)
    keep[np.lexsort((np.arange(len(u)), u))[:target]] = True
    return keep


def _needed(u: np.ndarray, k: int) -> np.ndarray:
    """How many neighbours within r make a row of chance u go: the least c with u >= 1 / (1 + c); k + 1 if k are too few."""
    counts = 1.0 / (np.arange(k + 1) + 1.0)
    return (u[:, None] < counts).sum(1)


def thin(bank: DataFrame, keys: list[str], *, bank_id: str, vector: str, target: int, subsets: int = 100, neighbours: int = 100, seed: int = 42, chance: Column | None = None, part: Column | None = None, order: Column | None = None, fill: bool = True) -> DataFrame:
    """The rows of bank that stay: target in each group of keys, or all rows of a group with no more than that.

    Each group is dealt into subsets, by a hash or by the number part modulo their count; a subset keeps its share of the
    target by the rule of keep_by_density() on its own nearest neighbours. What is missing to the target is filled up from
    the other rows in the order of their hash, or of order, unless fill is off. All chance comes from the id and the seed;
    ids must be unique in a group. Null vectors are left out.

    A subset of up to SUBSET_ROWS rows finds its neighbours in one task, a larger one block by block by knn_join. A row
    goes when the radius passes its distance to the neighbour that its chance asks for, so all else is counting: the
    radius is an order statistic of the steps at which rows go, whatever the size of a subset.
    """
    rows, keys = grouped(bank.where(F.col(vector).isNotNull() & F.col(bank_id).isNotNull()), keys)
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("_n")).withColumn("_parts", F.least(F.lit(subsets), F.ceil(F.col("_n") / max(2, neighbours))))
    u = uniform(F.col(bank_id), seed) if chance is None else chance
    number = F.xxhash64(bank_id, F.lit(seed + 1)) if part is None else part
    late = F.xxhash64(bank_id, F.lit(seed + 2)) if order is None else order
    small = rows.select(*keys, F.col(bank_id).alias("_id"), F.col(vector).alias("_v"), u.alias("_u"), number.alias("_number"), late.alias("_late"))
    dealt = small.join(sizes, keys).withColumn("_part", F.pmod("_number", "_parts")).drop("_number")
    by = [*keys, "_part"]
    crowded = dealt.where(F.col("_n") > target)
    counts = crowded.groupBy(*by).agg(F.count("*").alias("_m"))
    out = T.StructType([*(crowded.schema[c] for c in [*by, "_id", "_u", "_late"]), T.StructField("_sum", T.DoubleType()), T.StructField("_seen", T.IntegerType()), T.StructField("_d", T.DoubleType())])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_id")
        x = np.stack(pdf["_v"].to_numpy()).astype(float)
        need = _needed(pdf["_u"].to_numpy(), neighbours)
        total, at = np.empty(len(x)), np.full(len(x), np.nan)
        step = query_block(len(x))
        for i in range(0, len(x), step):
            d = nearest(x[i : i + step], x, np.arange(len(x)), neighbours)[0]
            total[i : i + step] = d.sum(1)
            n = need[i : i + step]
            has = np.flatnonzero((n >= 1) & (n <= d.shape[1]))
            at[i + has] = d[has, n[has] - 1]
        told = pdf[[*by, "_id", "_u", "_late"]].assign(_sum=total, _seen=np.int32(min(neighbours, len(x))))
        return told.assign(_d=pd.array(at, "Float64"))

    large = counts.where(F.col("_m") > SUBSET_ROWS)
    if large.isEmpty():
        told = crowded.select(*by, "_id", "_v", "_u", "_late").groupBy(*by).applyInPandas(run, out)
    else:
        of = crowded.join(large.drop("_m"), by, "left_semi")
        told = crowded.join(large.drop("_m"), by, "left_anti").select(*by, "_id", "_v", "_u", "_late").groupBy(*by).applyInPandas(run, out)
        near = knn_join(of, of, query_id="_id", bank_id="_id", vector="_v", k=neighbours, keys=by)
        # the least c with u >= 1 / (1 + c), as in _needed()
        need = F.size(F.filter(F.sequence(F.lit(0), F.lit(neighbours)), lambda c: F.col("_u") < 1.0 / (c + F.lit(1.0))))
        each = near.join(of.select(*by, "_id", "_u", "_late"), [*by, "_id"]).groupBy(*by, "_id", "_u", "_late")
        told = told.unionByName(each.agg(F.sum("distance").alias("_sum"), F.count("*").cast("int").alias("_seen"), F.max(F.when(F.col("rank") == need, F.col("distance"))).alias("_d")))
    told = written(told)

    # the step at which each row goes: the least j with d < r0 * 1.1 ** j
    start = told.groupBy(*by).agg(F.count("*").alias("_m"), (F.sum("_sum") / F.sum("_seen") / 10).alias("_r0"))
    fits = F.filter(F.sequence(F.greatest(F.lit(0), F.floor(F.log(F.col("_d") / F.col("_r0")) / np.log(1.1)).cast("int") - 1), F.lit(MAX_STEPS - 1)), lambda j: F.col("_d") < F.col("_r0") * F.pow(F.lit(1.1), j))
    first = F.when((F.col("_r0") > 0) & (F.col("_d") == 0), F.lit(0)).when((F.col("_r0") > 0) & (F.col("_d") < F.col("_r0") * 1.1 ** (MAX_STEPS - 1)), F.array_min(fits))
    steps = told.join(start, by).select(*by, "_id", "_u", "_late", "_m", first.alias("_j"))
    wanted = F.floor(F.lit(target) / F.col("_parts")).cast("long")
    share = sizes.select(*keys, wanted.alias("_share"))
    gone = steps.groupBy(*by, "_m", "_j").agg(F.count("*").alias("_c")).where("_j is not null").join(share, keys)  # at most MAX_STEPS rows a subset
    upto = F.sum("_c").over(Window.partitionBy(*by).orderBy("_j"))
    stop = gone.withColumn("_gone", upto).where("_m - _gone <= _share").groupBy(*by).agg(F.min("_j").alias("_stop"))
    ruled = steps.join(share, keys).join(stop, by, "left").withColumn("_stop", F.when(F.col("_m") <= F.col("_share"), F.lit(0)).otherwise(F.col("_stop")))
    open_ = ruled.where("_stop is null")  # no radius leaves so few
    least = F.row_number().over(Window.partitionBy(*by).orderBy("_u", "_id"))
    head = [*keys, "_id", "_late"]
    forced = open_.withColumn("_r", least).where(F.col("_r") <= target).select(*head, (F.col("_r") <= F.col("_share")).alias("_kept"))
    rest = open_.select(*head).join(forced.select(*keys, "_id"), [*keys, "_id"], "left_anti").select(*head, F.lit(False).alias("_kept"))
    ended = ruled.where("_stop is not null").select(*head, (F.col("_j").isNull() | (F.col("_j") > F.col("_stop"))).alias("_kept"))
    whole = dealt.where(F.col("_n") <= target).select(*head, F.lit(True).alias("_kept"))
    told = written(ended.unionByName(forced).unionByName(rest).unionByName(whole))
    chosen = told.where("_kept").select(*keys, "_id")
    if fill:
        have = chosen.groupBy(*keys).agg(F.count("*").alias("_have"))
        spare = told.where("not _kept").withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy("_late", "_id"))).where(F.col("_r") <= target)
        more = spare.join(have, keys, "left").where(F.col("_r") <= target - F.coalesce("_have", F.lit(0)))
        chosen = chosen.unionByName(more.select(*keys, "_id"))
    return rows.join(chosen.withColumnRenamed("_id", bank_id), [*keys, bank_id], "left_semi").drop("_all")


def random_subset(rows: DataFrame, keys: list[str], row_id: str, n: int, seed: int = 42) -> DataFrame:
    """n rows of each group without replacement, by a hash of their id."""
    order = Window.partitionBy(*keys).orderBy(F.xxhash64(row_id, F.lit(seed)), row_id)
    return rows.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= n).drop("_r")
