"""Thresholds and detection metrics over pixels: percentile threshold, partial ROC area, F1 scores and their means."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from patchmill.operators.running import grouped, running_sums

ACCURACY = 10_000


def exact_percentile(df: DataFrame, keys: list[str], value: str, share: float) -> DataFrame:
    """(keys, n, value): the percentile with linear interpolation between neighbours, exact at any size.

    A first aggregation brackets it by approximate percentiles whose rank error is known; a second counts what lies below
    the bracket and groups the values in it, a few ten-thousandths of all. Groups of up to 2 * ACCURACY rows are their own
    bracket. Nulls and NaN are left out; a group of nothing else gives no row.
    """
    df, keys = grouped(df, keys)
    rows = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select(*keys, F.col(value).cast("double").alias("_v"))
    slack = 3 / ACCURACY
    ends = F.percentile_approx("_v", F.array(F.lit(max(0.0, share - slack)), F.lit(min(1.0, share + slack))), ACCURACY)
    small = F.count("*") <= 2 * ACCURACY
    bracket = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.when(small, F.min("_v")).otherwise(ends[0]).alias("_lo"), F.when(small, F.max("_v")).otherwise(ends[1]).alias("_hi")).where("n > 0")
    both = rows.join(bracket, keys).where("_v <= _hi").withColumn("_v", F.when(F.col("_v") < F.col("_lo"), F.lit(None)).otherwise(F.col("_v")))
    counts = both.groupBy(*keys, "n", "_v").agg(F.count("*").alias("_c"))  # the null stands for all below the bracket
    upto = F.sum("_c").over(Window.partitionBy(*keys).orderBy(F.asc_nulls_first("_v")))
    at = (F.col("n") - 1) * share
    ranked = counts.withColumn("_upto", upto).withColumn("_at", at)
    pick = lambda rank: F.min(F.when(F.col("_upto") > rank, F.col("_v")))
    out = ranked.groupBy(*keys, "n").agg(pick(F.floor("_at")).alias("_a"), pick(F.ceil("_at")).alias("_b"), F.first("_at").alias("_at"))
    return out.select(*keys, "n", (F.col("_a") + (F.col("_b") - F.col("_a")) * (F.col("_at") - F.floor("_at"))).alias("value")).drop("_all")


def anomaly_threshold(scores: DataFrame, keys: list[str], score: str, percentile: float = 95, factor: float = 1.421) -> DataFrame:
    """(keys, n, threshold): the percentile of all held-out scores times factor."""
    return exact_percentile(scores, keys, score, percentile / 100).select(*keys, "n", (F.col("value") * factor).alias("threshold"))


def score_counts(pixels: DataFrame, keys: list[str], score: str, truth: Column | str, bounded: bool = False) -> DataFrame:
    """(keys, score, pos, neg, tp, fp, all_pos, all_neg): positives and negatives of each score, of it and all higher ones,
    and of the group. bounded tells that no group has more rows than an image has pixels, so that one sort of it will do.

    Scores of half-precision maps have at most 65,536 values, so this is small whatever the number of pixels. Nulls and
    NaN scores are left out; a null truth counts as negative.
    """
    is_true = F.coalesce(F.expr(truth) if isinstance(truth, str) else truth, F.lit(False))
    rows = pixels.where(F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")))
    each = rows.groupBy(*keys, F.col(score).cast("double").alias("score")).agg(F.count_if(is_true).alias("pos"), F.count_if(~is_true).alias("neg"))
    if bounded:
        whole = Window.partitionBy(*keys)
        upto = whole.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
        ends = whole.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        return each.select("*", F.sum("pos").over(upto).alias("tp"), F.sum("neg").over(upto).alias("fp"), F.sum("pos").over(ends).alias("all_pos"), F.sum("neg").over(ends).alias("all_neg"))
    return running_sums(each, keys, "score", {"tp": "pos", "fp": "neg"}, {"all_pos": "pos", "all_neg": "neg"})


def partial_auc(pixels: DataFrame, keys: list[str], score: str, truth: Column | str, max_fpr: float = 0.05) -> DataFrame:
    """(keys, positives, negatives, auc): the area under the ROC curve up to max_fpr, brought to 0.5 for chance and 1.

    Equal scores are one step of the curve. Without positives or without negatives auc is null.
    """
    if not 0 < max_fpr <= 1:
        raise ValueError("max_fpr must be above 0 and at most 1")
    pixels, keys = grouped(pixels, keys)
    at = score_counts(pixels, keys, score, truth).withColumnsRenamed({"all_pos": "_p", "all_neg": "_n"})
    m = F.lit(float(max_fpr))
    x1, y1 = F.col("fp") / F.col("_n"), F.col("tp") / F.col("_p")
    x0, y0 = (F.col("fp") - F.col("neg")) / F.col("_n"), (F.col("tp") - F.col("pos")) / F.col("_p")
    cut = y0 + (y1 - y0) * (m - x0) / F.nullif(x1 - x0, F.lit(0.0))
    area = F.when(x1 <= m, (x1 - x0) * (y0 + y1) / 2).when(x0 < m, (m - x0) * (y0 + cut) / 2).otherwise(0.0)
    good = (F.col("_p") > 0) & (F.col("_n") > 0)
    out = at.groupBy(*keys, F.col("_p").alias("positives"), F.col("_n").alias("negatives")).agg(F.sum(F.when(good, area)).alias("_a"))
    low = max_fpr**2 / 2
    auc = F.col("_a") if max_fpr == 1 else 0.5 * (1 + (F.col("_a") - low) / (max_fpr - low))
    return out.select(*keys, "positives", "negatives", auc.alias("auc")).drop("_all")


def best_f1(pixels: DataFrame, keys: list[str], score: str, truth: Column | str, bounded: bool = False) -> DataFrame:
    """(keys, best_f1): the highest F1 over all thresholds; 0 without positives. bounded as for score_counts()."""
    pixels, keys = grouped(pixels, keys)
    at = score_counts(pixels, keys, score, truth, bounded)
    return at.groupBy(*keys).agg(F.coalesce(F.max(2 * F.col("tp") / (F.col("tp") + F.col("fp") + F.col("all_pos"))), F.lit(0.0)).alias("best_f1")).drop("_all")


def f1(pixels: DataFrame, keys: list[str], flag: Column | str, truth: Column | str) -> DataFrame:
    """(keys, tp, fp, fn, f1) of a binary map; f1 is 0 where nothing is flagged or true."""
    a, b = (F.coalesce(F.expr(c) if isinstance(c, str) else c, F.lit(False)) for c in (flag, truth))
    out = pixels.groupBy(*keys).agg(F.count_if(a & b).alias("tp"), F.count_if(a & ~b).alias("fp"), F.count_if(~a & b).alias("fn"))
    whole = 2 * F.col("tp") + F.col("fp") + F.col("fn")
    return out.withColumn("f1", F.when(whole > 0, 2 * F.col("tp") / whole).otherwise(0.0))


def mean_of_means(scores: DataFrame, group: str, value: str) -> DataFrame:
    """(group, value): the mean of each group and, as group 'mean', the mean of these means, whatever their sizes."""
    each = scores.groupBy(group).agg(F.avg(value).alias(value))
    return each.unionByName(each.agg(F.lit("mean").alias(group), F.avg(value).alias(value)))


def score_table(auc: DataFrame, f1s: DataFrame, category: str = "category") -> DataFrame:
    """(Category, AU, F1): a row for each category and one, 'mean', of their plain means; nothing if nothing was scored."""
    each = auc.join(f1s, category).select(F.col(category).alias("Category"), F.col("auc").alias("AU"), F.col("f1").alias("F1"))
    mean = each.agg(F.lit("mean").alias("Category"), F.avg("AU").alias("AU"), F.avg("F1").alias("F1"), F.count("*").alias("_n")).where("_n > 0").drop("_n")
    return each.unionByName(mean)
