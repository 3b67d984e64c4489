"""Running sums over long ordered groups, cut into ranges so that no task handles a whole group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RANGES = 256


def grouped(df: DataFrame, keys: list[str]) -> tuple[DataFrame, list[str]]:
    """df and keys; without keys all rows are one group, under a column _all."""
    return (df, keys) if keys else (df.withColumn("_all", F.lit(0)), ["_all"])


def running_sums(df: DataFrame, keys: list[str], order: str, values: dict[str, str], totals: dict[str, str] = {}) -> DataFrame:  # noqa: B006
    """df with, for each name in values, the sum of that column over the rows of higher or equal `order` in the group, and
    for each name in totals the column's sum over the group.

    Rows must be unique in keys and order. Ranges of order hold about as many rows each: their bounds are approximate
    percentiles. A range's sums come first, and within a range rows are summed on their own.
    """
    shares = F.array(*[F.lit(i / RANGES) for i in range(1, RANGES)])
    columns = df.columns
    df, keys = grouped(df, keys)
    bounds = df.groupBy(*keys).agg(F.percentile_approx(order, shares, 4 * RANGES).alias("_bounds"))
    rows = df.join(bounds, keys).withColumn("_range", F.size(F.filter("_bounds", lambda b: b <= F.col(order)))).drop("_bounds")
    above = Window.partitionBy(*keys).orderBy(F.desc("_range")).rowsBetween(Window.unboundedPreceding, -1)
    within = Window.partitionBy(*keys, "_range").orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, 0)
    sums = rows.groupBy(*keys, "_range").agg(*[F.sum(c).alias(f"_s_{n}") for n, c in (values | totals).items()])
    sums = sums.select(*keys, "_range", *[F.coalesce(F.sum(f"_s_{n}").over(above), F.lit(0)).alias(f"_b_{n}") for n in values], *[F.sum(f"_s_{n}").over(Window.partitionBy(*keys)).alias(n) for n in totals])
    out = rows.select("*", *[F.sum(c).over(within).alias(f"_w_{n}") for n, c in values.items()]).join(sums, [*keys, "_range"])
    return out.select(*columns, *[(F.col(f"_w_{n}") + F.col(f"_b_{n}")).alias(n) for n in values], *totals)
