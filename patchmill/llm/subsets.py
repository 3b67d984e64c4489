"""A varied subset of given size from each collection: distributed farthest-first k-center.

1. The distinct vectors of a collection are cut into partitions of near vectors, around pivots chosen by a hash. In each
   partition farthest-first runs over all vectors: each has a radius, its distance to those picked before it. The
   partitions' representatives are the vectors whose radius is among the largest OVERSAMPLE * size of the whole
   collection, so a partition full of rare kinds gives nearly all it has and a crowded one few.
2. The representatives are pooled, cut anew around other pivots, so that the borders of the first cut lie inside the
   partitions of the second, and farthest-first runs again. A pool of up to 2 * `pool_part` stays in one piece.
3. The size is reached by the largest radii of the second run.

Every vector lies within the first run's last radius of a representative and each of these within the second's of a
chosen one. Both cuts by radius are order statistics, found by the cutting-plane search, so no task ranks a whole
collection. Pivots stay on the executors unless those of all collections fit a bounded broadcast. A partition costs the
square of its size, whatever the collection's size, so work grows with the rows.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from patchmill.llm import cutoffs
from patchmill.llm.beside import MODEL_BYTES, Step, beside, numbered
from patchmill.llm.vectors import _matrix, usable
from patchmill.runtime import bounded_batches, written

PART = 1024
POOL_PART = 4096
OVERSAMPLE = 2
MAX_PIVOTS = 256
LEVELS = 4


def farthest_first(x: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, radii): size rows of x, each the farthest from those before; the first is the farthest from the mean.

    A row's radius is its distance to those before, the first one's its distance to the mean. Equal distances are settled
    by the lower row.
    """
    n = len(x)
    size = min(size, n)
    sq = (x * x).sum(1)
    centre = x.mean(0)
    far = np.maximum(sq - 2 * (x @ centre) + centre @ centre, 0)
    rows, radii = np.empty(size, np.int64), np.empty(size)
    for i in range(size):
        at = int(far.argmax())
        rows[i], radii[i] = at, far[at]
        d = np.maximum(sq - 2 * (x @ x[at]) + sq[at], 0)
        far = d if not i else np.minimum(far, d, out=far)
        far[at] = -1
    return rows, np.sqrt(np.maximum(radii, 0))


def _radii(keys: list[str], dim: int, out: T.StructType):
    """All vectors of one partition with their radius."""
    arrow = to_arrow_schema(out)

    def run(t: pa.Table) -> pa.Table:
        t = t.take(pc.sort_indices(t.column("_id")))
        rows, radii = farthest_first(_matrix(pa.concat_arrays(t.column("_v").chunks), dim), t.num_rows)
        t = t.take(pa.array(rows))
        return pa.Table.from_arrays([*(t.column(c) for c in (*keys, "_id", "_v", "_copies")), pa.array(radii)], schema=arrow)

    return run


class _Nearest(Step):
    """Moves each row to the region around its nearest pivot; rows without pivots stay in theirs."""

    def __init__(self, width: int, dim: int, names: list[str]):
        self.width, self.dim, self.names = width, dim, names

    def feed(self, number: int, model: np.ndarray | None, rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        region = rows.column(self.width)
        if model is not None:
            x = _matrix(rows.column(self.width + 2), self.dim)
            half = 0.5 * (model * model).sum(1)
            at = np.concatenate([(half - x[i : i + 4096] @ model.T).argmin(1) for i in range(0, len(x), 4096)])
            h = (region.to_numpy(zero_copy_only=False).astype(np.uint64) + at.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
            region = pa.array((h ^ (h >> np.uint64(31))).view(np.int64))
        yield pa.RecordBatch.from_arrays([*rows.columns[: self.width], region, *rows.columns[self.width + 1 :]], names=self.names)


def _parts(rows: DataFrame, own: list[str], dim: int, part: int, seed: int, model_bytes: int) -> DataFrame:
    """rows (own, _id, _v, _copies) with _region and _cut, which together name partitions of about part near vectors and
    of 2 * part at most, but for chance where a region that pivots cannot divide is cut by hash."""
    rows = rows.select(*own, F.lit(0).cast("long").alias("_region"), "_id", "_v", "_copies")
    by, names, schema = [*own, "_region"], rows.columns, rows.schema
    codes = T.StructType([*(schema[c] for c in by), T.StructField("_n", T.LongType()), T.StructField("_m", T.BinaryType())])

    def pivots(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        p = np.stack(pdf.sort_values("_id")["_v"].to_numpy()).astype(np.float32)
        return pd.DataFrame([[*key, int(pdf["_m"].iat[0]), pickle.dumps(p)]], columns=codes.names)

    for level in range(LEVELS):
        large = written(rows.groupBy(*by).agg(F.count("*").alias("_m")).where(F.col("_m") > 2 * part))
        if large.isEmpty():
            return rows.withColumn("_cut", F.lit(0).cast("long"))
        if level:
            rows = written(rows)
        low = F.pmod(F.xxhash64("_id", F.lit(seed + level)), F.lit(1 << 30)) < F.least(F.ceil(2 * F.col("_m") / part), F.lit(MAX_PIVOTS)) * F.lit(1 << 30) / F.col("_m")
        models = written(numbered(rows.join(large, by).where(low).groupBy(*by).applyInPandas(pivots, codes)))
        rows = beside(rows, models, by, lambda: _Nearest(len(own), dim, names), schema, model_bytes, True)
    large = rows.groupBy(*by).agg(F.count("*").alias("_m")).where(F.col("_m") > 2 * part)
    return rows.join(large, by, "left").withColumn("_cut", F.pmod(F.xxhash64("_id", F.lit(seed)), F.coalesce(F.ceil(F.col("_m") / part), F.lit(1)))).drop("_m")


def _size(n, permille):
    """Number to choose of n."""
    return F.when(permille <= 0, 0).otherwise(F.least(n, F.greatest(F.lit(1), F.floor((n * permille + 500) / 1000)))).cast("long")


def varied_subset(vectors: DataFrame, targets: DataFrame, keys: list[str], *, vec_id: str, vector: str, dim: int, permille: str = "subset_permille", part: int = PART, pool_part: int = POOL_PART, model_bytes: int = MODEL_BYTES) -> DataFrame:
    """(keys, id, copies, radius): the chosen vectors of each collection.

    The size is permille / 1000 of the collection's distinct usable vectors, rounded to the nearest, at least 1 and at
    most all; none for 0 or less. A vector is usable with exactly dim finite values that are not all zero and non-null
    id and keys. Rows with equal vectors count once, under their lowest id; copies is their number. A target that is
    null or given for no usable vector gives no row, nor do collections without a target; the highest of several
    targets holds. Equal radii are settled by a hash of the id. Other columns are ignored.
    """
    bounded_batches(vectors.sparkSession)
    own = [f"_k{i}" for i in range(len(keys))]
    named_cols = [F.col(c).alias(o) for c, o in zip(keys, own)]
    rows = vectors.where(usable(vector, dim)).select(*named_cols, F.col(vec_id).cast("long").alias("_id"), F.col(vector).cast("array<float>").alias("_v")).dropna(subset=[*own, "_id"])
    aim = targets.where(F.col(permille).isNotNull()).groupBy(*keys).agg(F.max(permille).alias("_permille")).select(*named_cols, "_permille")
    named = rows.select(*own).schema.fields
    out = T.StructType([*named, T.StructField("_id", T.LongType()), T.StructField("_v", T.ArrayType(T.FloatType())), T.StructField("_copies", T.LongType()), T.StructField("_radius", T.DoubleType())])

    distinct = written(rows.join(aim.where("_permille > 0"), own, "left_semi").groupBy(*own, "_v").agg(F.min("_id").alias("_id"), F.count("*").alias("_copies")).select(*own, "_id", "_v", "_copies"))
    sizes = written(distinct.groupBy(*own).agg(F.count("*").alias("_n")).join(aim, own).withColumn("_size", _size(F.col("_n"), F.col("_permille"))))

    def spread(rows: DataFrame, part: int, seed: int) -> DataFrame:
        ranked = _parts(rows, own, dim, part, seed, model_bytes).groupBy(*own, "_region", "_cut").applyInArrow(_radii(own, dim, out), out)
        # one number that orders by radius, then by a hash: 31 bits of the radius as a float, 21 of the hash
        return written(ranked.withColumn("_score", _ordered(F.col("_radius"), F.col("_id"))))

    def cut(ranked: DataFrame, times: int) -> DataFrame:
        found = cutoffs.cutoffs(ranked, sizes.select(*own, (F.col("_size") * times).alias("_need")), own, score="_score", count="_need")
        return ranked.join(found.select(*own, "cutoff"), own)

    pool = cut(spread(distinct, part, 31), OVERSAMPLE).where("_score >= cutoff").select(*own, "_id", "_v", "_copies")
    ranked = cut(spread(pool, pool_part, 47), 1)
    sure = ranked.where("_score > cutoff")
    # those that share the cutoff itself: few, as they share the hash
    have = sure.groupBy(*own).agg(F.count("*").alias("_have"))
    order = F.row_number().over(Window.partitionBy(*own).orderBy("_id"))
    rest = ranked.where("_score = cutoff").withColumn("_r", order).join(sizes.select(*own, "_size"), own).join(have, own, "left").where("_r <= _size - coalesce(_have, 0)")
    chosen = sure.select(*own, "_id", "_copies", "_radius").unionByName(rest.select(*own, "_id", "_copies", "_radius"))
    return chosen.select(*[F.col(o).alias(k) for o, k in zip(own, keys)], F.col("_id").alias("id"), F.col("_copies").alias("copies"), F.col("_radius").alias("radius"))


def _ordered(radius, vec_id):
    """A double, exact as an integer, that orders as the radius (to float precision) and then as a hash of the id."""
    r = radius.cast("float").cast("double")
    exponent = F.when(r > 0, F.floor(F.log2(r))).otherwise(-200.0)
    exponent = F.greatest(F.lit(-200.0), F.least(F.lit(200.0), exponent))
    mantissa = F.floor(r / F.pow(F.lit(2.0), exponent) * (1 << 22))
    return (exponent + 200) * float(1 << 44) + mantissa * float(1 << 21) + F.pmod(F.xxhash64(vec_id, F.lit(9)), F.lit(1 << 21)).cast("double")
