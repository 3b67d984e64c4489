"""Exact nearest neighbours of query vectors in a bank, overall or within keys such as category and layer."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: A bank up to this many bytes is broadcast; a larger one is joined block by block.
BROADCAST_BYTES = 64 << 20
BLOCK_ROWS = 20_000


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-12)


def _matrix(values: pa.Array) -> np.ndarray:
    flat = np.asarray(values.flatten().to_numpy(zero_copy_only=False), dtype=float)
    return flat.reshape(len(values), -1) if len(values) else flat.reshape(0, 0)


def query_block(bank_rows: int, explicit: int | None = None) -> int:
    """How many queries meet the bank at once: as many as keep the distances within about 32 MB, or what is asked for."""
    return explicit or max(1, (1 << 22) // max(1, bank_rows))


def nearest(queries: np.ndarray, bank: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(distances, ids), each queries x k, in order of distance and then id; ids must ascend.

    The matrix product names the candidates; their distances are computed again from the differences.
    """
    k = min(k, len(bank))
    sq = (queries * queries).sum(1)[:, None] + (bank * bank).sum(1) - 2 * queries @ bank.T
    if k < len(bank):
        kth = np.partition(sq, k - 1, axis=1)[:, k - 1]
        slack = 1e-9 * (1 + np.abs(sq).max(initial=0))
        r, c = np.nonzero(sq <= (kth + slack)[:, None])
    else:
        r, c = (v.ravel() for v in np.indices(sq.shape))
    d = np.sqrt(((queries[r] - bank[c]) ** 2).sum(1))
    order = np.lexsort((ids[c], d, r))
    r, c, d = r[order], c[order], d[order]
    keep = np.arange(len(r)) - np.searchsorted(r, r) < k
    return d[keep].reshape(-1, k), ids[c[keep]].reshape(-1, k)


def _out(queries: DataFrame, keys: list[str], query_id: str) -> T.StructType:
    return T.StructType([*(queries.schema[c] for c in keys), queries.schema[query_id], T.StructField("neighbour", T.LongType()), T.StructField("distance", T.DoubleType()), T.StructField("rank", T.IntegerType())])


def knn_join(queries: DataFrame, bank: DataFrame, *, query_id: str, bank_id: str, vector: str, k: int = 1, keys: list[str] = [], normalize: bool = False, exclude_self: bool = False, block: int | None = None) -> DataFrame:  # noqa: B006
    """(keys, query_id, neighbour, distance, rank): the k nearest bank vectors of each query within its keys.

    Euclidean, ties to the lower bank id. Rows with a null id, key or vector take no part. A query whose keys have no bank
    vector gives no row; fewer than k vectors give fewer rows. All vectors must have one length.

    The bank is checked first: up to BROADCAST_BYTES it goes to every task and queries pass as they lie, without a
    shuffle. Beyond, bank and queries meet block by block: each block of BLOCK_ROWS bank vectors gives every query its k
    best, and these are merged. block sets how many queries meet the bank at once.
    """
    spark = queries.sparkSession
    q = queries.select(*keys, query_id, F.col(vector).alias("_v")).dropna()
    b = bank.select(*keys, F.col(bank_id).cast("long").alias("_b"), F.col(vector).alias("_v")).dropna()
    rows, dim = b.agg(F.count("*"), F.max(F.size("_v"))).first()
    more = k + (1 if exclude_self else 0)
    schema = _out(queries, keys, query_id)
    if not rows:
        return spark.createDataFrame([], schema)
    if rows * (8 * dim + 64) <= BROADCAST_BYTES:
        held: dict[tuple, tuple] = {}
        pdf = b.toPandas()  # at most BROADCAST_BYTES
        for key, g in pdf.groupby(keys, sort=False) if keys else [((), pdf)]:
            g = g.sort_values("_b")
            x = np.stack(g["_v"].to_numpy()).astype(float)
            held[key if isinstance(key, tuple) else (key,)] = _unit(x) if normalize else x, g["_b"].to_numpy()
        parts = q.mapInArrow(_scan(spark.sparkContext.broadcast(held), keys, more, normalize, exclude_self, k, to_arrow_schema(schema), block), schema)
        return parts
    return _block_join(q, b, query_id, keys, k, more, normalize, exclude_self, schema, block)


def _scan(held, keys: list[str], more: int, normalize: bool, exclude_self: bool, k: int, arrow: pa.Schema, block: int | None):
    width = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            groups: dict[tuple, list[int]] = {}
            if width:
                for i, key in enumerate(zip(*(batch.column(c).to_pylist() for c in range(width)))):
                    groups.setdefault(key, []).append(i)
            elif batch.num_rows:
                groups[()] = list(range(batch.num_rows))
            for key, mine in groups.items():
                if key not in held.value:
                    continue
                bank, ids = held.value[key]
                step = query_block(len(bank), block)
                for at in range(0, len(mine), step):
                    part = batch.take(pa.array(mine[at : at + step]))
                    x = _matrix(part.column(width + 1))
                    yield _answer(part.columns[: width + 1], _unit(x) if normalize else x, bank, ids, more, exclude_self, k, arrow)

    return run


def _answer(head: list[pa.Array], x: np.ndarray, bank: np.ndarray, ids: np.ndarray, more: int, exclude_self: bool, k: int, arrow: pa.Schema) -> pa.RecordBatch:
    d, near = nearest(x, bank, ids, more)
    r = np.repeat(np.arange(len(x)), d.shape[1])
    d, near = d.ravel(), near.ravel()
    if exclude_self:
        keep = head[-1].to_numpy(zero_copy_only=False)[r] != near
        r, d, near = r[keep], d[keep], near[keep]
    rank = np.arange(len(r)) - np.searchsorted(r, r) + 1
    keep = rank <= k
    take = pa.array(r[keep])
    return pa.RecordBatch.from_arrays([*(c.take(take) for c in head), pa.array(near[keep], pa.int64()), pa.array(d[keep]), pa.array(rank[keep].astype(np.int32))], schema=arrow)


def _block_join(q: DataFrame, b: DataFrame, query_id: str, keys: list[str], k: int, more: int, normalize: bool, exclude_self: bool, schema: T.StructType, block: int | None) -> DataFrame:
    arrow = to_arrow_schema(schema)
    width = len(keys)
    # each key has as many blocks as its own rows need. A query goes to each block of its key's bank, and queries are cut
    # into blocks too, so each task gets one block of either
    need = F.ceil(F.count("*") / BLOCK_ROWS).cast("int")
    by_key = keys or [F.lit(0).alias("_all")]
    nb, nq = b.groupBy(*by_key).agg(need.alias("_nb")), q.groupBy(*by_key).agg(need.alias("_nq"))
    sizes = nb.join(nq, keys or ["_all"]).select(*keys, "_nb", "_nq")
    with_sizes = lambda df: df.join(sizes, keys) if keys else df.crossJoin(F.broadcast(sizes))  # one row
    many = with_sizes(q).withColumn("_block", F.explode(F.sequence(F.lit(0), F.col("_nb") - 1))).withColumn("_salt", F.pmod(F.xxhash64(query_id), "_nq").cast("int")).drop("_nb", "_nq")
    blocks = with_sizes(b).withColumn("_block", F.pmod(F.xxhash64("_b"), "_nb").cast("int")).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_nq") - 1))).drop("_nb", "_nq")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return arrow.empty_table()
        right = right.sort_by("_b")
        x, y = (_matrix(t.column("_v").combine_chunks()) for t in (left, right))
        if normalize:
            x, y = _unit(x), _unit(y)
        head = [left.column(c).combine_chunks() for c in [*keys, query_id]]
        ids = right.column("_b").to_numpy()
        out, step = [], query_block(len(y), block)
        for at in range(0, len(x), step):
            out.append(_answer([h.slice(at, step) for h in head], x[at : at + step], y, ids, more, exclude_self, k, arrow))
        return pa.Table.from_batches(out, schema=arrow)

    blocks = blocks.select(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(keys)], F.col("_block").alias("_bb"), F.col("_salt").alias("_bs"), "_b", "_v")
    theirs = blocks.groupBy(*[f"_g{i}" for i in range(len(keys))], "_bb", "_bs")
    some = many.groupBy(*keys, "_block", "_salt").cogroup(theirs).applyInArrow(run, schema)
    best = F.row_number().over(Window.partitionBy(*keys, query_id).orderBy("distance", "neighbour"))
    return some.withColumn("rank", best).where(F.col("rank") <= k).select(*keys, query_id, "neighbour", "distance", "rank")


def anomaly_scores(neighbours: DataFrame, keys: list[str], query_id: str, dim: int) -> DataFrame:
    """(keys, query_id, score): the mean distance of the neighbours, over the vectors' length."""
    return neighbours.groupBy(*keys, query_id).agg((F.avg("distance") / dim).alias("score"))


