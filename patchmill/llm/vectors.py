"""The most similar vectors of every vector, by an inverted multi-index.

Each collection (a tuple of key columns) has two codebooks, one for either half of a vector, trained by k-means on a
bounded sample. A vector's cell is the pair of its nearest centroids, so K + K centroids give K * K cells. A query
visits cells in the order of a sum of two parts, one for either half: a heap holds, for each first centroid, its next
second centroid, and the least head is taken each time. The entries of the visited cells are reranked by their exact
distance.

With max_distance the parts are the squared distances of the query's halves to the border planes of the centroids'
regions, and the traversal ends where their sum exceeds max_distance squared. No vector of a cell beyond can be near
enough, so the result is exact.

Without it the parts are the squared distances of the halves to the centroids, and the traversal ends after a number of
cells that hold vectors. That number is measured for each collection: PROBES of its vectors are compared with all
vectors of the collection, and it is the least with which the visited cells hold `recall` of their k nearest. A recall
of 1 visits every cell and is exact.

Distribution: one pass counts every cell and finds the probes' true neighbours. By these full counts cells are packed
into shards of about `shard` entries, neighbouring cells together; a cell that is itself larger than a shard is split by
a hash of the id, and its queries go to each part. A vector is sent once as an entry, and as a query also to each other
shard that holds one of its cells. A shard that would get very many queries comes in several copies, and each query goes
to one of them. Of a group of more than MAX_COPIES equal vectors only the k + 1 lowest ids are entries: any query that is
near to one of the others is as near to k of these with lower ids. The others' own neighbours are the k lowest ids of
their group.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from patchmill.llm.beside import MODEL_BYTES, Step, beside, numbered
from patchmill.runtime import bounded_batches, written

SAMPLE = 2048
PROBES = 64
MAX_COPIES = 64
RECALL = 0.95
#: A shard gets at most about so many queries for each of its entries.
QUERIES = 4


def usable(vector: str | Column, dim: int) -> Column:
    """True where the vector has exactly dim finite values that are not all zero."""
    v = F.col(vector) if isinstance(vector, str) else vector
    inf = F.lit(float("inf"))
    finite = (F.size(F.array_compact(v)) == dim) & (F.size(v) == dim) & (F.array_max(v) < inf) & (F.array_min(v) > -inf)
    return F.coalesce(v.isNotNull() & finite & ((F.array_max(v) != 0) | (F.array_min(v) != 0)), F.lit(False))


def kmeans(x: np.ndarray, k: int, seed: int, rounds: int = 6) -> np.ndarray:
    """k centroids; the first are rows of x by chance, so dense places get more of them."""
    rng = np.random.default_rng(seed)
    c = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        at = (0.5 * (c * c).sum(1) - x @ c.T).argmin(1)
        n = np.bincount(at, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, at, x)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c).astype(np.float32)
    return c


class Index:
    """Codebooks, and once plan() was called the shards, of one collection."""

    def __init__(self, sample: np.ndarray, n: int, seed: int, ids: np.ndarray | None = None, asked: float = 1.0):
        h = sample.shape[1] // 2
        self.half, self.n, self.asked = h, n, asked
        self.k = k = int(min(256, len(sample), max(1, 2 ** round(np.log2(max(1.0, n / 8)) / 2))))
        fit = sample[PROBES:] if len(sample) > 8 * PROBES else sample  # probes that fitted the codebooks would do better than others
        self.books = [kmeans(fit[:, :h], k, seed), kmeans(fit[:, h:], k, seed + 1)]
        for i, c in enumerate(self.books):  # near centroids get near numbers
            if len(c) > 1:
                axis = np.linalg.svd(c - c.mean(0), full_matrices=False)[2][0]
                self.books[i] = c[np.argsort(c @ axis, kind="stable")]
        self.probe = sample[:PROBES]
        self.probe_ids = np.arange(len(self.probe)) if ids is None else ids[:PROBES]
        self.cells = k * k
        self.count = self.split = self.shard = self.copies = None
        self._gaps()

    def _gaps(self) -> None:
        self.between = [np.sqrt(np.maximum(((c[:, None] - c[None]) ** 2).sum(-1), 1e-12)).astype(np.float32) for c in self.books]
        self.longest = sum(float((c * c).sum(1).max()) for c in self.books)

    def __getstate__(self) -> dict:
        state = {k: v for k, v in self.__dict__.items() if k not in ("between", "longest")}
        if self.count is not None:  # only what is not 0 or 1
            full, large = np.flatnonzero(self.count), np.flatnonzero(self.split > 1)
            state |= {"count": (full, self.count[full]), "split": (large, self.split[large]), "shard": self.shard[full]}
        return state

    def __setstate__(self, state: dict) -> None:
        self.__dict__ = state
        self._gaps()
        if self.count is not None:
            full, n = self.count
            large, parts = self.split
            self.count, self.split, shard = np.zeros(self.k**2, np.int64), np.ones(self.k**2, np.int32), self.shard
            self.count[full], self.split[large], self.shard = n, parts, np.zeros(self.k**2, np.int32)
            self.shard[full] = shard

    def distances(self, x: np.ndarray) -> list[np.ndarray]:
        out = []
        for c, v in zip(self.books, (x[:, : self.half], x[:, self.half :])):
            out.append(np.maximum((v * v).sum(1)[:, None] + (c * c).sum(1) - 2 * (v @ c.T), 0))
        return out

    def cell(self, x: np.ndarray) -> np.ndarray:
        d1, d2 = self.distances(x)
        return (d1.argmin(1) * self.k + d2.argmin(1)).astype(np.int32)

    def plan(self, count: np.ndarray, shard: int, k: int, recall: float, max_distance: float | None, near: np.ndarray, near_of: np.ndarray, sample: np.ndarray, cells: int | None = None) -> None:
        """Shards from the number of entries of every cell; the cells to visit from those that hold the probes' neighbours.

        near and near_of: the cell of each neighbour of a probe, and which probe; sample: vectors that stand for the queries.
        """
        self.count = count
        large = count > shard
        self.split = np.where(large, -(-count // shard), 1).astype(np.int32)
        small = np.cumsum(np.where(large, 0, count)) // shard  # at most 2 * shard each
        parts = np.where(large, self.split, 0)
        # a large cell gets shards of its own, numbered after all others
        self.shard = np.where(large, small.max() + 1 + np.cumsum(parts) - parts, small).astype(np.int32)
        self.cells = int((count > 0).sum()) if cells is None else cells
        if max_distance is None and cells is None and recall < 1:
            d1, d2 = self.distances(self.probe)
            total = (d1[:, :, None] + d2[:, None]).reshape(len(d1), -1)[:, count > 0]
            at = d1[near_of, near // self.k] + d2[near_of, near % self.k]
            before = np.concatenate([(total[p] < a[:, None]).sum(1) for p, a in ((p, at[near_of == p]) for p in np.unique(near_of))]) if len(near) else np.zeros(0)
            need = np.sort(before)[max(0, int(np.ceil(recall * len(before))) - 1)] + 1 if len(before) else 1
            self.cells = int(min(self.cells, max(need, 16)))
        # queries by shard, from the sample
        seen = self.visit(sample, max_distance)[1]
        shards = int((self.shard + self.split).max())
        named = np.bincount(self.shard[seen], minlength=shards)
        for cell in np.flatnonzero(large):  # its queries go to each of its shards
            named[self.shard[cell] : self.shard[cell] + self.split[cell]] = (seen == cell).sum()
        self.copies = np.maximum(1, np.ceil(named * (self.n * self.asked / len(sample)) / (QUERIES * shard))).astype(np.int32)
        self.probe = self.probe_ids = None

    def visit(self, x: np.ndarray, max_distance: float | None) -> tuple[np.ndarray, np.ndarray]:
        """(query, cell) of the cells with entries that each query visits."""
        parts, limit = self.distances(x), np.float32(np.inf)
        if max_distance is not None:
            limit = np.float32((max_distance + 1e-3) ** 2)
            slack = np.float32(1e-5) * (self.longest + (x * x).sum(1))[:, None]  # rounding of distances
            for i, (d, gap) in enumerate(zip(parts, self.between)):
                home = d.argmin(1)[:, None]
                far = np.maximum(d - np.take_along_axis(d, home, 1) - slack, 0) / (2 * gap[home[:, 0]])
                np.put_along_axis(far, home, 0, 1)
                parts[i] = far * far
        most = self.k * self.k if max_distance is not None else self.cells
        return traverse(*parts, self.count > 0, most, limit)


def traverse(d1: np.ndarray, d2: np.ndarray, full: np.ndarray, most: int, limit: float) -> tuple[np.ndarray, np.ndarray]:
    """(query, cell): per query the up to most cells with entries of the least sums of d1 and d2, none over limit.

    All queries are moved in step. For each the heap holds the next cell of each first centroid whose turn has come.
    """
    b, k = d1.shape
    o1, o2 = (np.argsort(d, axis=1, kind="stable") for d in (d1, d2))
    s1, s2 = np.take_along_axis(d1, o1, 1), np.take_along_axis(d2, o2, 1)
    width = max(1, int((s1 <= limit).sum(1).max(initial=0)))
    s1, s2 = s1[:, :width], np.concatenate([s2, np.full((b, 1), np.inf, s2.dtype)], axis=1)
    heads, turn = s1 + s2[:, :1], np.zeros((b, width), np.int32)
    who, left = np.arange(b), np.full(b, most)
    live = np.ones(b, bool)
    query, cell = [], []
    t = 0
    while len(who):
        t += 1
        row = np.arange(len(who))
        r = heads[:, : min(width, t)].argmin(1)  # a first centroid's turn comes only after all nearer ones had theirs
        j = turn[row, r]
        live &= (heads[row, r] <= limit) & (j < k) & (left > 0)
        at = o1[row, r] * k + o2[row, np.minimum(j, k - 1)]
        hit = live & full[at]
        left -= hit
        query.append(who[hit])
        cell.append(at[hit])
        turn[row, r] = j + 1
        heads[row, r] = s1[row, r] + s2[row, np.minimum(j + 1, k)]
        if 4 * live.sum() <= 3 * len(who):
            who, left, o1, o2, s1, s2, heads, turn = (v[live] for v in (who, left, o1, o2, s1, s2, heads, turn))
            live = np.ones(len(who), bool)
    none = [np.zeros(0, np.int64)]
    return np.concatenate(query or none), np.concatenate(cell or none).astype(np.int32)


def _part(ids: np.ndarray, parts: np.ndarray) -> np.ndarray:
    """Which of parts an id belongs to, by a hash."""
    h = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(33)) % parts.astype(np.uint64)).astype(np.int32)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False)
    return np.ascontiguousarray(values.reshape(-1, dim), dtype=np.float32)


def _search(cells: list[np.ndarray], queries: np.ndarray, query_ids: np.ndarray, entries: np.ndarray, ids: np.ndarray, cell: np.ndarray, k: int, max_distance: float | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, neighbour id, distance): of each query the k nearest of the entries in its cells."""
    order = np.argsort(cell, kind="stable")
    entries, ids, cell = entries[order], ids[order], cell[order]
    name, begin = np.unique(cell, return_index=True)
    end = np.append(begin[1:], len(cell))
    q = np.repeat(np.arange(len(cells)), [len(c) for c in cells])
    want = np.concatenate(cells) if len(cells) else np.zeros(0, np.int32)
    order = np.argsort(want, kind="stable")
    q, want = q[order], want[order]
    lo, hi = np.searchsorted(want, name, "left"), np.searchsorted(want, name, "right")
    size = (entries * entries).sum(1)
    own = (queries * queries).sum(1)
    slack = np.float32(1e-5) * (1 + size.max(initial=0) + own.max(initial=0))
    bound = np.full(len(queries), np.inf if max_distance is None else max_distance**2, np.float32) + slack
    got_q, got_e = [], []
    for i in np.flatnonzero(lo < hi):
        a, b = begin[i], end[i]
        step = max(1, (1 << 21) // (b - a))
        for at in range(lo[i], hi[i], step):
            mine = q[at : min(at + step, hi[i])]
            d = own[mine][:, None] + size[a:b] - 2 * (queries[mine] @ entries[a:b].T)
            if b - a > k + 1:  # the query itself may be among the entries
                bound[mine] = np.minimum(bound[mine], np.partition(d, k, axis=1)[:, k] + 2 * slack)
            r, c = np.nonzero(d <= bound[mine][:, None])
            got_q.append(mine[r])
            got_e.append(a + c)
    none = np.zeros(0, np.int64)
    rq, re = (np.concatenate(v) if v else none for v in (got_q, got_e))
    keep = query_ids[rq] != ids[re]
    rq, re = rq[keep], re[keep]
    dist = np.empty(len(rq))
    for at in range(0, len(rq), 1 << 16):
        s = slice(at, at + (1 << 16))
        dist[s] = np.sqrt(((queries[rq[s]].astype(float) - entries[re[s]]) ** 2).sum(1))
    if max_distance is not None:
        keep = dist <= max_distance
        rq, re, dist = rq[keep], re[keep], dist[keep]
    order = np.lexsort((ids[re], dist, rq))
    rq, re, dist = rq[order], re[order], dist[order]
    place = np.arange(len(rq)) - np.searchsorted(rq, rq)
    keep = place < k
    return rq[keep], ids[re[keep]], dist[keep]


_COUNTED = T.StructType([T.StructField(n, t) for n, t in (("_c", T.LongType()), ("_probe", T.IntegerType()), ("_cell", T.IntegerType()), ("_id", T.LongType()), ("_d", T.DoubleType()), ("_n", T.LongType()))])
_SENT = T.StructType([T.StructField(n, t) for n, t in (("_c", T.LongType()), ("_shard", T.IntegerType()), ("_copy", T.IntegerType()), ("_id", T.LongType()), ("_v", T.ArrayType(T.FloatType())), ("_cell", T.IntegerType()), ("_visits", T.ArrayType(T.IntegerType())))])
_FOUND = T.StructType([T.StructField(n, t) for n, t in (("_c", T.LongType()), ("id", T.LongType()), ("neighbour", T.LongType()), ("distance", T.DoubleType()))])


class _Count(Step):
    """Entries of each cell, as rows with probe -1, and the nearest vectors of the probes in this task."""

    def __init__(self, width: int, dim: int, k: int, probes: bool):
        self.width, self.dim, self.k, self.probes = width, dim, k, probes
        self.open: dict[int, tuple] = {}

    def feed(self, number: int, model: Index, rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids = rows.column(self.width).to_numpy(zero_copy_only=False)
        x = _matrix(rows.column(self.width + 1), self.dim)
        if number not in self.open:
            if len(self.open) >= 64:
                yield from self.finish()
            self.open[number] = np.zeros(model.k**2, np.int64), {}
        count, best = self.open[number]
        cell = np.concatenate([model.cell(x[i : i + 8192]) for i in range(0, len(x), 8192)])
        np.add.at(count, cell, 1)
        if self.probes:
            p = model.probe
            d = np.maximum((p * p).sum(1)[:, None] + (x * x).sum(1) - 2 * (p @ x.T), 0)
            d[model.probe_ids[:, None] == ids] = np.inf
            take = np.argpartition(d, self.k - 1, axis=1)[:, : self.k] if len(x) > self.k else np.tile(np.arange(len(x)), (len(p), 1))
            for i, t in enumerate(take):
                mine = [*best.get(i, ()), *zip(d[i, t].tolist(), ids[t].tolist(), cell[t].tolist())]
                best[i] = sorted(set(m for m in mine if m[0] < np.inf))[: self.k]

    def finish(self) -> Iterator[pa.RecordBatch]:
        for number, (count, best) in self.open.items():
            full = np.flatnonzero(count)
            near = [(i, c, v, d) for i, ms in best.items() for d, v, c in ms]
            n = len(full) + len(near)
            probe, cell = [-1] * len(full) + [m[0] for m in near], [*full.tolist(), *(m[1] for m in near)]
            ids, d, times = [None] * len(full) + [m[2] for m in near], [None] * len(full) + [m[3] for m in near], [*count[full].tolist(), *[0] * len(near)]
            yield pa.RecordBatch.from_arrays([pa.array(v, t.type) for v, t in zip(([number] * n, probe, cell, ids, d, times), to_arrow_schema(_COUNTED))], names=_COUNTED.names)
        self.open = {}


class _Assign(Step):
    """A row for each shard that a vector goes to, as an entry (cell is not -1), as a query (visits is not empty) or both."""

    def __init__(self, width: int, dim: int, max_distance: float | None, asks: bool):
        self.width, self.dim, self.max_distance, self.asks = width, dim, max_distance, asks

    def feed(self, number: int, model: Index, rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        step = max(64, min(2048, (1 << 19) // model.cells)) if self.max_distance is None else 2048
        for at in range(0, rows.num_rows, step):
            part = rows.slice(at, step)
            ids = part.column(self.width).to_numpy(zero_copy_only=False)
            x = _matrix(part.column(self.width + 1), self.dim)
            cell = model.cell(x)
            entry_shard = model.shard[cell] + _part(ids, model.split[cell])
            who = np.arange(len(ids)) if self.asks else np.flatnonzero(part.column(self.width + 2).to_numpy(zero_copy_only=False))
            query, seen = model.visit(x[who], self.max_distance)
            query = who[query]
            # split cells count as each of their shards
            n = model.split[seen]
            query, seen, first = np.repeat(query, n), np.repeat(seen, n), np.repeat(np.cumsum(n) - n, n)
            shard = model.shard[seen] + (np.arange(len(seen)) - first).astype(np.int32)
            copy = _part(ids[query], model.copies[shard])
            # an entry goes to every copy of its shard; one that asks nothing there is a row without visits
            n = model.copies[entry_shard]
            entry = np.repeat(np.arange(len(ids)), n)
            copy = np.concatenate([copy, (np.arange(len(entry)) - np.repeat(np.cumsum(n) - n, n)).astype(np.int32)])
            query, shard = np.concatenate([query, entry]), np.concatenate([shard, entry_shard[entry]])
            seen = np.concatenate([seen, np.full(len(entry), -1, np.int32)])
            order = np.lexsort((seen, copy, shard, query))
            query, shard, copy, seen = query[order], shard[order], copy[order], seen[order]
            new = np.flatnonzero(np.concatenate([[True], (np.diff(query) != 0) | (np.diff(shard) != 0) | (np.diff(copy) != 0)]))
            real = seen >= 0
            sizes = np.add.reduceat(real, new)
            visits = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(seen[real].astype(np.int32)))
            q, s, c = query[new], shard[new], copy[new]
            home = np.where(~real[new], cell[q], -1)  # the entry's own row comes first
            vec = pa.FixedSizeListArray.from_arrays(pa.array(x[q].ravel()), self.dim).cast(pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(q), number, np.int64)), pa.array(s.astype(np.int32)), pa.array(c.astype(np.int32)), pa.array(ids[q]), vec, pa.array(home.astype(np.int32)), visits], names=_SENT.names)


def similar(vectors: DataFrame, keys: list[str], *, vec_id: str, vector: str, dim: int, k: int = 5, max_distance: float | None = None, recall: float = RECALL, cells: int | None = None, shard: int = 50_000, sample: int = SAMPLE, queries: Callable[[Column], Column] | None = None, seed: int = 7, model_bytes: int = MODEL_BYTES) -> DataFrame:
    """(keys, id, neighbour, distance): of every usable vector the k nearest others of its collection.

    Equal distances are settled by the lower id. With max_distance only neighbours within it count. queries turns the id
    column into a condition; where given, only the ids that meet it are searched for, against all vectors.

    A vector is usable with exactly dim finite values, not all zero, and a non-null id and keys; others give no row.
    Repeated rows count once. An id that comes with several vectors in a collection is searched by each and is near by
    the nearest of them. A collection of one vector gives no row. Other columns, of whatever names, are ignored.

    With max_distance the result is exact. Without it a query visits as many cells as hold `recall` of the k nearest of
    up to PROBES vectors of its collection, which are compared with all others; recall=1 visits all cells, which is
    exact too. cells sets their number instead.

    The codebooks are fitted on about `sample` vectors of a collection, chosen by a hash of the id; all are indexed.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    rows = vectors.where(usable(vector, dim)).select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keys)], F.col(vec_id).cast("long").alias("_id"), F.col(vector).cast("array<float>").alias("_v")).dropna(subset=[*(f"_k{i}" for i in range(len(keys))), "_id"])
    own, width = [f"_k{i}" for i in range(len(keys))], len(keys)
    named = vectors.select(*[F.col(c).alias(o) for c, o in zip(keys, own)]).schema.fields

    # equal vectors, and the size of each collection
    copies = written(rows.groupBy(*own, F.xxhash64("_v").alias("_h")).agg(F.count("*").alias("n")))
    sizes = copies.groupBy(*own).agg(F.sum(F.when(F.col("n") > MAX_COPIES, k + 1).otherwise(F.col("n"))).alias("_n"))
    hot = copies.where(F.col("n") > MAX_COPIES).drop("n")
    surplus = None
    if not hot.isEmpty():
        ids = rows.select(*own, F.xxhash64("_v").alias("_h"), "_v", "_id").join(hot, [*own, "_h"]).groupBy(*own, "_v", "_id").agg(F.lit(1))
        of = Window.partitionBy(*own, "_v")  # by the values themselves, as hashes may be equal by chance
        reps = written(ids.withColumn("r", F.row_number().over(of.orderBy("_id"))).where(F.col("r") <= k + 1).select(*own, "_v", "_id", "r"))
        others = ids.join(reps.select(*own, "_v", "_id"), [*own, "_v", "_id"], "left_anti").select(*own, "_v", "_id")
        asked = others if queries is None else others.where(queries(F.col("_id")))
        surplus = asked.join(reps.where(F.col("r") <= k).select(*own, "_v", F.col("_id").alias("neighbour")), [*own, "_v"])
        surplus = surplus.select(*own, F.col("_id").alias("id"), "neighbour", F.lit(0.0).alias("distance"))
        rows = rows.join(others, [*own, "_v", "_id"], "left_anti").select(*own, "_id", "_v")
    asks = queries is None
    if not asks:
        rows = rows.withColumn("_ask", F.coalesce(queries(F.col("_id")), F.lit(False)))

    # codebooks from a sample: the share of ids whose hash is low enough
    low = F.pmod(F.xxhash64("_id", F.lit(seed)), F.lit(1 << 30)) < F.lit(sample << 30) / F.col("_n")
    some = rows.join(sizes, own).where(low)
    codes = T.StructType([*named, T.StructField("_n", T.LongType()), T.StructField("_m", T.BinaryType()), T.StructField("_sample", T.BinaryType())])

    def train(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(pdf["_v"].to_numpy()).astype(np.float32)
        ids = pdf["_id"].to_numpy()
        order = np.lexsort((ids, _part(ids, np.full(len(ids), 1 << 30))))  # by a hash, so that the first are any ones
        n, asked = int(pdf["_n"].iat[0]), 1.0 if asks else float(pdf["_ask"].mean())
        return pd.DataFrame([[*key, n, pickle.dumps(Index(x[order], n, seed, ids[order], asked)), x.tobytes()]], columns=codes.names)

    models = written(numbered(some.groupBy(*own).applyInPandas(train, codes)))

    # the shards by full counts
    probes = max_distance is None and cells is None and recall < 1
    counted = beside(rows.select(*own, "_id", "_v"), models, own, lambda: _Count(width, dim, k, probes), _COUNTED, model_bytes)
    counted = counted.groupBy("_c", "_probe", "_cell", "_id").agg(F.min("_d").alias("_d"), F.sum("_n").alias("_times"))
    counted = written(counted.withColumn("_r", F.row_number().over(Window.partitionBy("_c", "_probe", F.when(F.col("_probe") < 0, F.col("_cell"))).orderBy("_d", "_id"))).where(F.col("_r") <= k).drop("_r"))

    def plan(pdf: pd.DataFrame, model: pd.DataFrame) -> pd.DataFrame:
        out = model.drop(columns="_sample")
        for m, x in zip(model["_m"], model["_sample"]):
            index = pickle.loads(m)
            count = np.zeros(index.k**2, np.int64)
            own_cells, near = pdf[pdf["_probe"] < 0], pdf[pdf["_probe"] >= 0]
            count[own_cells["_cell"].to_numpy()] = own_cells["_times"].to_numpy()
            index.plan(count, shard, k, recall, max_distance, near["_cell"].to_numpy(), near["_probe"].to_numpy(), np.frombuffer(x, np.float32).reshape(-1, dim), cells)
            out["_m"] = [pickle.dumps(index)]
        return out

    # a collection has at most 65,536 cells and PROBES * k neighbours
    planned = written(counted.groupBy("_c").cogroup(models.groupBy("_c")).applyInPandas(plan, models.drop("_sample").schema))
    sent = beside(rows, planned, own, lambda: _Assign(width, dim, max_distance, asks), _SENT, model_bytes)

    def shard_search(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        col = {n: (t.column(n).chunk(0) if t.column(n).num_chunks else t.column(n)) for n in t.column_names}
        ids = col["_id"].to_numpy(zero_copy_only=False)
        x = _matrix(col["_v"], dim)
        cell = col["_cell"].to_numpy(zero_copy_only=False)
        # repeated rows once
        once = np.unique(np.concatenate([ids[:, None].view(np.uint8).reshape(len(ids), -1), x.view(np.uint8).reshape(len(ids), -1)], axis=1).view(f"V{8 + 4 * dim}").ravel(), return_index=True)[1]
        entry = once[cell[once] >= 0]
        offsets = col["_visits"].offsets.to_numpy()
        values = col["_visits"].values.to_numpy(zero_copy_only=False)
        ask = once[offsets[once + 1] > offsets[once]]
        visits = [values[offsets[i] : offsets[i + 1]] for i in ask]
        q, nearest, dist = _search(visits, x[ask], ids[ask], x[entry], ids[entry], cell[entry], k, max_distance)
        return pa.Table.from_arrays([pa.array(np.full(len(q), col["_c"][0].as_py(), np.int64)), pa.array(ids[ask][q], pa.int64()), pa.array(nearest, pa.int64()), pa.array(dist, pa.float64())], schema=found)

    found = to_arrow_schema(_FOUND)
    out = sent.groupBy("_c", "_shard", "_copy").applyInArrow(shard_search, _FOUND).join(models.select("_c", *own), "_c").select(*own, "id", "neighbour", "distance")
    if surplus is not None:
        out = out.unionByName(surplus)
    best = F.row_number().over(Window.partitionBy(*own, "id").orderBy("distance", "neighbour"))
    out = out.groupBy(*own, "id", "neighbour").agg(F.min("distance").alias("distance")).withColumn("_r", best).where(F.col("_r") <= k).drop("_r")
    return out.toDF(*keys, "id", "neighbour", "distance")


def similar_pairs(neighbours: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, id_a, id_b), smaller id first: pairs of which at least one is among the other's neighbours."""
    return neighbours.select(*keys, F.least("id", "neighbour").alias("id_a"), F.greatest("id", "neighbour").alias("id_b")).distinct()
