"""Percentiles of very large columns by mergeable sketches: randomised compactor hierarchies.

A sketch holds levels of values; a value on level h stands for 2^h values of the column. When a level is full it is
sorted and every other value, from a random first one, moves up a level. Capacities shrink by a third with each level
below the top, so a sketch holds about 3 k values however many it has seen.

Each task sketches its own rows in Arrow batches and sends a few kilobytes for each group; partial sketches are merged
level by level in two steps, so no task gets more than a bounded number of them. Sketches are rows of a DataFrame: those
of separate days can be stored and combined at any time.

Error. A compaction on level h shifts the rank of a value by 2^h up or down, or not at all, with equal chances. A sketch
counts the variance of all its compactions (their 4^h summed). By Hoeffding's bound the rank of an answer is off by more
than sqrt(2 ln(2/delta) variance) with probability delta at most; rank_error is that as a share of n, plus one value's
weight for the step between neighbours.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

K = 1024
FAN_IN = 256
_FIELDS = [T.StructField("measure", T.StringType()), T.StructField("n", T.LongType()), T.StructField("variance", T.DoubleType()), T.StructField("levels", T.ArrayType(T.ArrayType(T.DoubleType())))]


class Sketch:
    """One hierarchy of compactors."""

    def __init__(self, k: int, seed: int, n: int = 0, variance: float = 0.0, levels: list[np.ndarray] | None = None):
        self.k, self.n, self.variance = k, n, variance
        self.levels = levels or [np.zeros(0)]
        self.rng = np.random.default_rng(seed)

    def _room(self, level: int) -> int:
        return max(8, math.ceil(self.k * (2 / 3) ** (len(self.levels) - 1 - level)))

    def _compress(self) -> None:
        while True:
            over = next((h for h, v in enumerate(self.levels) if len(v) > self._room(h)), None)
            if over is None:
                return
            v = np.sort(self.levels[over])
            odd = len(v) % 2
            self.levels[over], v = v[:odd], v[odd:]
            if over + 1 == len(self.levels):
                self.levels.append(np.zeros(0))
            self.levels[over + 1] = np.concatenate([self.levels[over + 1], v[self.rng.integers(2) :: 2]])
            self.variance += 4.0**over

    def add(self, values: np.ndarray) -> None:
        self.n += len(values)
        self.levels[0] = np.concatenate([self.levels[0], values])
        self._compress()

    def merge(self, n: int, variance: float, levels: list[np.ndarray]) -> None:
        self.n += n
        self.variance += variance
        for h, v in enumerate(levels):
            if h == len(self.levels):
                self.levels.append(np.zeros(0))
            self.levels[h] = np.concatenate([self.levels[h], v])
        self._compress()

    def quantiles(self, shares: list[float]) -> np.ndarray:
        """Least held value whose rank reaches each share."""
        v = np.concatenate(self.levels)
        w = np.concatenate([np.full(len(x), 2**h, np.int64) for h, x in enumerate(self.levels)])
        order = np.argsort(v, kind="stable")
        rank = np.cumsum(w[order])
        at = np.searchsorted(rank, np.ceil(np.asarray(shares) * rank[-1]).clip(1))
        return v[order][at]

    def error(self, delta: float) -> float:
        return min(1.0, (math.sqrt(2 * math.log(2 / delta) * self.variance) + (2 ** (len(self.levels) - 1) if self.variance else 0)) / self.n) if self.n else 0.0


def _seed(*parts: object) -> int:
    return zlib.crc32(repr(parts).encode())


def sketch(df: DataFrame, keys: list[str], measures: dict[str, object], *, k: int = K, max_open: int = 2048) -> DataFrame:
    """(keys, measure, n, variance, levels): a sketch for each group and measure.

    measures gives for each name a numeric column (an expression or a name). Null, NaN and infinite values are left out;
    a measure without a usable value in a group gives no row. Null keys form a group of their own. Every row counts, so
    remove repeated rows before if they should count once. Ties are values like any other. Clashing names of other
    columns do not matter, as only keys and measures are read. The random choices are seeded by partition and group, so
    a task that runs again repeats them.
    """
    fields = [df.schema[c] for c in keys]
    out = T.StructType([*fields, *_FIELDS])
    cols = [(F.col(c) if isinstance(c, str) else c).cast("double").alias(f"_m{i}") for i, c in enumerate(measures.values())]
    rows = df.select(*keys, *cols)
    names, width = list(measures), len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        open_: dict[tuple, Sketch] = {}

        def flush() -> pa.RecordBatch:
            ks = [pa.array([g[0][i] for g in open_], type_) for i, type_ in enumerate(types)]
            cols = [pa.array([g[1] for g in open_]), pa.array([s.n for s in open_.values()]), pa.array([s.variance for s in open_.values()]), pa.array([s.levels for s in open_.values()], pa.list_(pa.list_(pa.float64())))]
            return pa.RecordBatch.from_arrays([*ks, *cols], names=[*(f.name for f in fields), "measure", "n", "variance", "levels"])

        types: list = []
        for batch in batches:
            types = [batch.column(i).type for i in range(width)]
            code = np.zeros(batch.num_rows, np.int64)  # numbers the groups of the batch
            columns = []
            for i in range(width):
                d = batch.column(i).dictionary_encode(null_encoding="encode")
                index = d.indices.to_numpy(zero_copy_only=False)
                columns.append((d.dictionary.to_pylist(), index))
                code = np.unique(code * max(1, len(d.dictionary)) + index, return_inverse=True)[1]
            first = np.unique(code, return_index=True)[1]
            groups = [tuple(values[index[f]] for values, index in columns) for f in first]
            for m, name in enumerate(names):
                v = batch.column(width + m).to_numpy(zero_copy_only=False)
                ok = np.flatnonzero(np.isfinite(v.astype(float)))
                order = ok[np.argsort(code[ok], kind="stable")]
                ends = np.searchsorted(code[order], np.arange(len(groups) + 1))
                for g, key in enumerate(groups):
                    if ends[g] < ends[g + 1]:
                        s = open_.get((key, name))
                        if s is None:
                            s = open_[key, name] = Sketch(k, _seed(part, key, name, len(open_)))
                        s.add(v[order[ends[g] : ends[g + 1]]].astype(float))
            if len(open_) > max_open:
                yield flush()
                open_.clear()
        if open_:
            yield flush()

    return merge(rows.mapInArrow(run, out), keys, k=k)


def merge(sketches: DataFrame, keys: list[str], *, k: int = K, few: bool = False) -> DataFrame:
    """Sketches of the same keys combined: keys may be fewer than those the sketches were made by.

    Those of FAN_IN partitions are merged first and the results after that. few says that no group has more sketches than
    one task can merge at once, some thousands, as when days are combined. The result of an empty table is empty.
    """
    out = T.StructType([*(sketches.schema[c] for c in keys), *_FIELDS])
    by = [*keys, "measure"]

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        key = key[: len(by)]
        levels = [[np.asarray(v, float) for v in ls] for ls in pdf["levels"]]
        order = sorted(range(len(pdf)), key=lambda i: (pdf["n"].iat[i], [x for v in levels[i] for x in v[:3]]))
        if len(order) == 1:
            one = pdf.iloc[[0]]
            return pd.DataFrame([[*key, int(one["n"].iat[0]), float(one["variance"].iat[0]), [v.tolist() for v in levels[0]]]], columns=[f.name for f in out])
        s = Sketch(k, _seed(len(pdf), int(pdf["n"].sum())))
        for i in order:  # the same order whatever the shuffle brings first
            s.merge(int(pdf["n"].iat[i]), float(pdf["variance"].iat[i]), levels[i])
        return pd.DataFrame([[*key, s.n, s.variance, [v.tolist() for v in s.levels]]], columns=[f.name for f in out])

    if few:
        return sketches.select(*by, "n", "variance", "levels").groupBy(*by).applyInPandas(run, out)
    rows = sketches.select(*by, "n", "variance", "levels", (F.spark_partition_id() / FAN_IN).cast("int").alias("_part"))
    some = rows.groupBy(*by, "_part").applyInPandas(run, out)
    return some.groupBy(*by).applyInPandas(run, out)


def percentiles(sketches: DataFrame, keys: list[str], shares: list[float], *, delta: float = 0.01) -> DataFrame:
    """(keys, measure, percentile, value, n, rank_error): a row for each sketch and share.

    rank_error bounds, with probability 1 - delta for each answer, by which share of n the value's rank may be off.
    """
    out = T.StructType([*(sketches.schema[c] for c in [*keys, "measure"]), T.StructField("percentile", T.DoubleType()), T.StructField("value", T.DoubleType()), T.StructField("n", T.LongType()), T.StructField("rank_error", T.DoubleType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                s = Sketch(K, 0, r.n, r.variance, [np.asarray(v, float) for v in r.levels])
                rows += [(*r[: len(keys) + 1], 100 * q, v, r.n, s.error(delta)) for q, v in zip(shares, s.quantiles(shares))]
            yield pd.DataFrame(rows, columns=[f.name for f in out])

    return sketches.select(*keys, "measure", "n", "variance", "levels").mapInPandas(run, out)
