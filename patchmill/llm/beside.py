"""Rows next to the model of their group, such as a codebook or pivots, wherever the models are too many to broadcast."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Models of up to this size together are broadcast. Larger ones are shuffled to their rows.
MODEL_BYTES = 32 << 20
#: Rows of a group that one task meets with its model.
GROUP = 1 << 16


class Step:
    """What is done to the rows of a task: feed() gets the rows of one group after another, finish() what is left to say."""

    def feed(self, number: int, model: object, rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        raise NotImplementedError

    def finish(self) -> Iterator[pa.RecordBatch]:
        return iter(())


def groups(batch: pa.RecordBatch, width: int) -> Iterator[tuple[tuple, np.ndarray]]:
    """(values, rows) of the groups by the first width columns of a batch."""
    code, columns = np.zeros(batch.num_rows, np.int64), []
    for i in range(width):
        d = batch.column(i).dictionary_encode(null_encoding="encode")
        index = d.indices.to_numpy(zero_copy_only=False)
        columns.append((d.dictionary.to_pylist(), index))
        code = np.unique(code * max(1, len(d.dictionary)) + index, return_inverse=True)[1]
    order = np.argsort(code, kind="stable")
    ends = np.cumsum(np.bincount(code)) if len(code) else []
    begin = 0
    for end in ends:
        at = order[begin:end]
        yield tuple(values[index[at[0]]] for values, index in columns), at
        begin = end


def beside(rows: DataFrame, models: DataFrame, keys: list[str], step: Callable[[], Step], schema: T.StructType, most_bytes: int = MODEL_BYTES, others: bool = False) -> DataFrame:
    """The rows that step gives for rows whose first columns are keys and whose next column is an id.

    models is a written table of keys, _c (a number), _n (the group's rows) and _m (the pickled model), a row for each
    group. Rows of a group without a model are left out, or with others given to step under the number -1 and None, if
    such groups are known to be small.
    """
    spark, width = rows.sparkSession, len(keys)
    arrow = to_arrow_schema(schema)
    total = models.agg(F.sum(F.length("_m"))).first()[0] or 0
    if total <= most_bytes:
        held = {tuple(r[k] for k in keys): (r["_c"], bytes(r["_m"])) for r in models.select(*keys, "_c", "_m").collect()}
        shared = spark.sparkContext.broadcast(held)  # at most most_bytes

        def narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            loaded: dict[tuple, tuple] = {}
            s = step()
            for batch in batches:
                for key, at in groups(batch, width):
                    if key not in shared.value:
                        if others:
                            yield from s.feed(-1, None, batch.take(pa.array(at)))
                        continue
                    if key not in loaded:
                        c, m = shared.value[key]
                        loaded[key] = c, pickle.loads(m)
                    yield from s.feed(*loaded[key], batch.take(pa.array(at)))
            yield from s.finish()

        return rows.mapInArrow(narrow, schema)

    parts = F.ceil(F.col("_n") / GROUP)
    sized = rows.join(models.select(*keys, parts.alias("_parts")), keys, "left" if others else "inner")
    dealt = sized.select(*rows.columns, F.pmod(F.xxhash64(rows.columns[width], F.lit(21)), F.coalesce("_parts", F.lit(1))).alias("_salt"))
    copies = models.select(*keys, "_c", "_m", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("_salt"))

    def wide(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[pa.RecordBatch] = []
        if left.num_rows and (right.num_rows or others):
            s, c, m = step(), -1, None
            if right.num_rows:
                c, m = right.column("_c")[0].as_py(), pickle.loads(right.column("_m")[0].as_py())
            for batch in left.drop_columns(["_salt"]).to_batches(max_chunksize=1 << 14):
                out += s.feed(c, m, batch)
            out += s.finish()
        return pa.Table.from_batches([b.cast(arrow) for b in out], schema=arrow)

    by = [*keys, "_salt"]
    return dealt.groupBy(*by).cogroup(copies.groupBy(*by)).applyInArrow(wide, schema)


def numbered(models: DataFrame) -> DataFrame:
    """models with their number _c; to be written at once, as the numbers follow the layout."""
    return models.withColumn("_c", F.monotonically_increasing_id())
