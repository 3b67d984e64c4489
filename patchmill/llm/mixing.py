"""Records of several sources mixed so that each gives its target share of all tokens.

1. The records' tokens are counted with a public tokenizer and laid end to end, per source, in an order by hash. Each
   source's stream is cut into blocks of `block` tokens (the last one is shorter); a block is a list of pieces of records.
2. The mix has as many slots as the scarcest source allows: share * slots is at most max_repeats times its blocks. The
   slots lie in output shards, and each shard draws its sources' counts from the multinomial of the target shares.
3. The slots of a source are numbered across all shards. Slot u of a source with N blocks is use u div N, and a
   pseudorandom permutation of 0..N-1, another one for each use, turns u mod N into a block. So no block is used twice
   before all are used once. Where chance drew a source more often than max_repeats allows, the slots beyond go, in
   order, to the sources that have room, by their shares: every slot is filled and no limit is passed.
4. Slots and blocks are joined by source and block number.

Numbers across the rows of a source come from sums over buckets and then within each bucket, so no task handles a whole
source. Everything follows from the seed; a lost task that runs again gives the same rows.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from patchmill.runtime import bounded_batches, written

BLOCK = 1024
SHARD = 1024
BUCKET = 50_000
#: How texts are split before the merges of a byte-level rank file.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


_loaded: dict = {}  # encoders of this process


class RankTokenizer:
    """Encoder of texts by a file of byte-level ranks, which every executor finds under the same path.

    Special tokens' strings are ordinary text.
    """

    def __init__(self, file: str, pattern: str = PATTERN):
        self.key = file, pattern

    def __call__(self, texts: list[str]) -> list[list[int]]:
        if self.key not in _loaded:
            import tiktoken

            with open(self.key[0], "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
            _loaded[self.key] = tiktoken.Encoding("ranks", pat_str=self.key[1], mergeable_ranks=ranks, special_tokens={})
        return [_loaded[self.key].encode_ordinary(t) for t in texts]


def even_source(name: str):
    """A source's name in lower case with single underscores for hyphens and blanks."""
    return F.regexp_replace(F.lower(F.trim(name)), r"[-\s_]+", "_")


def token_counts(docs: DataFrame, tokenizer: Callable, *, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(d, s, n): tokens of each record with an id, a source and a text of at least one token; repeated ids once.

    Of an id that comes with several texts or sources the one with most tokens holds."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("long").alias("d"), even_source(source).alias("s"), F.col(text).alias("t")).where("d is not null and s is not null and t <> ''")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [len(t) for t in tokenizer(batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64())], names=["d", "s", "n"])

    counted = rows.mapInArrow(run, "d long, s string, n long").where("n > 0")
    return counted.groupBy("d").agg(F.max(F.struct("n", "s")).alias("x")).select("d", "x.s", "x.n")


def _running(df: DataFrame, key: str, bucket: str, order: list[str], value: str, name: str) -> DataFrame:
    """df with the sum of value over the rows before, by key, in the order of bucket and then of order."""
    before = Window.partitionBy(key).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    sums = df.groupBy(key, bucket).agg(F.sum(value).alias("_v")).withColumn("_base", F.coalesce(F.sum("_v").over(before), F.lit(0))).drop("_v")
    within = Window.partitionBy(key, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("_in", F.coalesce(F.sum(value).over(within), F.lit(0))).join(sums, [key, bucket]).withColumn(name, F.col("_base") + F.col("_in")).drop("_base", "_in")


def permute(x: np.ndarray, n: int, seed: int) -> np.ndarray:
    """Where a pseudorandom permutation of 0..n-1 puts each x: four Feistel rounds, repeated while the result is n or more."""
    half = max(1, (max(1, n - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    out = x.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        v = out[todo]
        left, right = v >> np.uint64(half), v & mask
        for r in range(4):
            h = (right + np.uint64((seed * 4 + r) * 0x9E3779B97F4A7C15 % (1 << 64))) * np.uint64(0xBF58476D1CE4E5B9)
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
            left, right = right, left ^ ((h ^ (h >> np.uint64(32))) & mask)
        out[todo] = (left << np.uint64(half)) | right
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


class Mix:
    """One mix. The token counts and the plan are made once, when the mix is made."""

    def __init__(self, docs: DataFrame, targets: DataFrame, tokenizer: Callable, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", share: str = "target_share", repeats: str = "max_repeats", block: int = BLOCK, shard: int = SHARD, seed: int = 17):
        """Sources are compared with case, hyphens and blanks evened out. Targets that are null, not above 0 or whose
        source has no token are left out and the other shares scaled to 1. A source named twice gets the sum of its
        shares and the lower limit. Records without id, source, text or target take no part; of repeated ids one counts.
        """
        self.spark, self.block, self.shard, self.seed = docs.sparkSession, block, shard, seed
        self.docs, self.names, self.tokenizer = docs, (doc_id, text), tokenizer
        aim = targets.select(even_source(source).alias("s"), F.col(share).cast("double").alias("p"), F.col(repeats).cast("long").alias("r")).where("s is not null and p > 0 and r > 0").groupBy("s").agg(F.sum("p").alias("p"), F.min("r").alias("r"))
        self.aim = aim
        counts = token_counts(docs, tokenizer, doc_id=doc_id, text=text, source=source)
        self.counts = written(counts.join(aim.select("s"), "s", "left_semi"))
        self.have = self.counts.groupBy("s").agg(F.sum("n").alias("tokens"), F.count("*").alias("records"))
        plan = aim.join(self.have, "s").orderBy("s").collect()  # a row for each target, which the caller states
        total = sum(r.p for r in plan)
        self.plan = [(r.s, r.p / total, r.r, -(-r.tokens // block), r.records) for r in plan]
        self.slots = int(min((r * n / p for _, p, r, n, _ in self.plan), default=0))

    @staticmethod
    def _give(over: int, room: np.ndarray, p: np.ndarray) -> np.ndarray:
        """over slots dealt to the sources with room, by their shares."""
        given = np.zeros(len(room), np.int64)
        while over:
            open_ = np.flatnonzero(room > given)
            part = np.minimum(np.ceil(over * p[open_] / p[open_].sum()).astype(np.int64), (room - given)[open_])
            part = np.diff(np.minimum(np.cumsum(np.concatenate([[0], part])), over))
            given[open_] += part
            over -= int(part.sum())
        return given

    def pieces(self) -> DataFrame:
        """(source, block, doc_id, first, last): tokens first to last - 1 of a record are in the block, in order of place."""
        buckets = self.spark.createDataFrame([(s, -(-n // BUCKET)) for s, *_, n in self.plan], "s string, b long")
        rows = self.counts.join(F.broadcast(buckets), "s")  # a row for each target
        rows = rows.withColumn("h", F.xxhash64("d", F.lit(self.seed))).withColumn("bucket", F.pmod("h", "b")).drop("b")
        at = _running(rows, "s", "bucket", ["h", "d"], "n", "start")
        size = F.lit(self.block).cast("long")
        end = F.col("start") + F.col("n")
        each = at.select("s", "d", "start", end.alias("end"), F.explode(F.sequence(F.floor(F.col("start") / size), F.floor((end - 1) / size))).alias("block"))
        first, last = F.greatest(F.col("block") * size, "start"), F.least((F.col("block") + 1) * size, "end")
        return each.select(F.col("s").alias("source"), "block", F.col("d").alias("doc_id"), (first - F.col("start")).alias("first"), (last - F.col("start")).alias("last"), (first - F.col("block") * size).alias("place"))

    def blocks(self) -> DataFrame:
        """(source, block, n_tokens, pieces)."""
        piece = F.struct("place", "doc_id", "first", "last")
        return self.pieces().groupBy("source", "block").agg(F.sum(F.col("last") - F.col("first")).alias("n_tokens"), F.array_sort(F.collect_list(piece)).alias("pieces"))

    def assignments(self) -> DataFrame:
        """(shard, slot, source, block, use): which block each slot of each output shard holds."""
        schema = "shard long, slot int, source string, block long, use long"
        if not self.slots:
            return self.spark.createDataFrame([], schema)
        names, seed, size, slots = [s for s, *_ in self.plan], self.seed, self.shard, self.slots
        p = np.array([p for _, p, *_ in self.plan])
        p = p / p.sum()
        blocks = np.array([n for *_, n, _ in self.plan])
        limit = np.array([r for _, _, r, *_ in self.plan])

        def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for shard in batch.column(0).to_pylist():
                    rng = np.random.default_rng([seed, shard])
                    n = min(size, slots - shard * size)
                    count = rng.multinomial(n, p)
                    places = np.split(rng.permutation(n).astype(np.int32), np.cumsum(count)[:-1])
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(p), shard)), pa.array(np.arange(len(p))), pa.array(count.astype(np.int64)), pa.array([np.sort(x) for x in places], pa.list_(pa.int32()))], names=["shard", "i", "n", "places"])

        drawn = self.spark.range(0, -(-slots // size)).mapInArrow(draw, "shard long, i long, n long, places array<int>").withColumn("bucket", F.floor(F.col("shard") / 4096))
        count = np.zeros(len(p), np.int64)
        for r in drawn.groupBy("i").agg(F.sum("n").alias("n")).collect():  # a row for each source
            count[r.i] = r.n
        cap = limit * blocks
        over = np.maximum(count - cap, 0)
        over_at = np.concatenate([[0], np.cumsum(over)])
        given_at = np.concatenate([[0], np.cumsum(self._give(int(over.sum()), np.maximum(cap - count, 0), p))])
        first = _running(drawn, "i", "bucket", ["shard"], "n", "first")
        each = first.select("shard", "i", "first", F.posexplode("places").alias("j", "slot")).select("shard", "slot", "i", (F.col("first") + F.col("j")).alias("u"))

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                i, u = (batch.column(c).to_numpy().copy() for c in (2, 3))
                far = np.flatnonzero(u >= cap[i])
                o = over_at[i[far]] + u[far] - cap[i[far]]
                i[far] = np.searchsorted(given_at, o, side="right") - 1
                u[far] = count[i[far]] + o - given_at[i[far]]
                use, at = u // blocks[i], u % blocks[i]
                for s, e in np.unique(np.stack([i, use]), axis=1).T if len(i) else ():
                    mine = np.flatnonzero((i == s) & (use == e))
                    at[mine] = permute(at[mine], int(blocks[s]), seed * 1_000_003 + int(s) * 1009 + int(e))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([names[k] for k in i], pa.string()), pa.array(at), pa.array(use)], names=["shard", "slot", "source", "block", "use"])

        return each.mapInArrow(place, schema)

    def mixed(self) -> DataFrame:
        """(shard, slot, source, block, use, n_tokens, pieces): the mix, a row for each slot."""
        # both sides grow with the corpus, so neither may be broadcast
        return self.assignments().join(self.blocks().hint("merge"), ["source", "block"]).select("shard", "slot", "source", "block", "use", "n_tokens", "pieces")

    def shares(self) -> DataFrame:
        """(source, target_share, max_repeats, n_records, n_tokens, used_tokens, share, most_uses): what was reached.

        Every target has a row; one without tokens or room reached 0."""
        blocks = self.pieces().groupBy("source", "block").agg(F.sum(F.col("last") - F.col("first")).alias("n"))
        used = self.assignments().join(blocks.hint("merge"), ["source", "block"]).groupBy("source").agg(F.sum("n").alias("used"), (F.max("use") + 1).alias("most"))
        used = used.withColumn("all", F.sum("used").over(Window.partitionBy(F.lit(0))))  # a row for each target
        rows = self.aim.withColumnRenamed("s", "source").join(self.have.withColumnRenamed("s", "source"), "source", "left").join(used, "source", "left")
        zero = F.lit(0).cast("long")
        return rows.select("source", F.col("p").alias("target_share"), F.col("r").alias("max_repeats"), F.coalesce("records", zero).alias("n_records"), F.coalesce("tokens", zero).alias("n_tokens"), F.coalesce("used", zero).alias("used_tokens"), F.coalesce(F.col("used") / F.col("all"), F.lit(0.0)).alias("share"), F.coalesce("most", zero).alias("most_uses"))

    def record_uses(self) -> DataFrame:
        """(doc_id, source, n_tokens, used_tokens, most_uses): how much of each record the mix holds, unused ones with 0."""
        times = self.assignments().groupBy("source", "block").agg(F.count("*").alias("t"))
        used = self.pieces().join(times.hint("merge"), ["source", "block"], "left").groupBy("doc_id", "source")
        length = F.col("last") - F.col("first")
        zero = F.lit(0).cast("long")
        return used.agg(F.sum(length).alias("n_tokens"), F.sum(length * F.coalesce("t", zero)).alias("used_tokens"), F.max(F.coalesce("t", zero)).alias("most_uses"))

    def token_blocks(self) -> DataFrame:
        """(source, block, tokens): the token ids of every block, once."""
        doc_id, text = self.names
        wanted = self.pieces().groupBy("doc_id").agg(F.any_value("source").alias("s"), F.array_sort(F.collect_list(F.struct("first", "last", "block", "place"))).alias("cuts"))
        rows = self.docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("t")).where("t <> ''").join(wanted, "doc_id")
        rows = rows.groupBy("doc_id").agg(F.max_by(F.struct("s", "cuts", "t"), F.length("t")).alias("x")).select("x.s", "x.cuts", "x.t")
        tokenizer = self.tokenizer

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out: list[tuple] = []
                for s, cuts, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), tokenizer(batch.column(2).to_pylist())):
                    out += [(s, c["block"], c["place"], ids[c["first"] : c["last"]]) for c in cuts]
                if out:
                    s, b, at, ids = zip(*out)
                    yield pa.RecordBatch.from_arrays([pa.array(s), pa.array(b, pa.int64()), pa.array(at, pa.int64()), pa.array(ids, pa.list_(pa.int32()))], names=["source", "block", "place", "ids"])

        cut = rows.mapInArrow(run, "source string, block long, place long, ids array<int>")
        return cut.groupBy("source", "block").agg(F.array_sort(F.collect_list(F.struct("place", "ids"))).alias("v")).select("source", "block", F.flatten(F.transform("v", lambda x: x["ids"])).alias("tokens"))
