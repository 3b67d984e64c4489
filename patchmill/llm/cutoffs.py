"""Score cutoffs that keep a target share of each source, by a cutting-plane search for an order statistic.

Of n scores the cutoff is the r-th highest, r = ceil(share * n). It minimises the convex pinball loss

    f(c) = r' * sum(c - s, s < c) + ... = (slope right of c is n_below_or_at(c) - (n - r), left of it n_below(c) - (n - r))

Each round is one aggregation over the scores: per source and trial cutoff the counts and sums on its lower side and the
nearest scores on either side, combined before the shuffle. The two lines that touch the loss at the ends of the
bracket meet at the next trial cutoff. That point alone can creep where scores are heavy-tailed, so seven points that cut
the bracket evenly on the line of doubles' ranks are tried beside it: some 22 rounds separate any two doubles. Trial points snap to
scores that occur, and a source is done when no score lies between the best kept cutoff and the lowest too high one. The
last SNAP scores of a bracket are ranked at once instead of being separated round by round.

Scores outside a source's bracket are counted once and then left out: whenever less than a quarter of the rows is left
inside, these are written anew, so all rounds together read little more than the first. Only the brackets, one row for
each source, reach the driver, and of more than SOURCES sources only as many at a time.
"""

from __future__ import annotations

import struct

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from patchmill.runtime import written

SOURCES = 100_000
#: A bracket with so few scores left is settled by ranking them.
SNAP = 256
#: Fewer rows are not worth writing anew.
REWRITE = 1_000_000


def _rank(x: float) -> int:
    """Place of a double on the line of all doubles."""
    i = struct.unpack("<q", struct.pack("<d", x))[0]
    return i if i >= 0 else -(i & 0x7FFFFFFFFFFFFFFF)


def _double(rank: int) -> float:
    return struct.unpack("<d", struct.pack("<Q", rank if rank >= 0 else (-rank) | (1 << 63)))[0]


class _Source:
    """The bracket of one source: lo occurs and keeps enough; every score of hi or more is too few."""

    def __init__(self, row, need: int):
        self.n, self.need, self.total = row.n, need, row.total
        self.lo, self.lo_below, self.lo_sum = row.low, 0, 0.0  # scores below lo, and their sum
        self.top = row.high
        self.hi, self.hi_below, self.hi_sum = None, row.n, row.total
        self.best_below_hi = row.high

    @property
    def inside(self) -> int:
        """Scores from lo to best_below_hi."""
        return self.hi_below - self.lo_below

    @property
    def done(self) -> bool:
        return self.best_below_hi <= self.lo

    def _loss(self, c: float, below: int, total: float) -> tuple[float, float]:
        """Pinball loss at c, but for a constant, and its slope there."""
        k = self.n - self.need
        return below * c - total - k * c, below - k

    def trials(self) -> list[float]:
        lo, hi = self.lo, self.best_below_hi  # the answer lies in this closed range
        a, b = _rank(lo), _rank(hi)
        out = {hi, *(_double(a + -(-(b - a) * i // 8)) for i in range(1, 8))}
        f0, s0 = self._loss(lo, self.lo_below, self.lo_sum)
        f1, s1 = self._loss(hi if self.hi is None else self.hi, self.hi_below, self.hi_sum)
        end = hi if self.hi is None else self.hi
        if s1 > s0:
            meet = (f1 - f0 + s0 * lo - s1 * end) / (s0 - s1)
            if lo < meet <= hi:
                out.add(meet)
        return sorted(c for c in out if lo < c <= hi)

    def settle(self, cutoff: float, kept: int) -> None:
        self.lo, self.best_below_hi, self.lo_below = cutoff, cutoff, self.n - kept

    def learn(self, c: float, below: int, total: float, least_above: float | None, most_below: float | None) -> None:
        """below and total: of the scores under c; least_above: the least score >= c."""
        if self.n - below >= self.need:
            if least_above > self.lo:
                self.lo, self.lo_below, self.lo_sum = least_above, below, total
        elif self.hi is None or c < self.hi:
            self.hi, self.hi_below, self.hi_sum, self.best_below_hi = c, below, total, most_below


def cutoffs(scores: DataFrame, targets: DataFrame, keys: list[str], *, score: str = "score", permille: str = "keep_permille", count: str | None = None) -> DataFrame:
    """keys and permille, n, cutoff, n_kept: per source the highest score that keeps at least permille/1000 of it, or,
    where targets has its column count, at least that many scores.

    The source is the tuple of keys; sources without a target, or whose target is null or has no finite score, give no
    row. A source named twice in targets takes its highest share. Null, NaN and infinite scores do not count; shares of
    0 or less keep the highest score's ties, those over 1000 keep all. Negative zero equals zero. Ties are kept whole.
    Each row of scores counts once: remove repeated rows before. There may be any number of sources, of any size.
    """
    names = targets.select(*keys).distinct()
    blocks = -(-names.count() // SOURCES)
    at = F.pmod(F.xxhash64(*keys), F.lit(max(1, blocks)))
    found = None
    for i in range(max(1, blocks)):
        some = _cutoffs(scores, targets if blocks <= 1 else targets.where(at == i), keys, score, permille, count)
        found = some if found is None else found.unionByName(some)
    return found


def _cutoffs(scores: DataFrame, targets: DataFrame, keys: list[str], score: str, permille: str, count: str | None) -> DataFrame:
    spark = scores.sparkSession
    permille, whole = (permille, 1000) if count is None else (count, 0)
    named = targets.where(F.col(permille).isNotNull()).groupBy(*keys).agg(F.max(permille).cast("long").alias("_permille"))
    usable = scores.select(*keys, (F.col(score).cast("double") + 0.0).alias("_score")).where("_score is not null and not isnan(_score) and abs(_score) < double('infinity')")
    rows = written(usable.join(named, keys, "left_semi"))
    start = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min("_score").alias("low"), F.max("_score").alias("high"), F.sum("_score").alias("total")).join(named, keys)
    bracket: dict[tuple, _Source] = {}
    for r in start.collect():  # at most SOURCES rows
        bracket[tuple(r[k] for k in keys)] = _Source(r, min(r.n, max(1, -(-r["_permille"] * r.n // whole) if whole else r["_permille"])))
    schema = T.StructType([scores.schema[k] for k in keys])
    asked = T.StructType([*schema.fields, T.StructField("_lo", T.DoubleType()), T.StructField("_hi", T.DoubleType()), T.StructField("_above", T.LongType()), T.StructField("_need", T.LongType()), T.StructField("_cuts", T.ArrayType(T.DoubleType()))])
    held = sum(s.n for s in bracket.values())
    while open_ := [k for k, s in bracket.items() if not s.done]:
        asks = [(*k, s.lo, s.best_below_hi, s.n - s.hi_below, s.need, s.trials() if s.inside > SNAP else []) for k, s in ((k, bracket[k]) for k in open_)]
        ask = F.broadcast(spark.createDataFrame(asks, asked))  # at most SOURCES rows
        left = sum(bracket[k].inside for k in open_)
        inside = rows.join(ask, keys).where("_score between _lo and _hi")
        if 4 * left < held and held > REWRITE:
            rows, held = written(inside.select(*keys, "_score")), left
            inside = rows.join(ask, keys)
        each = inside.select(*keys, "_score", F.explode("_cuts").alias("_cut"))
        below = F.col("_score") < F.col("_cut")
        told = each.groupBy(*keys, "_cut").agg(F.count_if(below).alias("below"), F.sum(F.when(below, F.col("_score")).otherwise(0.0)).alias("total"), F.min(F.when(~below, F.col("_score"))).alias("above"), F.max(F.when(below, F.col("_score"))).alias("under"))
        ranks = Window.partitionBy(*keys).orderBy(F.desc("_score")).rangeBetween(Window.unboundedPreceding, 0)  # at most SNAP rows
        snapped = inside.where(F.size("_cuts") == 0).withColumn("_kept", F.count("*").over(ranks) + F.col("_above")).where("_kept >= _need")
        snapped = snapped.groupBy(*keys).agg(F.lit(None).cast("double").alias("_cut"), F.min("_kept").alias("below"), F.lit(0.0).alias("total"), F.max("_score").alias("above"), F.lit(None).cast("double").alias("under"))
        base = {k: (bracket[k].lo_below, bracket[k].lo_sum) for k in open_}
        for r in told.unionByName(snapped).collect():
            k = tuple(r[c] for c in keys)
            if r["_cut"] is None:
                bracket[k].settle(r.above, r.below)
            else:
                bracket[k].learn(r["_cut"], base[k][0] + r.below, base[k][1] + r.total, r.above, r.under)
    result = T.StructType([*schema.fields, T.StructField("n", T.LongType()), T.StructField("cutoff", T.DoubleType()), T.StructField("n_kept", T.LongType())])
    found = spark.createDataFrame([(*k, s.n, s.lo, s.n - s.lo_below) for k, s in bracket.items()], result)
    return found.join(named, keys).select(*keys, F.col("_permille").cast(targets.schema[permille].dataType).alias(permille), "n", "cutoff", "n_kept")


def kept(scores: DataFrame, cuts: DataFrame, keys: list[str], *, score: str = "score") -> DataFrame:
    """The rows of scores at or above their source's cutoff."""
    cut = cuts.select(*keys, F.col("cutoff").alias("_cutoff"))
    value = F.col(score)
    return scores.join(cut, keys).where(value.isNotNull() & ~F.isnan(value) & (F.abs(value) < F.lit(float("inf"))) & (value >= F.col("_cutoff"))).drop("_cutoff")


def latest_scores(scores: DataFrame, samples: DataFrame) -> DataFrame:
    """(category, label, sample_id, score): of each sample the finite score with the latest scored_at.

    Equal times are settled by the later arrival, then the higher score. Samples without label or category, or without a
    finite score, and scores of unknown samples give no row. A sample delivered again counts once, by its latest
    arrival. category comes in lower case without outer blanks.
    """
    finite = scores.where("sample_id is not null and score is not null and not isnan(score) and abs(score) < double('infinity')")
    last = finite.groupBy("sample_id").agg(F.max(F.struct("scored_at", "arrived_at", "score")).getField("score").alias("score"))
    known = samples.where("sample_id is not null").groupBy("sample_id").agg(F.max(F.struct("arrived_at", F.lower(F.trim("category")).alias("category"), "label")).alias("s"))
    known = known.select("sample_id", "s.category", "s.label").where("category is not null and label is not null")
    return last.join(known, "sample_id").select("category", "label", "sample_id", "score")
