"""Long exact spans that stand verbatim in more than one record.

Two steps. The first names pairs of texts that may share a span and loses none; the second finds the spans of a pair by
fixed-block anchors.

1. Every window of `block` characters of every text is hashed by a rolling hash, and of each `least - block + 1` windows
   in a row the one with the least hash is kept. Two texts that share a run of `least` characters share the windows in
   it and so keep the same one: joining the kept hashes names every pair. About two in `least - block` windows leave
   the map task.
2. The non-overlapping blocks of one text of the pair are indexed, every rolling window of the other probes them, and
   each hit is compared character by character and extended to the maximal exact repeat; then the same the other way
   round.

Fixed blocks alone would need every rolling window of the corpus, eight bytes a character, to be shuffled to the index,
or the index, which grows with the corpus, to be broadcast. The first step is there to avoid that.

Texts that are equal as a whole form one class. Only a class's representative, its lowest id, is searched.

Texts that keep a window in common are compared in one task: each distinct set of texts is a group, cut into cells of
CELL characters a side, and every text is sent once to each cell that has a pair of it. A window that more than HOT texts
hold would name all their pairs, mostly for nothing. Around it every run of exactly `least` characters is taken instead,
and texts with an equal run are known to share a span without being compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patchmill.runtime import bounded_batches, written

LEAST = 400
SEGMENT = 1 << 18
#: Windows that more texts than this hold are looked at more closely before their texts are paired.
HOT = 64
#: Characters of the texts on either side of a cell, and texts on either side of a block of pairs of one run.
CELL = 1 << 22
SIDE = 512
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _texts(column: pa.Array) -> list[str]:
    try:
        return column.to_pylist()
    except UnicodeDecodeError:  # a string that is not UTF-8: each stray byte counts as one character
        return [t.decode("utf-8", "surrogateescape") for t in column.cast(pa.binary()).to_pylist()]


def _least_of(h: np.ndarray, width: int) -> np.ndarray:
    """The least of each width values in a row."""
    span = 1
    while 2 * span <= width:
        h = np.minimum(h[:-span], h[span:])
        span *= 2
    rest = width - span
    return np.minimum(h[:-rest], h[rest:]) if rest else h


class Roller:
    """Rolling hashes; keeps the tables that all texts of a task share."""

    _made: dict = {}

    @classmethod
    def of(cls, block: int, least: int) -> Roller:
        """One for all groups of this process."""
        if (block, least) not in cls._made:
            cls._made[block, least] = cls(block, least)
        return cls._made[block, least]

    def __init__(self, block: int, least: int):
        self.block, self.width = block, least - block + 1
        self.char = _mix(np.arange(1, 65537, dtype=np.uint64) * _BASE)
        powers = np.full(SEGMENT + 4 * least, _BASE, np.uint64)
        powers[0] = 1
        self.powers = np.multiply.accumulate(powers)
        self.down = self.powers[::-1].copy()

    def windows(self, codes: np.ndarray) -> np.ndarray:
        """Hash of each window of block characters of up to SEGMENT + 4 least characters."""
        n, b = len(codes), self.block
        c = self.char[codes] if codes.max() < 65536 else _mix((codes.astype(np.uint64) + np.uint64(1)) * _BASE)
        c = c * self.powers[:n]
        np.add.accumulate(c, out=c)
        h = c[b - 1 :].copy()
        h[1:] -= c[: n - b]
        h *= self.down[: len(h)]
        return _mix(h)

    def all_windows(self, codes: np.ndarray) -> np.ndarray:
        """windows() of a text of any length."""
        if len(codes) < self.block:
            return np.zeros(0, np.uint64)
        step = SEGMENT - self.block + 1
        parts = [self.windows(codes[i : i + SEGMENT]) for i in range(0, len(codes) - self.block + 1, step)]
        # powers count down from the segment's begin, so equal windows have equal hashes in any segment
        return np.concatenate(parts)

    def batch(self, texts: list[str]) -> Iterator[tuple[int, np.ndarray]]:
        """(row, kept hashes) of texts. Long texts are taken in segments that overlap by a shared run less one."""
        least = self.block + self.width - 1
        pending: list[tuple[int, np.ndarray]] = []
        size = 0

        def flush() -> Iterator[tuple[int, np.ndarray]]:
            ends = np.cumsum([len(c) for _, c in pending])
            m = _least_of(self.windows(np.concatenate([c for _, c in pending])), self.width)
            new = np.concatenate([[True], m[1:] != m[:-1]])
            for e in ends[:-1]:  # runs of windows that lie in two texts
                new[max(0, e - least + 1) : e] = False
                if e < len(m):
                    new[e] = True
            at = np.flatnonzero(new)
            of = np.searchsorted(ends, at, side="right")
            cut = np.searchsorted(of, np.arange(len(pending) + 1))
            for i, (row, _) in enumerate(pending):
                yield row, m[at[cut[i] : cut[i + 1]]]

        for row, text in enumerate(texts):
            if len(text) < least:
                continue
            codes = _codes(text)
            for shift in range(0, len(codes) - least + 1, SEGMENT - least + 1):
                part = codes[shift : shift + SEGMENT]
                if size + len(part) > SEGMENT + 2 * least and pending:
                    yield from flush()
                    pending, size = [], 0
                pending.append((row, part))
                size += len(part)
        if pending:
            yield from flush()


def _fingerprints(docs: DataFrame, doc_id: str, text: str, least: int, block: int) -> DataFrame:
    """(d, x, y, n, k): a row for each record with two hashes and the length of its text, and its kept hashes."""
    rows = docs.select(F.col(doc_id).cast("long").alias("d"), F.xxhash64(text).alias("x"), F.crc32(text).alias("y"), F.col(text).alias("t")).where("d is not null and t is not null").where(F.length("t") >= least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roller = Roller(block, least)
        for batch in batches:
            texts = _texts(batch.column(3))
            found: list[list] = [[np.zeros(0, np.uint64)] for _ in texts]
            for row, k in roller.batch(texts):
                found[row].append(k)
            kept = [np.unique(np.concatenate(v)).view(np.int64) for v in found]
            keys = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, kept)]).astype(np.int32)), pa.array(np.concatenate(kept)))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array(np.array([len(t) for t in texts], np.int64)), keys], names=list("dxynk"))

    return rows.mapInArrow(run, "d long, x long, y long, n long, k array<long>")


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """Number of equal characters at the beginning."""
    n = min(len(a), len(b))
    step, done = 256, 0
    while done < n:
        differ = np.flatnonzero(a[done : done + step][: n - done] != b[done : done + step][: n - done])
        if len(differ):
            return done + int(differ[0])
        done += step
        step *= 2
    return n


def repeats(a: np.ndarray, b: np.ndarray, ha: np.ndarray, hb: np.ndarray, least: int, block: int) -> list[tuple[int, int, int]]:
    """(start in a, start in b, length) of maximal repeats: a's fixed blocks, probed by all windows of b.

    A window that lies in a repeat found before is not probed again, so texts that repeat within themselves give repeats
    that cover all shared characters of b, not each of their alignments.
    """
    anchors = ha[::block]
    order = np.argsort(anchors, kind="stable")
    anchors = anchors[order]
    lo, hi = np.searchsorted(anchors, hb, side="left"), np.searchsorted(anchors, hb, side="right")
    out, seen, until = [], {}, 0
    for at in np.flatnonzero(lo < hi):
        if at + block <= until:
            continue
        for i in order[lo[at] : hi[at]] * block:
            if at + block <= until or at < seen.get(i - at, 0) or not np.array_equal(a[i : i + block], b[at : at + block]):
                continue
            left, right = _common(a[:i][::-1], b[:at][::-1]), _common(a[i:], b[at:])
            seen[i - at] = at + right
            if left + right >= least:
                out.append((int(i - left), int(at - left), int(left + right)))
                until = max(until, at + right)
    return out


def shared(a: np.ndarray, b: np.ndarray, ha: np.ndarray, hb: np.ndarray, least: int, block: int) -> set[tuple[int, int, int]]:
    """repeats() either way round."""
    return {*repeats(a, b, ha, hb, least, block), *((i, j, n) for j, i, n in repeats(b, a, hb, ha, least, block))}


def _pairs(rows: DataFrame, key: str) -> DataFrame:
    """(a, b), a < b, of the texts d with an equal key, once. The texts of a key are cut into blocks of about SIDE, and
    each pair of blocks is a key of its own, so that no task makes all pairs of a common key."""
    blocks = rows.groupBy(key).agg(F.ceil(F.count("*") / SIDE).cast("int").alias("_m")).where(F.col("_m") > 1)
    at = rows.select(key, "d").join(blocks, key, "left").select(key, "d", F.coalesce("_m", F.lit(1)).alias("_m")).withColumn("_i", F.pmod(F.xxhash64("d"), "_m").cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("_m") - 1))
    left = at.select(key, F.col("d").alias("a"), "_i", other.alias("_j"))
    right = at.select(key, F.col("d").alias("b"), F.col("_i").alias("_j"), other.alias("_i"))
    return left.join(right, [key, "_i", "_j"]).where("a < b").select("a", "b").distinct()


class Spans:
    """The search over one table. Its parts are written to the shared folder once and used by all results."""

    def __init__(self, docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", least: int = LEAST, block: int | None = None):
        """A record's id must be unique among different texts; repeated rows count once. Null ids and texts and texts
        shorter than least take no part. Other columns are ignored. block is the anchors' length, by default half of
        least. Texts are searched whole: a long one is hashed in overlapping segments."""
        if least < 2:
            raise ValueError("least must be 2 or more")
        bounded_batches(docs.sparkSession)
        self.least, self.block = least, block or least // 2
        self._found: tuple | None = None
        self._again: bool | None = None
        self.texts = docs.select(F.col(doc_id).cast("long").alias("d"), F.col(text).alias("t"))
        self.prints = written(_fingerprints(docs, doc_id, text, least, self.block))
        ids = self.prints.select("d", "x", "y", "n")
        reps = ids.groupBy("x", "y", "n").agg(F.min("d").alias("rep"), F.max("d").alias("last"))
        self.classes = ids.join(reps.where("rep < last"), ["x", "y", "n"]).select("d", "rep").distinct()

    def _windows(self) -> tuple[DataFrame, DataFrame | None]:
        """(d, k, n) of windows that two or more representatives keep and at most HOT, and _hot_runs() of the others."""
        if self._found is None:
            copies = self.classes.where("d <> rep").select("d")
            own = self.prints.select("d", "k").dropDuplicates(["d"]).join(copies, "d", "left_anti")
            each = own.select("d", F.explode("k").alias("k"))
            two = each.groupBy("k").agg(F.min("d").alias("a"), F.max("d").alias("b"), F.count("*").alias("n")).where("a < b").select("k", "n")
            at = written(each.join(two, "k"))
            hot = at.where(F.col("n") > HOT).groupBy("d").agg(F.collect_list("k").alias("ks"))
            self._found = at.where(F.col("n") <= HOT), None if hot.isEmpty() else self._hot_runs(hot)
        return self._found

    def _hot_runs(self, hot: DataFrame) -> DataFrame:
        """(d, h, p): hash and place of each run of least characters over a window (in ks) that very many texts hold."""
        least, block = self.least, self.block
        rows = self.texts.join(hot, "d").where(F.length("t") >= least).dropDuplicates(["d"]).select("d", "t", "ks")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            short, long = Roller(block, least), Roller(least, least)
            for batch in batches:
                for d, t, ks in zip(batch.column(0).to_pylist(), _texts(batch.column(1)), batch.column(2).to_pylist()):
                    codes = _codes(t)
                    at = np.flatnonzero(np.isin(short.all_windows(codes), np.array(ks, np.int64).view(np.uint64)))
                    whole = long.all_windows(codes)
                    edge = np.zeros(len(whole) + 1, np.int64)  # runs that begin up to least - block before a window
                    np.add.at(edge, np.clip(at - (least - block), 0, len(whole)), 1)
                    np.add.at(edge, np.minimum(at + 1, len(whole)), -1)
                    p = np.flatnonzero(np.cumsum(edge)[:-1] > 0)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(p), d, np.int64)), pa.array(whole[p].view(np.int64)), pa.array(p)], names=["d", "h", "p"])

        return written(rows.mapInArrow(run, "d long, h long, p long"))

    def _hot_groups(self) -> DataFrame | None:
        """(d, h): the texts that hold an equal run over a very common window, one run for each set of texts. The texts of
        an h hold the same characters: the run itself is part of the comparison, not only its hash."""
        runs = self._windows()[1]
        if runs is None:
            return None
        each = runs.groupBy("d", "h").agg(F.min("p").alias("p"))
        group = each.groupBy("h").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("d")).alias("s1"), F.bit_xor(F.xxhash64("d", F.lit(1))).alias("s2")).where("n > 1")
        one = group.groupBy("n", "s1", "s2").agg(F.min("h").alias("h")).select("h")
        of = each.join(one, "h").groupBy("d").agg(F.collect_list(F.struct("h", "p")).alias("hs"))
        rows = self.texts.join(of, "d").where(F.length("t") >= self.least).dropDuplicates(["d"]).select("d", "t", "hs")
        least = self.least

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for d, t, hs in zip(batch.column(0).to_pylist(), _texts(batch.column(1)), batch.column(2).to_pylist()):
                    yield pa.RecordBatch.from_arrays([pa.array([d] * len(hs), pa.int64()), pa.array([x["h"] for x in hs], pa.int64()), pa.array([t[x["p"] : x["p"] + least].encode("utf-8", "surrogatepass") for x in hs], pa.binary())], names=["d", "h", "r"])

        return rows.mapInArrow(cut, "d long, h long, r binary").select("d", F.struct("h", "r").alias("h"))

    def _cells(self, windows: DataFrame) -> DataFrame:
        """(g, i, j, a, b): pairs of texts that keep a common window, a < b, each once, with the cell that compares them."""
        sizes = self.prints.select("d", "n").dropDuplicates(["d"])
        sets = windows.select("k", "d").join(sizes, "d").groupBy("k").agg(F.array_sort(F.collect_list(F.struct("d", "n"))).alias("v"))  # at most HOT
        sets = sets.groupBy("v").agg(F.min("k").alias("g"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for v, g in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    d = np.array([x["d"] for x in v], np.int64)
                    cell = np.cumsum([x["n"] for x in v]) // CELL
                    i, j = np.triu_indices(len(d), 1)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), g, np.int64)), pa.array(cell[i].astype(np.int32)), pa.array(cell[j].astype(np.int32)), pa.array(d[i]), pa.array(d[j])], names=list("gijab"))

        pairs = sets.select("v", "g").mapInArrow(run, "g long, i int, j int, a long, b long")
        return pairs.groupBy("a", "b").agg(F.min(F.struct("g", "i", "j")).alias("c")).select("c.g", "c.i", "c.j", "a", "b")

    def _compared(self, cells: DataFrame) -> DataFrame:
        """(doc_id_a, start_a, doc_id_b, start_b, length): the maximal exact repeats of the pairs of each cell."""
        cells = written(cells)
        needed = cells.select(F.col("g").alias("tg"), F.col("i").alias("ti"), F.col("j").alias("tj"), F.explode(F.array("a", "b")).alias("d")).distinct()
        texts = self.texts.where(F.length("t") >= self.least).dropDuplicates(["d"]) if self._repeated() else self.texts.where(F.length("t") >= self.least)
        texts = needed.join(texts, "d").select("tg", "ti", "tj", "d", "t")
        least, block = self.least, self.block
        names = ["doc_id_a", "start_a", "doc_id_b", "start_b", "length"]
        arrow = pa.schema([(n, pa.int64()) for n in names])

        def run(pairs: pa.Table, texts: pa.Table) -> pa.Table:
            roller, codes = Roller.of(block, least), {}
            for chunk in texts.select(["d", "t"]).to_batches():
                for d, t in zip(chunk.column(0).to_pylist(), _texts(chunk.column(1))):
                    codes[d] = _codes(t)
            known: dict[int, np.ndarray] = {}
            rows, size = [], 0
            for a, b in sorted(zip(pairs.column("a").to_pylist(), pairs.column("b").to_pylist())):
                for d in (a, b):
                    if d not in known:
                        if size > 16 * SEGMENT:
                            known, size = {k: known[k] for k in (a, b) if k in known}, 0
                        known[d] = roller.all_windows(codes[d])
                        size += len(codes[d])
                rows += [(a, i, b, j, n) for i, j, n in shared(codes[a], codes[b], known[a], known[b], least, block)]
            return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], schema=arrow) if rows else arrow.empty_table()

        return cells.groupBy("g", "i", "j").cogroup(texts.groupBy("tg", "ti", "tj")).applyInArrow(run, ", ".join(f"{n} long" for n in names))

    def _repeated(self) -> bool:
        """Whether any record comes more than once."""
        if self._again is None:
            self._again = not self.prints.groupBy("d").count().where("count > 1").isEmpty()
        return self._again

    def spans(self) -> DataFrame:
        """(doc_id_a, start_a, doc_id_b, start_b, length): the maximal exact repeats between representatives."""
        windows, _ = self._windows()
        cells, hot = self._cells(windows), self._hot_groups()
        if hot is not None:
            # pairs of a common run by blocks: the cell of a pair is the pair of its texts' hashes
            at = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << 20)).cast("int")
            more = _pairs(hot, "h").join(cells.select("a", "b"), ["a", "b"], "left_anti")
            cells = cells.unionByName(more.select(F.xxhash64(F.floor(at("a") / 64), F.floor(at("b") / 64)).alias("g"), F.lit(-1).alias("i"), F.lit(-1).alias("j"), "a", "b"))
        return self._compared(cells)

    def representative_pairs(self) -> DataFrame:
        """(a, b): pairs of representatives, a < b, that share a span."""
        windows, _ = self._windows()
        found = self._compared(self._cells(windows)).select(F.col("doc_id_a").alias("a"), F.col("doc_id_b").alias("b"))
        hot = self._hot_groups()
        return (found if hot is None else found.unionByName(_pairs(hot, "h"))).distinct()

    def links(self) -> DataFrame:
        """(doc_id, rep, links): of each record that shares a span, its class of equal texts and how many other records it
        shares one with."""
        size = self.classes.groupBy("rep").agg(F.count("*").alias("m")).select(F.col("rep").alias("r"), "m")
        both = self.representative_pairs()
        both = both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).join(size, F.col("b") == F.col("r"), "left").groupBy("a").agg(F.sum(F.coalesce("m", F.lit(1))).alias("n"))
        ids = self.prints.select("d").distinct().join(self.classes, "d", "left").withColumn("rep", F.coalesce("rep", "d"))
        out = ids.join(both, ids.rep == both.a, "left").join(size, ids.rep == F.col("r"), "left")
        return out.select(F.col("d").alias("doc_id"), "rep", (F.coalesce("n", F.lit(0)) + F.coalesce("m", F.lit(1)) - 1).alias("links")).where("links > 0")

    def members(self) -> DataFrame:
        """(doc_id, rep) of the records in a class of two or more equal texts."""
        return self.classes.select(F.col("d").alias("doc_id"), "rep")

    def pairs(self) -> DataFrame:
        """(doc_id_a, doc_id_b), smaller id first: all pairs of records that share a span, equal texts included."""
        reps = self.representative_pairs().toDF("doc_id_a", "doc_id_b")
        of = self.classes.select(F.col("rep"), F.col("d"))
        a = reps.join(of.withColumnRenamed("d", "a"), reps.doc_id_a == of.rep, "left").select(F.coalesce("a", "doc_id_a").alias("a"), "doc_id_b")
        b = a.join(of.withColumnRenamed("d", "b"), a.doc_id_b == of.rep, "left").select("a", F.coalesce("b", "doc_id_b").alias("b"))
        equal = _pairs(of, "rep")
        return b.unionByName(equal).select(F.least("a", "b").alias("doc_id_a"), F.greatest("a", "b").alias("doc_id_b")).distinct()

    def shares(self) -> DataFrame:
        """(doc_id, n_chars, shared_chars, shared_share) of each record with a span that stands elsewhere too.

        Where very many texts share a run no pairs are made: it is enough that a run of least characters is not alone."""
        windows, runs = self._windows()
        s = self._compared(self._cells(windows))
        both = s.select(F.col("doc_id_a").alias("d"), F.col("start_a").alias("s"), "length").unionByName(s.select(F.col("doc_id_b").alias("d"), F.col("start_b").alias("s"), "length"))
        if runs is not None:
            known = runs.groupBy("h").agg(F.min("d").alias("a"), F.max("d").alias("b")).where("a < b").select("h")
            both = both.unionByName(runs.join(known, "h", "left_semi").select("d", F.col("p").alias("s"), F.lit(self.least).cast("long").alias("length")))
        ends = both.distinct().groupBy("d").agg(F.array_sort(F.collect_list(F.struct("s", (F.col("s") + F.col("length")).alias("e")))).alias("v"))
        # length of the union of the spans, in order of their starts
        first = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("e"))
        union = F.aggregate("v", first, lambda z, x: F.struct((z["n"] + F.greatest(F.lit(0).cast("long"), x["e"] - F.greatest(z["e"], x["s"]))).alias("n"), F.greatest(z["e"], x["e"]).alias("e")), lambda z: z["n"])
        reps = ends.select("d", union.alias("shared"))
        ids = self.prints.select("d", "n").distinct()
        of = ids.join(self.classes, "d", "left")
        out = of.join(reps.withColumnRenamed("d", "r"), F.coalesce("rep", "d") == F.col("r"), "left").where("rep is not null or shared is not null")
        shared = F.when(F.col("rep").isNotNull(), F.col("n")).otherwise(F.col("shared"))
        return out.select(F.col("d").alias("doc_id"), F.col("n").alias("n_chars"), shared.alias("shared_chars"), (shared / F.col("n")).alias("shared_share"))
