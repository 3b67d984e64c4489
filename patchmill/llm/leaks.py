"""Evaluation texts that leak into a corpus, found by training suffix arrays.

Words are runs of ASCII letters, digits and underscores in lower case; everything else, and a backslash with the
character after it, separates words. Each shard of the corpus (an Arrow batch of whole documents) is turned into
word numbers, and the suffixes of its words are sorted into a suffix array. Every suffix of every test item is then
binary-searched in it.

A word that occurs in no item can be part of no match, so the array holds only the stretches of `min_words` or more
words in a row that the items use. That drops no match and makes the array a small fraction of the text.

The items are a stated query set. They reach the tasks in blocks of at most `block_bytes` of text, PASS_BYTES of them in
one narrow pass over the corpus, without a shuffle of text: a task holds a run of documents and lets one block after
another meet it.

Words are compared by 64-bit hashes, never by their characters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patchmill.runtime import bounded_batches

MIN_WORDS = 8
#: Items that meet the corpus in one pass, and how much text a task holds while they do.
PASS_BYTES = 64 << 20
HELD_BYTES = 32 << 20
_WORD = np.zeros(256, bool)
_WORD[np.frombuffer(b"0123456789_ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", np.uint8)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


with np.errstate(over="ignore"):
    _CHAR = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[_LOWER]
_BASE = np.uint64(0x9E3779B97F4A7C15)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, text it stands in) of UTF-8 texts that lie one after another in data."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    word = _WORD[data]
    word[1:] &= data[:-1] != 92
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    word[inner] = _WORD[data[inner]]  # a backslash at the end of the text before does not count
    edge = np.empty(len(data), bool)
    edge[0] = word[0]
    np.greater(word[1:], word[:-1], out=edge[1:])
    edge[inner] = word[inner]
    at = np.flatnonzero(word)
    if not len(at):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    first = np.flatnonzero(edge[at])
    length = np.diff(np.append(first, len(at)))
    place = np.arange(len(at), dtype=np.int64) - np.repeat(first, length)
    powers = np.ones(int(length.max()), np.uint64)
    powers[1:] = _BASE
    powers = np.multiply.accumulate(powers)
    h = np.add.reduceat(_CHAR[data[at]] * powers[place], first)
    return _mix(h), np.searchsorted(offsets, at[first], side="right") - 1


def suffix_array(ids: np.ndarray) -> np.ndarray:
    """Starts of the suffixes of ids in sorted order, by prefix doubling until all ranks differ."""
    n = len(ids)
    rank = np.unique(ids, return_inverse=True)[1].astype(np.int64)
    step = 1
    while True:
        later = np.full(n, -1, np.int64)
        later[: max(0, n - step)] = rank[step:]
        key = rank * np.int64(n + 1) + (later + 1)
        order = np.argsort(key, kind="stable")
        new = np.empty(n, np.int64)
        new[order] = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)])
        if new[order[-1]] == n - 1 or step >= n:
            return order
        rank, step = new, 2 * step


def _windows(ids: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    at = starts[:, None] + np.arange(width)
    return np.where(at < len(ids), ids[np.minimum(at, len(ids) - 1)], -1)


def _bound(keys: np.ndarray, wanted: np.ndarray, right: bool) -> np.ndarray:
    """Binary search of each row of wanted among the sorted rows of keys, all searches in step."""
    lo, hi = np.zeros(len(wanted), np.int64), np.full(len(wanted), len(keys), np.int64)
    while (open_ := np.flatnonzero(lo < hi)).size:
        mid = (lo[open_] + hi[open_]) >> 1
        a, b = keys[mid], wanted[open_]
        differs = a != b
        first = differs.argmax(1)
        row = np.arange(len(open_))
        below = np.where(differs.any(1), a[row, first] < b[row, first], right)
        lo[open_[below]] = mid[below] + 1
        hi[open_[~below]] = mid[~below]
    return lo


class Items:
    """A block of test items as word numbers."""

    def __init__(self, item_ids: list[int], texts: list[str], min_words: int):
        raw = [t.encode("utf-8", "surrogatepass") for t in texts]
        offsets = np.cumsum([0, *map(len, raw)])
        h, of = words(np.frombuffer(b"".join(raw), np.uint8), offsets)
        self.vocabulary, ids = np.unique(h, return_inverse=True)
        self.ids, self.of, self.min_words = ids.astype(np.int32), of, min_words
        self.item_ids = np.asarray(item_ids, np.int64)
        self.size = np.bincount(of, minlength=len(item_ids))
        self.begin = np.concatenate([[0], np.cumsum(self.size)[:-1]])
        starts = np.arange(len(ids))
        self.starts = starts[starts + min_words <= (self.begin + self.size)[of]] if len(ids) else starts
        self.keys, self.key_of = np.unique(_windows(self.ids, self.starts, min_words), axis=0, return_inverse=True) if len(self.starts) else (np.zeros((0, min_words), np.int32), np.zeros(0, np.int64))
        self.key_of = self.key_of.reshape(-1)


def _stretches(h: np.ndarray, of: np.ndarray, items: Items) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers and texts of the stretches that can match, with -1 after each stretch."""
    if not len(items.vocabulary) or not len(h):
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(items.vocabulary, h), len(items.vocabulary) - 1)
    known = items.vocabulary[at] == h
    run = np.flatnonzero(known)
    if not len(run):
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    new = np.concatenate([[True], (np.diff(run) != 1) | (np.diff(of[run]) != 0)])
    length = np.diff(np.append(np.flatnonzero(new), len(run)))
    keep = np.repeat(length >= items.min_words, length)
    run, new = run[keep], new[keep]
    if not len(run):
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    spot = np.flatnonzero(new)
    return np.insert(at[run].astype(np.int32), spot, -1), np.insert(of[run], spot, -1)


def _longest(ids: np.ndarray, sa: np.ndarray, keys: np.ndarray, items: Items, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each test suffix, the length of its longest match in the shard (0: under min_words) and the range of sa that holds all of them."""
    found = np.flatnonzero((hi > lo)[items.key_of]) if len(items.starts) else np.zeros(0, np.int64)
    best, first, last = (np.zeros(len(items.starts), np.int64) for _ in range(3))
    if not len(found):
        return best, first, last
    end = (items.begin + items.size)[items.of[items.starts[found]]]
    # narrow each range word by word until it would be empty: what is left matches longest
    left, right, depth = lo[items.key_of[found]].copy(), hi[items.key_of[found]].copy(), np.full(len(found), items.min_words)
    live = np.arange(len(found))
    while len(live):
        s = items.starts[found[live]] + depth[live]
        live, s = live[s < end[live]], s[s < end[live]]
        if not len(live):
            break
        want, d = items.ids[s], depth[live]
        bounds = []
        for right_side in (False, True):
            a, b = left[live].copy(), right[live].copy()
            while (open_ := np.flatnonzero(a < b)).size:
                mid = (a[open_] + b[open_]) >> 1
                at = sa[mid] + d[open_]
                value = np.where(at < len(ids), ids[np.minimum(at, len(ids) - 1)], -1)
                below = (value <= want[open_]) if right_side else (value < want[open_])
                a[open_[below]] = mid[below] + 1
                b[open_[~below]] = mid[~below]
            bounds.append(a)
        ok = bounds[0] < bounds[1]
        live = live[ok]
        left[live], right[live] = bounds[0][ok], bounds[1][ok]
        depth[live] += 1
    best[found], first[found], last[found] = depth, left, right
    return best, first, last


def search(data: np.ndarray, offsets: np.ndarray, items: Items, longest: bool = True) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """One shard against one block of items.

    Gives (text, item, covered words) for each pair with a match and, if longest, (item, start in the item, length, text)
    of the longest match of every test suffix that is the item's longest here, once for each text that holds it.
    """
    none = np.zeros(0, np.int64)
    ids, of = _stretches(*words(data, offsets), items)
    if not len(ids) or not len(items.starts):
        return [none] * 3, [none] * 4
    sa = suffix_array(ids)
    keys = _windows(ids, sa, items.min_words)
    lo, hi = _bound(keys, items.keys, False), _bound(keys, items.keys, True)
    # texts of each matched key, once
    n = hi - lo
    hit = np.flatnonzero(n > 0)
    if not len(hit):
        return [none] * 3, [none] * 4
    count = n[hit]
    at = np.repeat(lo[hit] - (np.cumsum(count) - count), count) + np.arange(count.sum())
    pair = np.unique(np.stack([np.repeat(hit, count), of[sa[at]]]), axis=1)
    # each such key stands for the test suffixes that begin with it
    by_key = np.argsort(items.key_of, kind="stable")
    first = np.searchsorted(items.key_of[by_key], np.arange(len(items.keys) + 1))
    times = (first[1:] - first[:-1])[pair[0]]
    s = by_key[np.repeat(first[pair[0]] - (np.cumsum(times) - times), times) + np.arange(times.sum())]
    start, text = items.starts[s], np.repeat(pair[1], times)
    order = np.lexsort((start, text))
    start, text = start[order], text[order]
    item = items.of[start]
    # words covered: each match adds min_words, less what the match before it in the same pair covers already
    new = np.concatenate([[True], (np.diff(text) != 0) | (np.diff(item) != 0)])
    gap = np.concatenate([[0], np.diff(start)])
    add = np.where(new, items.min_words, np.minimum(gap, items.min_words))
    begin = np.flatnonzero(new)
    pairs = [text[begin], item[begin], np.add.reduceat(add, begin)]
    if not longest:
        return pairs, [none] * 4
    best, first, last = _longest(ids, sa, keys, items, lo, hi)
    # shorter matches of an item are beaten already, so only the longest are given with all their texts
    most = np.zeros(len(items.begin), np.int64)
    np.maximum.at(most, items.of[items.starts], best)
    got = np.flatnonzero((best > 0) & (best == most[items.of[items.starts]]))
    n = last[got] - first[got]
    at = np.repeat(first[got] - (np.cumsum(n) - n), n) + np.arange(n.sum())
    which, text = np.unique(np.stack([np.repeat(got, n), of[sa[at]]]), axis=1)
    suffix = items.starts[which]
    return pairs, [items.of[suffix], suffix - items.begin[items.of[suffix]], best[which], text]


def _shards(batch: pa.RecordBatch, text_at: int, most_bytes: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of whole texts, each of at most most_bytes unless one text is longer."""
    texts = batch.column(text_at)
    texts = texts.cast(pa.large_binary()) if not pa.types.is_large_binary(texts.type) else texts
    texts = texts.fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(texts):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most_bytes, side="right")) - 1)
        yield row, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def _blocks(items: DataFrame, item_id: str, text: str, block_bytes: int) -> Iterator[tuple[list[int], list[str]]]:
    """The items in blocks of bounded size, read one by one by the driver, which never holds more than a few."""
    ids, texts, size = [], [], 0
    rows = items.select(F.col(item_id).cast("long"), F.col(text)).where(F.col(item_id).isNotNull() & F.col(text).isNotNull()).distinct()
    for i, t in rows.toLocalIterator():
        if texts and size + len(t) > block_bytes:
            yield ids, texts
            ids, texts, size = [], [], 0
        ids.append(i)
        texts.append(t)
        size += len(t)
    if texts:
        yield ids, texts


def _matches(docs: DataFrame, items: DataFrame, doc_id: str, item_id: str, text: str, min_words: int, block_bytes: int, shard_bytes: int, longest: bool) -> DataFrame:
    spark = docs.sparkSession
    bounded_batches(spark)
    schema = "item_id long, item_words long, start long, length long, doc_id long" if longest else "doc_id long, item_id long, item_words long, covered_words long"
    corpus = docs.select(F.col(doc_id).cast("long").alias("d"), F.col(text).alias("t")).where("d is not null and t is not null")
    names = [f.split()[0] for f in schema.split(", ")]

    def one_pass(blocks: list) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            made: dict[int, Items] = {}

            def items_of(i: int) -> Items:
                if i not in made:
                    if len(made) >= 4:  # a few blocks stay made, more are made again for each run of documents
                        made.clear()
                    made[i] = Items(*blocks[i].value, min_words)
                return made[i]

            def meet(held: list) -> Iterator[pa.RecordBatch]:
                for i in range(len(blocks)):
                    of = items_of(i)
                    for doc, data, offsets in held:
                        pairs, long = search(data, offsets, of, longest)
                        if longest:
                            item, start, length, at = long
                            cols = [of.item_ids[item], of.size[item], start, length, doc[at]]
                        else:
                            at, item, covered = pairs
                            cols = [doc[at], of.item_ids[item], of.size[item], covered]
                        if len(cols[0]):
                            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=names)

            held, size = [], 0
            for batch in batches:
                for row, data, offsets in _shards(batch, 1, shard_bytes):
                    held.append((batch.column(0).slice(row, len(offsets) - 1).to_numpy(zero_copy_only=False), data, offsets))
                    size += len(data)
                if size >= HELD_BYTES:
                    yield from meet(held)
                    held, size = [], 0
            if held:
                yield from meet(held)

        return corpus.mapInArrow(run, schema)

    out, blocks, size = None, [], 0
    for ids, texts in _blocks(items, item_id, text, block_bytes):
        blocks.append(spark.sparkContext.broadcast((ids, texts)))  # at most PASS_BYTES in a pass
        size += sum(map(len, texts))
        if size + block_bytes > max(PASS_BYTES, block_bytes):
            part = one_pass(blocks)
            out, blocks, size = part if out is None else out.unionAll(part), [], 0
    if blocks:
        part = one_pass(blocks)
        out = part if out is None else out.unionAll(part)
    return spark.createDataFrame([], schema) if out is None else out


def leaked_pairs(docs: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", min_words: int = MIN_WORDS, least_share: float = 0.5, block_bytes: int = 4 << 20, shard_bytes: int = 4 << 20) -> DataFrame:
    """(doc_id, item_id, item_words, covered_words) of each document that holds at least least_share of an item.

    covered_words counts the item's words that lie in stretches of min_words or more words which follow one another
    in the item as in the document. Null ids and null texts take no part, empty texts and items of fewer than
    min_words words match nothing, repeated rows give one row (an id that comes with several texts counts by the text
    that covers most), and other columns of either table are ignored. Documents are searched whole, however long.
    """
    found = _matches(docs, items, doc_id, item_id, text, min_words, block_bytes, shard_bytes, False)
    found = found.where(F.col("covered_words") >= F.lit(least_share) * F.col("item_words"))
    return found.groupBy("doc_id", "item_id").agg(F.max_by("item_words", "covered_words").alias("item_words"), F.max("covered_words").alias("covered_words"))


def longest_matches(docs: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", min_words: int = MIN_WORDS, block_bytes: int = 4 << 20, shard_bytes: int = 4 << 20) -> DataFrame:
    """Per item the longest stretch of its words that stands verbatim in the corpus, and the lowest document with it.

    (item_id, item_words, start, length, doc_id); start counts words from 0. Of equal lengths the earliest start wins.
    Items without a match of min_words words give no row. Each shard reports all documents with its longest matches, so
    doc_id does not depend on how the documents are laid out.
    """
    found = _matches(docs, items, doc_id, item_id, text, min_words, block_bytes, shard_bytes, True)
    best = F.max(F.struct("length", (-F.col("start")).alias("s"), (-F.col("doc_id")).alias("d"), "item_words")).alias("b")
    return found.groupBy("item_id").agg(best).select("item_id", "b.item_words", (-F.col("b.s")).alias("start"), "b.length", (-F.col("b.d")).alias("doc_id"))


def without_leaks(docs: DataFrame, leaks: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """The documents that hold none of the leaked items; rows with a null id stay."""
    return docs.join(leaks.select(F.col("doc_id").alias(doc_id)).distinct(), doc_id, "left_anti")
