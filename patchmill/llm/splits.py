"""Records of evaluation splits that also stand, exactly or almost, in the training split.

Two records overlap if their paths name one file or their images show the same picture.

Pictures. An image becomes a grey picture of SIDE x SIDE: each channel is brought to mean 0 and deviation 1, so light and
colour balance drop out, and the channels are averaged (where they cancel, with unequal weights). Its shingles are taken from each window of WINDOW x WINDOW
pixels: the signs of the window's lowest BITS cosine frequencies. They hold no position, so a misplaced picture keeps
nearly all of them; noise or another size change some. A mark away from the edge lies in nearly all windows, so the four
strips of STRIP rows or columns along the edges have shingles of their own, of windows of STRIP_WINDOW: the strips at
opposite edges lie so far apart that a mark of up to 4 pixels leaves one of them whole. Against misplacement a training
strip one pixel from the edge is met by evaluation strips at 0, 1 and 2 pixels. Minwise hashes of the shingle sets are
cut into bands, and only pairs with one side in training and the other in another split are joined on an equal band.
Candidates are judged by the pictures' correlation alone, best over misplacements of a pixel, without the worst-fitting
fifth of the pixels (a mark).

Pictures of one layout, as a fixed camera takes them, may share bands without being equal. The pictures of a band that names
more than HOT pairs meet block by block and are judged there, so its pairs are never written; a pair of several such bands
is judged in the first. Which pairs are judged, and how, does not depend on HOT.

Equal grey pictures form one class. The bands of a class are joined once, however many records have the picture, and
the report per split needs no pairs of records at all.
"""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from patchmill.runtime import bounded_batches, written

SIDE, WINDOW, BITS = 16, 9, 14
BANDS, ROWS = 56, 3
STRIP, STRIP_WINDOW = 6, (5, 9)
EDGE_BANDS, INNER_BANDS = 6, 8
LEAST_CORRELATION, PLAIN = 0.95, 0.3
#: Pairs of a band beyond which its pictures meet in blocks; and pictures on a side of a block.
HOT, BLOCK = 1 << 20, 512
#: Without effect: there are no stricter bands any more. A test still sets it.
LEVELS = 3
TRAIN = "train"


def one_file(path: str | None) -> str | None:
    """The path without what does not tell files apart; None if nothing is left."""
    if path is None:
        return None
    steps: list[str] = []
    for step in unquote(path).strip().replace("\\", "/").lower().split("/"):
        if step == "..":
            if steps:
                steps.pop()
        elif step.strip() not in ("", "."):
            steps.append(step)
    return "/".join(steps) or None


def _resize(x: np.ndarray) -> np.ndarray:
    """Images (n, height, width, channels) to SIDE x SIDE, bilinear."""
    for axis in (1, 2):
        n = x.shape[axis]
        if n != SIDE:
            at = np.clip((np.arange(SIDE) + 0.5) * n / SIDE - 0.5, 0, n - 1)
            i = np.floor(at).astype(int)
            f = (at - i).astype(np.float32).reshape([-1 if a == axis else 1 for a in range(4)])
            x = x.take(i, axis) * (1 - f) + x.take(np.minimum(i + 1, n - 1), axis) * f
    return x


def grey(images: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(grey pictures as bytes, whether they have any contrast) of RGB images of one size."""
    x = _resize(images.astype(np.float32))
    x = x - x.mean((1, 2), keepdims=True)
    each = x / np.maximum(x.std((1, 2), keepdims=True), 1e-3)
    x = each.mean(3)
    spread = x.std((1, 2), keepdims=True)
    # channels that cancel are weighted unequally instead
    lost = np.flatnonzero((spread.ravel() <= 0.05) & (each.std((1, 2)).max(1) > 0.5))
    if len(lost):
        x[lost] = each[lost] @ np.array([0.5, 0.3, 0.2], np.float32)
        spread = x.std((1, 2), keepdims=True)
    x = 128 + 40 * x / np.maximum(spread, 1e-3)
    return np.clip(np.rint(x), 0, 255).astype(np.uint8), spread.ravel() > 0.05


def _frequencies(height: int, width: int) -> np.ndarray:
    down, across = (np.cos(np.pi * (np.arange(n)[None] + 0.5) * np.arange(n)[:, None] / n) for n in (height, width))
    order = (lambda t: (sum(t), max(t), t)) if height == width else (lambda t: ((t[0] / height) ** 2 + (t[1] / width) ** 2, t))
    low = sorted(((u, v) for u in range(height) for v in range(width) if u + v), key=order)[:BITS]
    return np.stack([np.outer(down[u], across[v]).ravel() for u, v in low], axis=1).astype(np.float32)


_FREQUENCIES = {shape: _frequencies(*shape) for shape in ((WINDOW, WINDOW), STRIP_WINDOW)}
_BIT = 1 << np.arange(BITS)


def shingles(pictures: np.ndarray, window: tuple[int, int] = (WINDOW, WINDOW)) -> np.ndarray:
    """(n, windows) shingle numbers of grey pictures or strips of them."""
    p = pictures.astype(np.float32)
    for _ in range(2):  # softened, so that pictures that were scaled and ones that were not are equally sharp
        p = np.pad(p, ((0, 0), (1, 1), (1, 1)), mode="edge")
        p = (p[:, :-2] + 2 * p[:, 1:-1] + p[:, 2:]) / 4
        p = (p[:, :, :-2] + 2 * p[:, :, 1:-1] + p[:, :, 2:]) / 4
    w = np.lib.stride_tricks.sliding_window_view(p, window, axis=(1, 2))
    signs = w.reshape(-1, window[0] * window[1]) @ _FREQUENCIES[window] > 0
    return (signs @ _BIT).reshape(len(pictures), w.shape[1] * w.shape[2])


class MinHash:
    """count * ROWS random orders of all shingles."""

    def __init__(self, count: int = BANDS, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.count = count
        self.table = rng.permuted(np.tile(np.arange(1 << BITS, dtype=np.uint16), (count * ROWS, 1)), axis=1)

    def bands(self, codes: np.ndarray, first: int = 0) -> np.ndarray:
        """(n, count) a number for each band, the band's own number, from first on, in the upper half."""
        out = np.empty((len(codes), self.count), np.int64)
        for at in range(0, len(codes), 64):
            least = self.table[:, codes[at : at + 64]].min(2).astype(np.uint64).reshape(self.count, ROWS, -1)
            h = np.zeros((self.count, least.shape[2]), np.uint64)
            for r in range(ROWS):
                h = (h ^ least[:, r]) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
            out[at : at + 64] = ((h >> np.uint64(32)).astype(np.int64) + (first + np.arange(self.count, dtype=np.int64) << 32)[:, None]).T
        return out


class Bands:
    """The bands on which pictures of training and of evaluation are joined."""

    def __init__(self):
        self.whole, self.edge, self.inner = MinHash(BANDS, 11), MinHash(EDGE_BANDS, 12), MinHash(INNER_BANDS, 13)

    def of(self, pictures: np.ndarray, train: bool) -> tuple[np.ndarray, np.ndarray]:
        """(picture, band) of grey pictures. A strip of one value has no shingles, as all such strips are equal."""
        everyone = np.arange(len(pictures))
        who, bands = [np.repeat(everyone, self.whole.count)], [self.whole.bands(shingles(pictures)).ravel()]
        turned = pictures.transpose(0, 2, 1)
        for i, p in enumerate((pictures, pictures[:, ::-1], turned, turned[:, ::-1])):
            first = self.whole.count + i * (self.edge.count + self.inner.count)
            for at in (0, 1) if train else (0, 1, 2):
                strip = p[:, at : at + STRIP]
                some = np.flatnonzero(strip.max((1, 2)) > strip.min((1, 2)))
                codes = shingles(strip[some], STRIP_WINDOW)
                kinds = [(self.edge, first)] if at == 0 else []
                kinds += [(self.inner, first + self.edge.count)] if at == 1 or not train else []
                for hashes, number in kinds:
                    who.append(np.repeat(some, hashes.count))
                    bands.append(hashes.bands(codes, number).ravel())
        return np.concatenate(who), np.concatenate(bands)


def jaccard(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact Jaccard similarity of the shingle sets of each pair of rows."""
    w = a.shape[1]
    sets, sizes = [], []
    for side, x in enumerate((a, b)):
        x = np.sort(x, axis=1).astype(np.int64)
        again = np.zeros(x.shape, bool)
        again[:, 1:] = x[:, 1:] == x[:, :-1]
        x = np.where(again, -1 - side * w - np.arange(w), x)  # a number that occurs nowhere else
        sets.append(x)
        sizes.append(w - again.sum(1))
    x = np.sort(np.concatenate(sets, axis=1), axis=1)
    both = (x[:, 1:] == x[:, :-1]).sum(1)
    return both / (sizes[0] + sizes[1] - both)


def _trimmed(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Correlation of each pair of rows without the worst-fitting fifth."""
    count = int(0.8 * x.shape[1])
    w = np.ones_like(x)
    for again in range(4):
        n = w.sum(1, keepdims=True)
        cx, cy = x - (x * w).sum(1, keepdims=True) / n, y - (y * w).sum(1, keepdims=True) / n
        xy, xx, yy = ((u * v * w).sum(1, keepdims=True) for u, v in ((cx, cy), (cx, cx), (cy, cy)))
        if again < 3:
            miss = np.abs(cy - xy / np.maximum(xx, 1e-6) * cx)
            w = (miss <= np.partition(miss, count, axis=1)[:, count : count + 1]).astype(np.float32)
    return (xy / np.sqrt(np.maximum(xx * yy, 1e-6))).ravel()


def _centred(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(y, y of mean 0 and length 1) of the inner parts of pictures."""
    y = b[:, 1:-1, 1:-1].reshape(len(b), -1).astype(np.float32)
    cy = y - y.mean(1, keepdims=True)
    return y, cy / np.maximum(np.sqrt((cy * cy).sum(1, keepdims=True)), 1e-3)


def _misplaced(a: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(x, its length without the mean) of the parts of pictures at each misplacement of a pixel."""
    inner = SIDE - 2
    for dy in range(3):
        for dx in range(3):
            x = a[:, dy : dy + inner, dx : dx + inner].reshape(len(a), -1).astype(np.float32)
            yield x, np.sqrt(np.maximum((x * x).sum(1) - x.sum(1) ** 2 / x.shape[1], 1e-6))


def correlation(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Best correlation of each pair of pictures over misplacements of a pixel, without the worst-fitting fifth.

    Misplacements at which the whole pictures correlate less than PLAIN are passed over: a mark would need the energy of
    ten pictures to hide an equal one like that. A pair without any other counts as -1.
    """
    best = np.full(len(a), -1.0)
    y, cy = _centred(b)
    for x, length in _misplaced(a):
        some = np.flatnonzero(np.einsum("ij,ij->i", x, cy) >= PLAIN * length)  # cy has mean 0
        if len(some):
            best[some] = np.maximum(best[some], _trimmed(x[some], y[some]))
    return best


def _may_correlate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(len(a), len(b)) whether correlation() may be other than -1, a little generous as sums round differently here."""
    cy = _centred(b)[1].T
    out = np.zeros((len(a), len(b)), bool)
    for x, length in _misplaced(a):
        out |= x @ cy >= (PLAIN - 1e-3) * length[:, None]
    return out


def _same(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which, their jaccard) of the pairs of pictures that are the same."""
    keep = np.flatnonzero(correlation(a, b) >= LEAST_CORRELATION)
    return keep, jaccard(shingles(a[keep]), shingles(b[keep])) if len(keep) else np.zeros(0)


def _greys(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, SIDE, SIDE)


def _sketches(samples: DataFrame, sample_id: str, split: str, image_path: str, image: str, height: str, width: str) -> DataFrame:
    """(id, split, path, grey) of each row with id and split; grey is null without a usable image."""
    rows = samples.select(F.col(sample_id).cast("long").alias("id"), F.lower(F.trim(split)).alias("split"), F.col(image_path).alias("path"), F.col(image).alias("image"), F.col(height).cast("int").alias("h"), F.col(width).cast("int").alias("w")).where("id is not null and split is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            paths = [one_file(p) for p in batch.column(2).to_pylist()]
            size: dict[tuple, list[int]] = {}
            data = batch.column(3).to_pylist()
            for i, (d, h, w) in enumerate(zip(data, batch.column(4).to_pylist(), batch.column(5).to_pylist())):
                if d is not None and h is not None and w is not None and h > 0 and w > 0 and len(d) == 3 * h * w:
                    size.setdefault((h, w), []).append(i)
            pictures: list = [None] * n
            for (h, w), rows_ in size.items():
                step = max(1, (1 << 22) // (h * w))
                for at in range(0, len(rows_), step):
                    part = rows_[at : at + step]
                    g, good = grey(np.frombuffer(b"".join(data[i] for i in part), np.uint8).reshape(len(part), h, w, 3))
                    for j in np.flatnonzero(good):
                        pictures[part[j]] = g[j].tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(paths, pa.string()), pa.array(pictures, pa.binary())], names=["id", "split", "path", "grey"])

    return rows.mapInArrow(run, "id long, split string, path string, grey binary")


def _banded(pictures: DataFrame) -> DataFrame:
    """(n, side, band) of pictures (n, t, e, grey); side 1 is training, 0 evaluation, and a picture may stand on both."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands()
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                for side in (0, 1):
                    some = part.filter(part.column(2 - side))
                    if some.num_rows:
                        who, band = bands.of(_greys(some.column(3)), side == 1)
                        yield pa.RecordBatch.from_arrays([some.column(0).take(pa.array(who)), pa.array(np.full(len(who), side, np.int8)), pa.array(band)], names=["n", "side", "band"])

    return pictures.select("n", "t", "e", "grey").mapInArrow(run, "n long, side byte, band long")


def _joined(met: DataFrame, pictures: DataFrame) -> DataFrame:
    """(t, e, jaccard) of the same pictures among those with a common band."""
    t, e = (met.where(F.col("side") == side).select("band", F.col("n").alias(name)) for name, side in (("t", 1), ("e", 0)))
    near = t.join(e, "band").where("t <> e").select("t", "e").distinct()
    grey_of = pictures.select("n", "pic", "grey")
    both = near.join(grey_of.toDF("t", "pt", "gt"), "t").join(grey_of.toDF("e", "pe", "ge"), "e").select("pt", "pe", "gt", "ge")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                keep, j = _same(_greys(part.column(2)), _greys(part.column(3)))
                take = pa.array(keep)
                yield pa.RecordBatch.from_arrays([part.column(0).take(take), part.column(1).take(take), pa.array(j)], names=["t", "e", "jaccard"])

    return both.mapInArrow(run, "t long, e long, jaccard double")


def _share(a: pa.ChunkedArray, b: pa.ChunkedArray) -> np.ndarray:
    """(len(a), len(b)) whether lists of numbers have one in common."""
    sides = []
    for lists in (a.combine_chunks(), b.combine_chunks()):
        sides.append((lists.flatten().to_numpy(), np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())))
    common = np.intersect1d(sides[0][0], sides[1][0])
    out = np.zeros((len(a), len(b)), bool)
    for at in range(0, len(common), 4096):
        part = common[at : at + 4096]
        has = []
        for (numbers, who), n in zip(sides, out.shape):
            i = np.minimum(np.searchsorted(part, numbers), len(part) - 1)
            some = part[i] == numbers
            m = np.zeros((n, len(part)), np.float32)
            m[who[some], i[some]] = 1
            has.append(m)
        out |= has[0] @ has[1].T > 0
    return out


def _in_blocks(met: DataFrame, pictures: DataFrame) -> DataFrame:
    """As _joined, of bands with many pictures: in blocks of BLOCK pictures of either side. Only what is the same leaves them."""
    mt, me = (F.ceil(F.col(c) / BLOCK).cast("int") for c in ("nt", "ne"))
    bands = met.groupBy("n", "side").agg(F.sort_array(F.collect_set(F.struct("band", mt.alias("mt"), me.alias("me")))).alias("bands"))
    each = bands.join(pictures.select("n", "pic", "grey"), "n").select("side", "pic", "grey", F.col("bands.band").alias("all"), F.posexplode("bands").alias("at", "b"))
    # lower: the bands of the picture before this one, in which pairs that share one were judged
    each = each.select("side", "pic", "grey", F.slice("all", F.lit(1), F.col("at")).alias("lower"), "b.*")
    t, e = (each.where(F.col("side") == side) for side in (1, 0))
    t = t.withColumn("i", F.pmod(F.xxhash64("pic"), "mt").cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("me") - 1)))
    e = e.withColumn("j", F.pmod(F.xxhash64("pic"), "me").cast("int")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("mt") - 1)))
    names = ["band", "i", "j", "pic", "grey", "lower"]
    t, e = (side.select(names).toDF(*names).groupBy("band", "i", "j") for side in (t, e))  # renamed, or Spark takes the two for one

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] * 2 + [np.zeros(0)]]
        if left.num_rows and right.num_rows:
            (x, a), (y, b) = ((side.column("pic").to_numpy(), _greys(side.column("grey"))) for side in (left, right))
            i, j = np.nonzero(_may_correlate(a, b) & ~_share(left.column("lower"), right.column("lower")) & (x[:, None] != y))
            for at in range(0, len(i), 512):
                p, q = i[at : at + 512], j[at : at + 512]
                keep, similar = _same(a[p], b[q])
                out.append([x[p[keep]], y[q[keep]], similar])
        return pa.table([pa.array(np.concatenate(c)) for c in zip(*out)], names=["t", "e", "jaccard"])

    return t.cogroup(e).applyInArrow(run, "t long, e long, jaccard double")


class Overlaps:
    """The search over one table; its sketches are written to the shared folder once."""

    def __init__(self, samples: DataFrame, *, sample_id: str = "sample_id", split: str = "split", image_path: str = "image_path", image: str = "image", height: str = "height", width: str = "width", train: str = TRAIN):
        """Splits are compared in lower case without outer blanks; every split but train counts as evaluation. Rows
        without id or split take no part. A null path, or one with no step left, names no file. A null image, one whose
        length is not 3 * height * width, and one without contrast show no picture. Repeated rows count once; an id that
        comes with several paths or images overlaps by any of them. Other columns are ignored."""
        bounded_batches(samples.sparkSession)
        at = written(_sketches(samples, sample_id, split, image_path, image, height, width))
        self.at = at.withColumn("train", F.col("split") == train)
        self.ids = self.at.select("id", "split", "train", "path", F.xxhash64("grey").alias("pic"), F.col("grey").isNotNull().alias("seen"))

    def pictures(self) -> DataFrame:
        """(t, e, jaccard): pictures, by the hash of their grey form, of a training and of an evaluation record, that
        are the same; equal ones included."""
        seen = self.at.where("grey is not null").select(F.xxhash64("grey").alias("pic"), "train", "grey")
        pics = seen.groupBy("pic").agg(F.bool_or("train").alias("t"), F.bool_or(~F.col("train")).alias("e"), F.any_value("grey").alias("grey"))
        pics = written(pics.withColumn("n", F.monotonically_increasing_id()))  # a number packs better than a hash in the many rows of bands
        of = Window.partitionBy("band")
        sides = [F.count_if(F.col("side") == side).over(of).alias(name) for name, side in (("nt", 1), ("ne", 0))]
        # bands of one side only end here, before any join
        met = written(_banded(pics).select("*", *sides).where("nt > 0 and ne > 0"))
        hot = F.col("nt") * F.col("ne") > HOT
        found = _joined(met.where(~hot), pics)
        if not (crowd := met.where(hot)).isEmpty():
            found = found.unionByName(_in_blocks(crowd, pics)).dropDuplicates(["t", "e"])
        equal = pics.where("t and e").select(F.col("pic").alias("t"), F.col("pic").alias("e"), F.lit(1.0).alias("jaccard"))
        return found.unionByName(equal)

    def pairs(self) -> DataFrame:
        """(id_a, id_b), smaller first: overlapping records, one of training and one of another split."""
        seen = self.ids.where("seen").select("id", "train", "pic").distinct()
        t, e = (seen.where(c).select(F.col("id").alias(f"{s}_id"), F.col("pic").alias(s)) for c, s in (("train", "t"), ("not train", "e")))
        by_picture = self.pictures().join(t, "t").join(e, "e").select("t_id", "e_id")
        named = self.ids.where("path is not null").select("id", "train", "path").distinct()
        t, e = (named.where(c).select(F.col("id").alias(f"{s}_id"), "path") for c, s in (("train", "t"), ("not train", "e")))
        by_path = t.join(e, "path").select("t_id", "e_id")
        both = by_picture.unionByName(by_path).where("t_id <> e_id")
        return both.select(F.least("t_id", "e_id").alias("id_a"), F.greatest("t_id", "e_id").alias("id_b")).distinct()

    def records(self) -> DataFrame:
        """(id, split, by_path, by_picture): the evaluation records that overlap with training, without naming pairs."""
        e = self.ids.where("not train")
        paths = self.ids.where("train and path is not null").select("path").distinct().withColumn("p", F.lit(True))
        pics = self.pictures().select(F.col("e").alias("pic")).distinct().withColumn("q", F.lit(True))
        both = e.join(paths, "path", "left").join(pics, "pic", "left")
        out = both.groupBy("id", "split").agg(F.coalesce(F.bool_or("p"), F.lit(False)).alias("by_path"), F.coalesce(F.bool_or(F.col("q") & F.col("seen")), F.lit(False)).alias("by_picture"))
        return out.where("by_path or by_picture")


def counts(records: DataFrame, samples: DataFrame, *, sample_id: str = "sample_id", split: str = "split", source: str = "category") -> DataFrame:
    """(split, source, n, n_overlap, by_path, by_picture): distinct evaluation records and overlaps per split and source.

    source comes in lower case without outer blanks; a null source is a source of its own. A record that comes with
    several sources counts in each.
    """
    all_ = samples.select(F.col(sample_id).cast("long").alias("id"), F.lower(F.trim(split)).alias("split"), F.lower(F.trim(source)).alias(source)).where("id is not null and split is not null").where(F.col("split") != TRAIN).distinct()
    return all_.join(records, ["id", "split"], "left").groupBy("split", source).agg(F.count("*").alias("n"), F.count_if(F.expr("by_path or by_picture")).alias("n_overlap"), F.count_if("by_path").alias("by_path"), F.count_if("by_picture").alias("by_picture"))
