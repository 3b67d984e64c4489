import numpy as np
import pyarrow as pa
import pytest

from patchmill.llm import splits

SCHEMA = "sample_id long, category string, split string, image_path string, height int, width int, image binary, id int, train boolean"


def picture(seed, side=16):
    rng = np.random.default_rng(seed)
    coarse = rng.uniform(30, 220, (1, 7, 7, 3)).astype(np.float32)
    grid = np.linspace(0, 6, side + 2)
    i = np.minimum(grid.astype(int), 5)
    f = (grid - i)[:, None, None]
    x = coarse[0][i] * (1 - f) + coarse[0][i + 1] * f
    f = (grid - i)[None, :, None]
    return x[:, i] * (1 - f) + x[:, i + 1] * f  # side + 2: a rim to misplace into


def as_bytes(x):
    return np.clip(np.rint(x), 0, 255).astype(np.uint8).tobytes()


def row(i, split, image, side=16, path=None, category="can"):
    return (i, category, split, path, side, side, image, 0, True)


def inner(p, dy=0, dx=0):
    return p[1 + dy : p.shape[0] - 1 + dy, 1 + dx : p.shape[1] - 1 + dx]


def pairs(spark, rows):
    return {(r.id_a, r.id_b) for r in splits.Overlaps(spark.createDataFrame(rows, SCHEMA)).pairs().collect()}


def marked(p, y, x, value):
    p = p.copy()
    p[y : y + 3, x : x + 3] = value
    return p


def test_kinds_of_same_picture(spark):
    rng = np.random.default_rng(1)
    kinds = [
        lambda p: inner(p),
        lambda p: inner(p) * 0.7 + 30,
        lambda p: inner(p) * np.array([0.8, 1.0, 1.1]),
        lambda p: inner(p) + rng.normal(0, 3, (16, 16, 3)),
        lambda p: inner(p, 1, 0),
        lambda p: inner(p, -1, 1),
        lambda p: marked(inner(p), 0, 0, 250),
        lambda p: marked(inner(p), 13, 13, 4),
    ]
    rows, want = [], set()
    for seed in range(6):
        for j, kind in enumerate(kinds):
            p, i = picture(100 * seed + j), 1000 * seed + 10 * j
            rows += [row(i, "train", as_bytes(inner(p))), row(i + 1, " Validation ", as_bytes(kind(p)))]
            want.add((i, i + 1))
    got = pairs(spark, rows)
    assert got <= want and len(got) >= 0.95 * len(want)


def test_sizes(spark):
    rows = []
    for seed in range(10):
        p = inner(picture(seed))
        for j, side in enumerate((16, 12, 20, 24)):
            at = np.clip((np.arange(side) + 0.5) * 16 / side - 0.5, 0, 15)
            i, f = np.minimum(at.astype(int), 14), (at - np.minimum(at.astype(int), 14))[:, None, None]
            q = p[i] * (1 - f) + p[i + 1] * f
            q = (q.transpose(1, 0, 2)[i] * (1 - f) + q.transpose(1, 0, 2)[i + 1] * f).transpose(1, 0, 2)
            rows.append(row(10 * seed + j, "train" if not j else "test_public", as_bytes(q), side))
    got = pairs(spark, rows)
    want = {(10 * s, 10 * s + j) for s in range(10) for j in (1, 2, 3)}
    assert got <= want and len(got) >= 0.9 * len(want)


@pytest.mark.parametrize(
    "a, b, same",
    [
        ("data/x/a b.png", " ./DATA//x\\y/../a%20b.PNG ", True),
        ("../a.png", "/a.png", True),
        ("a/b.png", "a/c.png", False),
        ("", " ./ ", False),
        (None, None, False),
        ("a%2Fb.png", "a/b.png", True),
    ],
)
def test_paths(spark, a, b, same):
    rows = [row(1, "TRAIN", None, path=a), row(2, "test_public", None, path=b), row(3, "train", None, path=a)]
    assert pairs(spark, rows) == ({(1, 2), (2, 3)} if same else set())


def test_dirt_and_hot_picture(spark):
    p = as_bytes(inner(picture(1)))
    flat = bytes([7]) * 768
    rows = [row(1, "train", p), row(1, "train", p), row(2, "train", p[:-5]), row(3, "validation", p[:-5]), row(4, "validation", None), row(5, None, p), row(None, "validation", p), row(6, "train", flat), row(7, "validation", flat), row(8, "validation", b"", 0)]
    assert pairs(spark, rows) == set()
    rows += [row(100 + i, "validation", p) for i in range(300)] + [row(500 + i, "train", p) for i in range(3)]
    assert len(pairs(spark, rows)) == 300 * 4
    assert pairs(spark, []) == set()
    df = spark.createDataFrame(rows, SCHEMA)
    got = [tuple(r) for r in splits.counts(splits.Overlaps(df).records(), df).collect()]
    assert got == [("validation", "can", 304, 300, 0, 300)]


def test_counts(spark):
    p, q = (as_bytes(inner(picture(i))) for i in (1, 2))
    rows = [row(1, "train", p, path="x"), row(2, "validation", p, path="y", category=" CAN"), row(3, "validation", q, path="./X", category=None), row(4, "test_public", q)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {tuple(r) for r in splits.counts(splits.Overlaps(df).records(), df).collect()}
    assert got == {("validation", "can", 1, 1, 0, 1), ("validation", None, 1, 1, 1, 0), ("test_public", "can", 1, 0, 0, 0)}


def test_minwise_hashes_estimate_jaccard():
    rng = np.random.default_rng(2)
    a = rng.integers(0, 1 << splits.BITS, (1, 80))
    b = np.concatenate([a[:, :50], rng.integers(0, 1 << splits.BITS, (1, 30))], axis=1)
    t = splits.MinHash().table
    estimate = (t[:, a].min(2) == t[:, b].min(2)).mean()
    assert abs(estimate - splits.jaccard(a, b)[0]) < 0.15


@pytest.mark.parametrize("side", [2, 3])
def test_marks_at_every_position(side):
    grey = lambda x: splits.grey(np.clip(np.rint(np.stack(x)), 0, 255))[0]
    plain, other = [], []
    for y in range(17 - side):
        for x in range(17 - side):
            p = inner(picture(1000 * side + 17 * y + x))
            q = p.copy()
            q[y : y + side, x : x + side] += 90 if p[y, x].mean() < 125 else -90
            plain.append(p)
            other.append(q)
    a, b = grey(plain), grey(other)
    assert (splits.correlation(a, b) >= splits.LEAST_CORRELATION).all()
    bands = splits.Bands()
    (i, x), (j, y) = bands.of(a, True), bands.of(b, False)
    left, right = set(zip(i.tolist(), x.tolist())), set(zip(j.tolist(), y.tolist()))
    missed = set(range(len(a))) - {i for i, _ in left & right}
    assert len(missed) <= 0.01 * len(a)


def test_marks_in_the_middle(spark):
    rows, want = [], set()
    for seed in range(20):
        p, i = inner(picture(seed)), 10 * seed
        y, x = 5 + seed % 4, 5 + seed // 4
        rows += [row(i, "train", as_bytes(p)), row(i + 1, "validation", as_bytes(marked(p, y, x, 250 if p[y, x].mean() < 125 else 4)))]
        want.add((i, i + 1))
    assert pairs(spark, rows) == want


def test_flat_strips_do_not_join():
    a = np.full((2, 16, 16), 120, np.uint8)
    a[0, 7:9, 7:9], a[1, 7, 7:9] = 250, 20
    who, _ = splits.Bands().of(a, True)
    assert len(who) == 2 * splits.BANDS


@pytest.mark.parametrize("hot, levels", [(50, 1), (50, 3), (1, 3)])
def test_hot_bands_lose_nothing(spark, monkeypatch, hot, levels):
    """Pictures of one layout share many bands; the copies among them are found, and nothing that does not correlate."""
    monkeypatch.setattr(splits, "HOT", hot)
    monkeypatch.setattr(splits, "LEVELS", levels)
    monkeypatch.setattr(splits, "BLOCK", 8)
    rng = np.random.default_rng(9)
    layout = picture(77)
    rows, want = [], set()
    for i in range(120):
        p = inner(0.5 * layout + 0.5 * picture(1000 + i))
        rows.append(row(2 * i, "train" if i % 3 else "validation", as_bytes(p)))
        if i % 10 == 1 and i % 3:
            rows.append(row(2 * i + 1, "validation", as_bytes(p * 0.9 + 10 + rng.normal(0, 0.5, (16, 16, 3)))))
            want.add((2 * i, 2 * i + 1))
    got = pairs(spark, rows)
    grey = splits.grey(np.stack([np.frombuffer(r[6], np.uint8).reshape(16, 16, 3) for r in rows]))[0]
    at = {r[0]: i for i, r in enumerate(rows)}
    a, b = (np.array([at[x] for x in side]) for side in zip(*sorted(got)))
    assert want <= got
    assert (np.maximum(splits.correlation(grey[a], grey[b]), splits.correlation(grey[b], grey[a])) >= splits.LEAST_CORRELATION).all()


def test_channels_that_cancel(spark):
    p = inner(picture(5)).mean(2)
    x = np.stack([p, 250 - p, np.full_like(p, 99)], axis=2)
    q = inner(picture(6)).mean(2)
    y = np.stack([q, 250 - q, np.full_like(q, 99)], axis=2)
    rows = [row(1, "train", as_bytes(x)), row(2, "validation", as_bytes(x)), row(3, "validation", as_bytes(y))]
    assert pairs(spark, rows) == {(1, 2)}


def crowded():
    """Pictures of one layout, each training one beside a validation one with a mark, which leaves few shingles whole."""
    layout = picture(77)
    rows, want = [], set()
    for i in range(60):
        p, y, x = inner(0.5 * layout + 0.5 * picture(1000 + i)), 3 + i % 8, 3 + i // 8
        rows += [row(2 * i, "train", as_bytes(p)), row(2 * i + 1, "validation", as_bytes(marked(p, y, x, 250 if p[y, x].mean() < 125 else 4)))]
        want.add((2 * i, 2 * i + 1))
    return rows, want


@pytest.mark.parametrize("hot, block", [(0, 8), (0, 512), (40, 8)])
def test_pairs_do_not_depend_on_what_is_hot(spark, monkeypatch, hot, block):
    rows, want = crowded()
    cold = pairs(spark, rows)
    assert len(want & cold) >= 0.95 * len(want)
    monkeypatch.setattr(splits, "HOT", hot)
    monkeypatch.setattr(splits, "BLOCK", block)
    assert pairs(spark, rows) == cold


def test_pairs_left_out_of_a_block():
    lists = lambda x: pa.chunked_array([pa.array(x, pa.list_(pa.int64()))])
    got = splits._share(lists([[], [5], [7, 9]]), lists([[9, 11], [], [5, 7], [4]]))
    assert got.tolist() == [[False] * 4, [False, False, True, False], [True, False, True, False]]
    many = [[int(x) for x in np.arange(3000) * 3 + i] for i in range(3)]  # beyond one part of common numbers
    assert splits._share(lists(many), lists(many + [[8999, 10**6]])).tolist() == [[i == j or (i, j) == (2, 3) for j in range(4)] for i in range(3)]
    rows, _ = crowded()
    grey = splits.grey(np.stack([np.frombuffer(r[6], np.uint8).reshape(16, 16, 3) for r in rows]))[0]
    i, j = np.nonzero(~splits._may_correlate(grey, grey[::-1]))
    assert (splits.correlation(grey[i], grey[::-1][j]) == -1).all()
