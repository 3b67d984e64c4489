import numpy as np
import pandas as pd
import pytest

from patchmill.llm import subsets

SCHEMA = "g string, vec_id long, v array<float>, subset_permille string, copies int"


def choose(spark, rows, targets, **kw):
    df = spark.createDataFrame(rows, SCHEMA)
    t = spark.createDataFrame(targets, "g string, subset_permille int, vec_id int")
    out = {}
    for r in subsets.varied_subset(df, t, ["g"], vec_id="vec_id", vector="v", dim=4, **kw).collect():
        out.setdefault(r.g, {})[r.id] = r
    return out


def data(g, x, start=0):
    return [(g, start + i, [float(a) for a in v], "", 0) for i, v in enumerate(x)]


@pytest.mark.parametrize("part", [4096, 64])
def test_size_variety_and_crowding(spark, part):
    rng = np.random.default_rng(1)
    crowd = rng.normal(0, 0.01, (900, 4)) + 5
    rare = rng.normal(0, 9, (30, 4))
    some = rng.normal(0, 0.3, (70, 4)) - 5
    x = np.concatenate([crowd, rare, some]).astype(np.float32)
    got = choose(spark, data("a", x), [("a", 60, 0)], part=part, pool_part=part)["a"]
    assert len(got) == 60
    ids = np.array(sorted(got))
    assert sum(900 <= i < 930 for i in ids) >= 29  # rare kinds are there
    assert sum(i < 900 for i in ids) <= 15  # the crowd is not
    # the radius left is near to that of one greedy run over everything
    rows, radii = subsets.farthest_first(x, 61)
    d = np.sqrt(((x[:, None] - x[ids][None]) ** 2).sum(-1)).min(1).max()
    assert d <= 2 * radii[60]


def test_sizes_and_dirt(spark):
    nan = float("nan")
    rows = data("a", np.arange(40).reshape(10, 4) + 1) + [("a", 50, [1.0, 2.0, 3.0, 4.0], "", 0), ("a", 51, [nan] * 4, "", 0), ("a", 52, None, "", 0), ("a", 53, [0.0] * 4, "", 0), ("a", 54, [1.0] * 3, "", 0), (None, 1, [1.0] * 4, "", 0), ("b", 1, [1.0] * 4, "", 0), ("c", 1, [1.0] * 4, "", 0), ("d", 1, [1.0] * 4, "", 0), ("e", 1, [1.0] * 4, "", 0)]
    got = choose(spark, rows, [("a", 250, 0), ("a", 100, 0), ("b", 1, 0), ("c", 0, 0), ("d", None, 0), ("x", 9, 0)])
    assert {g: len(v) for g, v in got.items()} == {"a": 3, "b": 1}
    assert choose(spark, rows, [("a", 5000, 0)])["a"][0].copies == 2
    assert choose(spark, rows[:0], [("a", 5000, 0)]) == {} and choose(spark, rows, []) == {}


def test_ties_and_copies_give_the_exact_size(spark):
    grid = np.array([[a, b, 0, 1] for a in range(20) for b in range(20)], float)
    rows = data("a", grid) + data("a", [[3, 3, 0, 1]] * 300, 1000)
    got = choose(spark, rows, [("a", 333, 0)], part=50)["a"]
    assert len(got) == 133 and max(got) < 400


def test_farthest_first_by_hand():
    rows, radii = subsets.farthest_first(np.array([[0.0], [1.0], [10.0], [10.5]], np.float32), 9)
    assert rows.tolist() == [0, 3, 1, 2] and np.allclose(radii, [5.375, 10.5, 1.0, 0.5])


def test_covers_as_well_as_one_greedy_run(spark):
    """64,000 vectors in 2,000 clusters of very uneven size; many partitions in both runs."""
    rng = np.random.default_rng(3)
    w = 1 / np.arange(1, 2001)
    at = rng.choice(2000, 64_000, p=w / w.sum())
    x = (rng.normal(0, 2, (2000, 32))[at] + rng.normal(0, 0.3, (64_000, 32))).astype(np.float32)
    df = spark.createDataFrame(pd.DataFrame({"g": "a", "vec_id": np.arange(len(x)), "v": x.tolist()}), "g string, vec_id long, v array<float>")
    t = spark.createDataFrame([("a", 50)], "g string, subset_permille int")
    got = np.sort([r.id for r in subsets.varied_subset(df, t, ["g"], vec_id="vec_id", vector="v", dim=32).select("id").collect()])
    _, radii = subsets.farthest_first(x, 3201)
    left = np.full(len(x), np.inf, np.float32)
    for i in range(0, len(got), 400):
        s = x[got[i : i + 400]]
        left = np.minimum(left, ((x * x).sum(1)[:, None] + (s * s).sum(1) - 2 * x @ s.T).min(1))
    assert len(got) == 3200
    assert np.sqrt(left.max()) <= 1.5 * radii[3200]
    assert set(at[got]) >= set(at)  # every kind


def test_pivots_may_be_shuffled_to_their_rows(spark):
    rng = np.random.default_rng(2)
    rows = data("a", rng.normal(0, 1, (900, 4))) + data("b", rng.normal(0, 1, (50, 4)), 1000)
    targets = [("a", 100, 0), ("b", 100, 0)]
    one, two = (choose(spark, rows, targets, part=40, pool_part=30, model_bytes=m) for m in (1 << 20, 0))
    assert {g: len(v) for g, v in one.items()} == {"a": 90, "b": 5}
    assert {g: sorted(v) for g, v in one.items()} == {g: sorted(v) for g, v in two.items()}
