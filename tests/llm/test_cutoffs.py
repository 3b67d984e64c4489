import random

import pytest

from patchmill.llm import cutoffs


def slow(scores, permille):
    need = min(len(scores), max(1, -(-permille * len(scores) // 1000)))
    return sorted(scores, reverse=True)[need - 1]


def run(spark, rows, targets):
    df = spark.createDataFrame(rows, "src string, score double, n int, keep_permille string")
    t = spark.createDataFrame(targets, "src string, keep_permille int, cutoff int")
    return {r.src: r for r in cutoffs.cutoffs(df, t, ["src"]).collect()}


def test_against_sorting(spark):
    rng = random.Random(1)
    kinds = {
        "ties": lambda: float(rng.randrange(4)),
        "tails": lambda: rng.choice([-1, 1]) * 10 ** rng.uniform(-300, 300),
        "normal": lambda: rng.gauss(0, 1),
        "one": lambda: -0.0,
        "negative": lambda: -rng.random() - 1e-9,
    }
    for permille in (1, 75, 500, 990, 1000):
        rows = {k: [f() for _ in range(rng.randrange(1, 400))] for k, f in kinds.items()}
        got = run(spark, [(k, v, 0, "") for k, vs in rows.items() for v in vs], [(k, permille, 0) for k in kinds])
        for k, vs in rows.items():
            want = slow(vs, permille)
            assert (got[k].cutoff, got[k].n, got[k].n_kept) == (want, len(vs), sum(v >= want for v in vs)), (k, permille)


def test_dirt_and_limits(spark):
    nan, inf = float("nan"), float("inf")
    rows = [("a", 1.0, 1, ""), ("a", nan, 1, ""), ("a", inf, 1, ""), ("a", -inf, 1, ""), ("a", None, 1, ""), (None, 1.0, 1, ""), ("b", nan, 1, ""), ("c", 1.0, 1, "")]
    got = run(spark, rows, [("a", 0, 0), ("b", 500, 0), (None, 500, 0), ("d", 500, 0), ("e", None, 0)])
    assert {k: (r.n, r.cutoff, r.n_kept) for k, r in got.items()} == {"a": (1, 1.0, 1)}
    got = run(spark, [("a", 1.0, 1, ""), ("a", 2.0, 1, "")], [("a", 100, 0), ("a", 5000, 0)])
    assert (got["a"].cutoff, got["a"].n_kept) == (1.0, 2)
    assert run(spark, rows[:0], [("a", 1, 0)]) == {} and run(spark, rows, []) == {}


def test_kept(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 2.0), ("a", float("nan")), ("a", None), (None, 9.0)], "src string, score double")
    cuts = cutoffs.cutoffs(df, spark.createDataFrame([("a", 400)], "src string, keep_permille int"), ["src"])
    assert [tuple(r) for r in cutoffs.kept(df, cuts, ["src"]).collect()] == [("a", 2.0), ("a", 2.0)]


def test_latest_scores(spark):
    s = spark.createDataFrame(
        [(1, 0.5, 1, 5), (1, 0.7, 2, 3), (1, float("inf"), 9, 9), (2, None, 1, 1), (3, 1.0, 1, 1), (4, 1.0, 2, 1), (4, 3.0, 2, 1), (None, 1.0, 1, 1), (9, 1.0, 1, 1)],
        "sample_id long, score double, scored_at int, arrived_at int",
    )
    m = spark.createDataFrame([(1, " Can", 0, 1), (1, "can ", 0, 2), (2, "can", 0, 1), (3, "can", None, 1), (4, "VIAL", 1, 1), (None, "can", 0, 1), (5, None, 1, 1)], "sample_id long, category string, label int, arrived_at int")
    assert {tuple(r) for r in cutoffs.latest_scores(s, m).collect()} == {("can", 0, 1, 0.7), ("vial", 1, 4, 3.0)}


@pytest.mark.parametrize("x", [0.0, 1.5, -1.5, 1e308, -1e-308, 5e-324])
def test_doubles_in_order(x):
    assert cutoffs._double(cutoffs._rank(x)) == x
    assert cutoffs._rank(-1e300) < cutoffs._rank(-1.0) < cutoffs._rank(0.0) < cutoffs._rank(1e-320) < cutoffs._rank(7.0)


def test_rows_outside_the_brackets_are_left_out(spark, monkeypatch):
    monkeypatch.setattr(cutoffs, "REWRITE", 10)
    monkeypatch.setattr(cutoffs, "SNAP", 4)
    monkeypatch.setattr(cutoffs, "SOURCES", 2)
    rng = random.Random(3)
    rows = {k: [round(rng.gauss(0, 5), 1) if k != "c" else rng.gauss(0, 1) for _ in range(n)] for k, n in (("a", 900), ("b", 300), ("c", 700), ("d", 1), ("e", 5))}
    got = run(spark, [(k, v, 0, "") for k, vs in rows.items() for v in vs], [(k, 333, 0) for k in rows])
    for k, vs in rows.items():
        want = slow(vs, 333)
        assert (got[k].cutoff, got[k].n, got[k].n_kept) == (want, len(vs), sum(v >= want for v in vs)), k
