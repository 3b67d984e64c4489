import numpy as np
import pytest

from patchmill.llm import sketches

SF = "/root/testdata/sf0.01"
SHARES = [0.01, 0.25, 0.5, 0.75, 0.95, 0.99]


def rank_miss(values, share, value):
    values = np.sort(values)
    lo, hi = np.searchsorted(values, value, "left") / len(values), np.searchsorted(values, value, "right") / len(values)
    return max(0.0, lo - share, share - hi)


@pytest.mark.parametrize("kind", ["random", "sorted", "ties", "tails"])
def test_error_within_the_bound(kind):
    rng = np.random.default_rng(5)
    v = {"random": rng.random(200_000), "sorted": np.arange(200_000.0), "ties": rng.integers(0, 5, 200_000).astype(float), "tails": rng.standard_cauchy(200_000)}[kind]
    parts = [sketches.Sketch(256, i) for i in range(7)]
    for i, p in enumerate(parts):
        for chunk in np.array_split(v[i::7], 11):
            p.add(chunk)
    one = sketches.Sketch(256, 99)
    for p in parts:
        one.merge(p.n, p.variance, p.levels)
    assert one.n == len(v) == sum(len(x) * 2**h for h, x in enumerate(one.levels))
    assert sum(map(len, one.levels)) < 4 * 256 and one.error(0.01) < 0.03
    for q, x in zip(SHARES, one.quantiles(SHARES)):
        assert rank_miss(v, q, x) <= one.error(0.01)


def test_tables_and_combined_days(spark):
    df = spark.read.parquet(f"{SF}/pixel_scores.parquet").selectExpr("lower(trim(category)) category", "scored_on", "intensity").repartition(7)
    daily = sketches.sketch(df, ["category", "scored_on"], {"intensity": "intensity"}, k=64)
    out = sketches.percentiles(sketches.merge(daily, ["category"], k=64), ["category"], SHARES).collect()
    pdf = df.toPandas()
    assert len(out) == 6 * pdf.category.nunique()
    for r in out:
        v = pdf.intensity[pdf.category == r.category].dropna().to_numpy()
        v = v[np.isfinite(v)]
        assert r.n == len(v) and rank_miss(v, r.percentile / 100, r.value) <= r.rank_error


def test_small_groups_are_exact_and_dirt_is_left_out(spark):
    nan, inf = float("nan"), float("inf")
    rows = [("a", 1.0, 5), ("a", 3.0, 5), ("a", 2.0, None), ("a", nan, None), ("a", inf, None), ("a", None, None), (None, 7.0, 1), ("b", None, None)]
    df = spark.createDataFrame(rows, "g string, v double, measure int")
    got = sketches.percentiles(sketches.sketch(df, ["g"], {"v": "v", "m": "measure"}), ["g"], [0.0, 0.5, 1.0]).collect()
    assert {(r.g, r.measure, r.percentile): (r.value, r.n, r.rank_error) for r in got} == {
        ("a", "v", 0.0): (1.0, 3, 0.0), ("a", "v", 50.0): (2.0, 3, 0.0), ("a", "v", 100.0): (3.0, 3, 0.0),
        ("a", "m", 0.0): (5.0, 2, 0.0), ("a", "m", 50.0): (5.0, 2, 0.0), ("a", "m", 100.0): (5.0, 2, 0.0),
        (None, "v", 0.0): (7.0, 1, 0.0), (None, "v", 50.0): (7.0, 1, 0.0), (None, "v", 100.0): (7.0, 1, 0.0),
        (None, "m", 0.0): (1.0, 1, 0.0), (None, "m", 50.0): (1.0, 1, 0.0), (None, "m", 100.0): (1.0, 1, 0.0),
    }
    assert sketches.sketch(df.limit(0), ["g"], {"v": "v"}).count() == 0


def test_many_open_groups(spark):
    df = spark.range(5000).selectExpr("id % 1000 AS g", "cast(id AS double) AS v").repartition(2)
    got = sketches.percentiles(sketches.sketch(df, ["g"], {"v": "v"}, max_open=50), ["g"], [0.5]).collect()
    assert {r.g: (r.value, r.n) for r in got} == {g: (2000.0 + g, 5) for g in range(1000)}
