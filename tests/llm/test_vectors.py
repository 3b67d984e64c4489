import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from patchmill.llm import vectors

SF = "/root/testdata/sf0.01"
SCHEMA = "g string, vec_id long, v array<float>, id int, neighbour string"


def brute(rows, k, max_distance=None):
    """{(g, id): [(distance, neighbour)]} over usable rows."""
    groups = {}
    for g, i, v, *_ in rows:
        if g is not None and i is not None and v is not None and len(v) == 8 and None not in v and np.isfinite(v).all() and any(v):
            groups.setdefault(g, {})[i] = np.array(v, np.float32).astype(float)
    out = {}
    for g, by in groups.items():
        ids = np.array(sorted(by))
        x = np.stack([by[i] for i in ids])
        for i, v in zip(ids, x):
            d = np.sqrt(((x - v) ** 2).sum(1))
            near = sorted((float(dd), int(j)) for dd, j in zip(d, ids) if j != i and (max_distance is None or dd <= max_distance))[:k]
            if near:
                out[g, int(i)] = near
    return out


def search(df, **kw):
    out = {}
    for r in vectors.similar(df, ["g"], vec_id="vec_id", vector="v", dim=8, **kw).collect():
        out.setdefault((r.g, r.id), []).append((r.distance, r.neighbour))
    return {k: sorted(v) for k, v in out.items()}


def same(a, b):
    assert a.keys() == b.keys()
    for k in a:
        assert [n for _, n in a[k]] == [n for _, n in b[k]], k
        assert np.allclose([d for d, _ in a[k]], [d for d, _ in b[k]], atol=1e-6)


def clustered(seed, n, g="a"):
    rng = np.random.default_rng(seed)
    centre = rng.normal(0, 4, (max(1, n // 20), 8))
    x = centre[rng.integers(len(centre), size=n)] + rng.normal(0, 0.3, (n, 8))
    return [(g, i, [float(a) for a in v], 0, "x") for i, v in enumerate(x)]


@pytest.mark.parametrize("shard", [50_000, 150])
def test_radius_search_is_exact(spark, shard):
    rows = clustered(1, 1500) + clustered(2, 90, "b") + clustered(3, 1, "c")
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    same(search(df, k=4, max_distance=0.9, cells=10_000, shard=shard), brute(rows, 4, 0.9))


def test_all_cells_give_exact_neighbours(spark):
    rows = clustered(4, 700)
    df = spark.createDataFrame(rows, SCHEMA)
    same(search(df, k=3, cells=10_000, shard=100), brute(rows, 3))
    some = search(df, k=3, cells=10_000, queries=lambda i: i % 100 == 0)
    same(some, {k: v for k, v in brute(rows, 3).items() if k[1] % 100 == 0})


def test_dirt(spark):
    nan, inf = float("nan"), float("inf")
    one = [1.0] * 8
    rows = [
        ("a", 1, one, 0, "x"), ("a", 1, one, 0, "x"), ("a", 2, [1.0] * 7 + [1.5], 0, "x"), ("a", 3, one, 0, "x"), ("a", 4, None, 0, "x"), ("a", 5, [1.0] * 7, 0, "x"),
        ("a", 6, [1.0] * 7 + [nan], 0, "x"), ("a", 7, [1.0] * 7 + [-inf], 0, "x"), ("a", 8, [0.0] * 8, 0, "x"), ("a", 9, [1.0] * 7 + [None], 0, "x"), ("a", None, one, 0, "x"), (None, 10, one, 0, "x"), ("b", 11, one, 0, "x"),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    same(search(df, k=5), {("a", 1): [(0.0, 3), (0.5, 2)], ("a", 2): [(0.5, 1), (0.5, 3)], ("a", 3): [(0.0, 1), (0.5, 2)]})
    assert search(df.limit(0), k=5) == {} and search(df.where("vec_id = 8"), k=5) == {}


def test_a_third_of_the_rows_are_one_vector(spark):
    rows = clustered(5, 400) + [("a", 1000 + i, [2.0] * 8, 0, "x") for i in range(200)] + [("a", 5000, [2.0] * 7 + [2.1], 0, "x")]
    df = spark.createDataFrame(rows, SCHEMA)
    same(search(df, k=3, max_distance=0.9, cells=10_000, shard=60), brute(rows, 3, 0.9))
    pairs = vectors.similar_pairs(vectors.similar(df.where("vec_id >= 1000"), ["g"], vec_id="vec_id", vector="v", dim=8, k=1), ["g"])
    assert {(r.id_a, r.id_b) for r in pairs.collect()} == {(1000, 1000 + i) for i in range(1, 200)} | {(1000, 5000)}


def test_recall_on_the_bank(spark):
    """Plain nearest neighbours, without a radius, with the parameters of p1_neighbours."""
    bank = spark.read.parquet("/root/testdata/sf0.1/prototype_embeddings.parquet").where("category = 'can' and layer = 23").select("layer", "proto_id", "embedding").where(vectors.usable("embedding", 32)).dropDuplicates(["proto_id"])
    got = vectors.similar(bank, ["layer"], vec_id="proto_id", vector="embedding", dim=32, k=5).groupBy("id").agg(F.collect_set("neighbour").alias("n"))
    got = {r.id: set(r.n) for r in got.collect()}
    pdf = bank.toPandas()
    x, ids = np.stack(pdf.embedding).astype(float), pdf.proto_id.to_numpy()
    d = (x * x).sum(1)[:, None] + (x * x).sum(1) - 2 * x @ x.T
    np.fill_diagonal(d, np.inf)
    want = {int(i): {int(j) for j in ids[o[:5]]} for i, o in zip(ids, d.argsort(1))}
    recall = sum(len(want[i] & got[i]) for i in want) / sum(map(len, want.values()))
    assert recall >= 0.9


def index_of(x, n, cells=None, recall=vectors.RECALL, max_distance=None, shard=50_000, k=5):
    """A planned index of x with codebooks as a collection of n vectors gets."""
    index = vectors.Index(x[: vectors.SAMPLE], n, 7)
    cell = index.cell(x)
    p = index.probe
    d = ((p[:, None] - x) ** 2).sum(-1)
    d[np.arange(len(p)), np.arange(len(p))] = np.inf
    near = np.argpartition(d, k, axis=1)[:, :k]
    index.plan(np.bincount(cell, minlength=index.k**2), shard, k, recall, max_distance, cell[near].ravel(), np.repeat(np.arange(len(p)), k), x[: vectors.SAMPLE], cells)
    return index, cell


def test_cells_are_visited_in_order():
    rng = np.random.default_rng(0)
    index, _ = index_of(rng.normal(size=(500, 6)).astype(np.float32), 500, cells=15, shard=100)
    x = rng.normal(size=(20, 6)).astype(np.float32)
    d1, d2 = index.distances(x)
    q, cell = index.visit(x, None)
    full = index.count > 0
    for i in range(20):
        mine = cell[q == i]
        total = (d1[i][:, None] + d2[i]).ravel()
        want = np.sort(total[full])[:15]
        assert np.allclose(total[mine], want) and len(set(mine)) == len(want)


def held(index, cell, x, step=10):
    """Share of the 5 nearest of each step-th vector that the visited cells hold."""
    q = np.arange(0, len(x), step)
    d = (x[q] ** 2).sum(1)[:, None] + (x**2).sum(1) - 2 * x[q] @ x.T
    d[np.arange(len(q)), q] = np.inf
    near = np.argpartition(d, 5, axis=1)[:, :5]
    who, seen = index.visit(x[q], None)
    order = np.argsort(who, kind="stable")
    who, seen = who[order], seen[order]
    cut = np.searchsorted(who, np.arange(len(q) + 1))
    return np.mean([np.isin(cell[near[i]], seen[cut[i] : cut[i + 1]]).mean() for i in range(len(q))])


@pytest.mark.parametrize("n", [1 << 15, 1 << 17, 1 << 19])
def test_recall_keeps_up_with_the_codebooks(n):
    """Codebooks of 64, 128 and 256, as collections of n vectors get, forced on a collection of about 1,900."""
    pdf = pq.read_table("/root/testdata/sf0.1/prototype_embeddings.parquet", columns=["category", "layer", "proto_id", "embedding"]).to_pandas().drop_duplicates("proto_id")
    pdf = pdf[(pdf.category.str.strip().str.lower() == "sheet_metal") & (pdf.layer == 7)]
    x = np.stack([v for v in pdf.embedding if v is not None and len(v) == 32]).astype(np.float32)
    x = x[np.isfinite(x).all(1) & (x != 0).any(1)]
    index, cell = index_of(x, n)
    assert index.cells < (index.count > 0).sum() < index.k**2
    assert held(index, cell, x) >= 0.9


@pytest.mark.parametrize("spread", [0.05, 0.5, None])
def test_recall_on_a_large_collection(spread):
    """Tight clusters, loose ones and none: 120,000 vectors."""
    rng = np.random.default_rng(4)
    x = rng.normal(0, 1, (120_000, 16))
    if spread:
        x = rng.normal(0, 1, (3000, 16))[rng.integers(3000, size=len(x))] + spread * x
    x = x.astype(np.float32)
    index, cell = index_of(x, len(x))
    assert index.k == 128 and index.cells < index.k**2
    assert held(index, cell, x, 400) >= 0.9


@pytest.mark.parametrize("n", [10**6, 2 * 10**8, 10**9])
@pytest.mark.parametrize("skew", [False, True])
def test_shards_are_of_bounded_size(n, skew):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(2048, 8)).astype(np.float32)
    if skew:
        x[:700] = x[0] + 0.01 * x[:700]
    index = vectors.Index(x, n, 7)
    seen = np.bincount(index.cell(x), minlength=index.k**2) * (0.9 * n / len(x))
    rest = rng.random(index.k**2) ** 4  # most vectors are in no sampled cell
    count = (seen + 0.1 * n * rest / rest.sum()).astype(np.int64)
    index.plan(count, 50_000, 5, 0.95, None, index.cell(x[:320]), np.repeat(np.arange(64), 5), x, 64)
    large = index.split > 1
    load = np.bincount(index.shard[~large], weights=count[~large])
    assert load.max() <= 2 * 50_000 and (count / index.split).max() <= 50_000
    assert not set(index.shard[~large & (count > 0)]) & {s + i for s, p in zip(index.shard[large], index.split[large]) for i in range(p)}


def test_models_may_be_shuffled_to_their_rows(spark):
    rows = clustered(1, 1500) + clustered(2, 90, "b") + clustered(3, 1, "c")
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    same(search(df, k=4, max_distance=0.9, shard=150, model_bytes=0), brute(rows, 4, 0.9))
    same(search(df, k=4, recall=1, model_bytes=0), brute(rows, 4))


def test_a_shard_with_many_queries_comes_in_copies(spark, monkeypatch):
    monkeypatch.setattr(vectors, "QUERIES", 0.2)
    rows = clustered(6, 800)
    same(search(spark.createDataFrame(rows, SCHEMA), k=3, recall=1, shard=100), brute(rows, 3))


def test_near_equal_centroids_lose_nothing(spark):
    rng = np.random.default_rng(8)
    half = rng.normal(0, 1, (10, 4))
    x = np.concatenate([half[rng.integers(10, size=600)] + rng.normal(0, 1e-6, (600, 4)), rng.normal(0, 0.3, (600, 4))], axis=1) + 50
    rows = [("a", i, [float(a) for a in v], 0, "x") for i, v in enumerate(x.astype(np.float32))]
    same(search(spark.createDataFrame(rows, SCHEMA), k=3, max_distance=0.4, shard=100), brute(rows, 3, 0.4))
