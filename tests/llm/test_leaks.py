import re
from collections import defaultdict

import numpy as np
import pytest

from patchmill.llm import leaks

SF = "/root/testdata/sf0.01"


def slow_words(text):
    return re.findall(r"[a-z0-9_]+", re.sub(r"\\+.?", " ", text, flags=re.S).lower())


def slow(docs, items, k=8):
    index = defaultdict(set)
    of = {i: slow_words(t) for i, t in items if t is not None}
    for i, w in of.items():
        for p in range(len(w) - k + 1):
            index[tuple(w[p : p + k])].add((i, p))
    out = {}
    for d, t in docs:
        w = slow_words(t or "")
        covered = defaultdict(set)
        for p in range(len(w) - k + 1):
            for i, s in index.get(tuple(w[p : p + k]), ()):
                covered[i].update(range(s, s + k))
        for i, c in covered.items():
            if 2 * len(c) >= len(of[i]):
                out[d, i] = len(c)
    return out


def found(df):
    return {(r.doc_id, r.item_id): r.covered_words for r in df.collect()}


def test_whole_tables_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = spark.read.parquet(f"{SF}/eval_items.parquet")
    want = slow([tuple(r) for r in docs.select("doc_id", "text").collect()], [tuple(r) for r in items.select("item_id", "text").collect()])
    assert want and found(leaks.leaked_pairs(docs, items)) == want
    # small blocks and shards change nothing
    assert found(leaks.leaked_pairs(docs, items, block_bytes=20_000, shard_bytes=30_000)) == want


ITEM = "one two three four five six seven eight nine ten eleven twelve"


@pytest.mark.parametrize(
    "text, covered",
    [
        (ITEM.upper().replace(" ", "\r\n# "), 12),
        (ITEM.replace(" ", "\\n"), 12),
        (ITEM.replace(" ", "\\\\t"), 12),
        ("x " + " ".join(ITEM.split()[:8]) + " y", 8),
        (" ".join(ITEM.split()[:7]), 0),
        (" ".join(ITEM.split()[:8]) + " z " + " ".join(ITEM.split()[3:]), 12),
        (ITEM[1:], 11),
        ("é" + ITEM + "é", 12),
        ("", 0),
        (None, 0),
        ((ITEM + " ") * 5000, 12),
        ("q" * 300_000 + " " + ITEM, 12),
    ],
)
def test_cases(spark, text, covered):
    docs = spark.createDataFrame([(1, text, "x"), (1, text, "x"), (None, ITEM, "x")], "doc_id long, text string, item_id string")
    items = spark.createDataFrame([(5, ITEM, 1), (5, ITEM, 1), (6, "too short", 1), (7, None, 1), (None, ITEM, 1)], "item_id long, text string, doc_id long")
    assert found(leaks.leaked_pairs(docs, items)) == ({(1, 5): covered} if covered else {})


def test_texts_do_not_run_into_each_other(spark):
    a, b = ITEM[: ITEM.index("seven") + 2], ITEM[ITEM.index("seven") + 2 :]
    docs = spark.createDataFrame([(1, a + "\\"), (2, b)], "doc_id long, text string").coalesce(1)
    items = spark.createDataFrame([(5, ITEM)], "item_id long, text string")
    assert found(leaks.leaked_pairs(docs, items)) == {}


def test_repeated_words(spark):
    docs = spark.createDataFrame([(1, "0 " * 50_000), (2, "0 " * 8)], "doc_id long, text string")
    items = spark.createDataFrame([(5, "0, " * 40), (6, "0 " * 16)], "item_id long, text string")
    assert found(leaks.leaked_pairs(docs, items)) == {(1, 5): 40, (1, 6): 16, (2, 5): 40, (2, 6): 16}


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(5, ITEM)], "item_id long, text string")
    assert leaks.leaked_pairs(docs, items).count() == 0
    assert leaks.leaked_pairs(items.toDF("doc_id", "text"), docs.toDF("item_id", "text")).count() == 0


def test_longest_and_removal(spark):
    w = ITEM.split()
    docs = spark.createDataFrame([(1, " ".join(w[:9])), (2, " ".join(w[2:])), (3, "none"), (None, "kept")], "doc_id long, text string")
    items = spark.createDataFrame([(5, ITEM)], "item_id long, text string")
    assert [tuple(r) for r in leaks.longest_matches(docs, items).collect()] == [(5, 12, 2, 10, 2)]
    left = leaks.without_leaks(docs, leaks.leaked_pairs(docs, items))
    assert {r.doc_id for r in left.collect()} == {3, None}


def test_suffix_array():
    rng = np.random.default_rng(3)
    for n in (1, 2, 7, 60):
        ids = rng.integers(0, 3, n)
        assert leaks.suffix_array(ids).tolist() == sorted(range(n), key=lambda i: ids[i:].tolist())


@pytest.mark.parametrize("ids", [(7, 3, 9), (3, 9, 7), (9, 7, 3)])
def test_longest_names_the_lowest_document_whatever_follows(spark, ids):
    w = ITEM.split()
    follows = [w[0], w[5], w[9]]  # words of the item, so that the suffixes are sorted by them
    docs = spark.createDataFrame([(i, " ".join([*w[:10], f])) for i, f in zip(ids, follows)], "doc_id long, text string").coalesce(1)
    items = spark.createDataFrame([(5, ITEM)], "item_id long, text string")
    assert [tuple(r) for r in leaks.longest_matches(docs, items).collect()] == [(5, 12, 0, 10, 3)]


@pytest.mark.parametrize("pass_bytes, scans", [(1 << 20, 1), (400, 3)])  # 1,080 characters, a pass ends beyond 300
def test_blocks_of_items_meet_the_corpus_in_one_pass(spark, monkeypatch, pass_bytes, scans):
    monkeypatch.setattr(leaks, "PASS_BYTES", pass_bytes)
    monkeypatch.setattr(leaks, "HELD_BYTES", 50)
    texts = {i: " ".join(f"w{i}_{j}" for j in range(10)) for i in range(20)}
    docs = spark.createDataFrame([(i, t + " x") for i, t in texts.items()], "doc_id long, text string").repartition(2)
    items = spark.createDataFrame(list(texts.items()), "item_id long, text string")
    got = leaks.leaked_pairs(docs, items, block_bytes=100)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == scans
    assert found(got) == {(i, i): 10 for i in texts}
