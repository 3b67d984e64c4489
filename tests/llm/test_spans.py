import random
from difflib import SequenceMatcher

import numpy as np
import pytest

from patchmill.llm import spans
from patchmill.llm.spans import Spans

SF = "/root/testdata/sf0.01"


def text(seed, n, letters="abcdefgh {};\n"):
    return "".join(random.Random(seed).choices(letters, k=n))


def slow_pairs(docs, least):
    where = {}
    for d, t in docs:
        for i in range(len(t or "") - least + 1):
            where.setdefault(hash(t[i : i + least]), set()).add(d)
    return {(a, b) for s in set(map(frozenset, where.values())) for a in s for b in s if a < b}


def pairs(df, **kw):
    return {(r.doc_id_a, r.doc_id_b) for r in Spans(df, **kw).pairs().collect()}


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_whole_table_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = slow_pairs([tuple(r) for r in docs.select("doc_id", "text").collect()], 400)
    assert want and pairs(docs) == want


@pytest.mark.parametrize("n, found", [(399, False), (400, True), (401, True), (5000, True)])
@pytest.mark.parametrize("letters", ["abcdefgh {};\n", "aé漢😀\r\n"])
def test_lengths(spark, n, found, letters):
    same = text(1, n, letters)
    rows = [(1, text(2, 333, letters) + "<" + same + ">" + text(3, 77, letters)), (2, text(4, 911, letters) + "[" + same + "]")]
    s = Spans(frame(spark, rows))
    assert pairs(frame(spark, rows)) == ({(1, 2)} if found else set())
    assert [tuple(r) for r in s.spans().collect()] == ([(1, 334, 2, 912, n)] if found else [])
    assert {r.doc_id: r.shared_chars for r in s.shares().collect()} == ({1: n, 2: n} if found else {})


def test_nulls_empty_short_repeated_and_clashing_columns(spark):
    same = text(5, 450)
    rows = [(1, same, "x", 0), (1, same, "x", 0), (2, same, "x", 0), (3, None, "x", 0), (None, same, "x", 0), (4, "", "x", 0), (5, same[:399], "x", 0), (6, "#" + same, "x", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, k string, d int")
    assert pairs(df) == {(1, 2), (1, 6), (2, 6)}
    s = Spans(df)
    assert {(r.doc_id, r.rep) for r in s.members().collect()} == {(1, 1), (2, 1)}
    assert {r.doc_id: (r.n_chars, r.shared_chars) for r in s.shares().collect()} == {1: (450, 450), 2: (450, 450), 6: (451, 450)}
    assert pairs(df.limit(0)) == set()


def test_texts_that_repeat_within_themselves(spark):
    line = text(7, 150)
    rows = [(1, "0," * 3000), (2, "x" + "0," * 900 + "y"), (3, line * 40), (4, "z" + line * 9), (5, "," * 5000), (6, "ab" + "," * 430)]
    assert pairs(frame(spark, rows)) == {(1, 2), (3, 4), (5, 6)}
    shared = {r.doc_id: r.shared_chars for r in Spans(frame(spark, rows)).shares().collect()}
    assert shared[2] in (1800, 1801) and shared[4] == 1350 and shared[6] == 430 and shared[5] == 5000 and shared[3] == 6000


def test_short_notice_in_very_many_texts(spark, monkeypatch):
    """A run of 399 characters in all texts names no pair; longer ones inside the crowd are still found."""
    notice, longer = text(20, 399), text(21, 30)
    rows = [(i, text(100 + i, 50 + i) + chr(20000 + i) + notice + chr(30000 + i) + text(900 + i, 80)) for i in range(90)]
    rows += [(1000 + i, text(2000 + i, 40) + chr(22000 + i) + notice + longer + chr(32000 + i)) for i in range(5)]
    named = []
    paired = spans._pairs
    monkeypatch.setattr(spans, "_pairs", lambda df, key: (named.append(paired(df, key)), named[-1])[1])
    want = {(1000 + i, 1000 + j) for i in range(5) for j in range(i + 1, 5)}
    assert pairs(frame(spark, rows)) == want == slow_pairs(rows, 400)
    assert sum(d.count() for d in named) < 90 * 89 / 2 / 4  # windows at the notice's ends are rarer and name some


@pytest.mark.parametrize("hot", [1, 3])
def test_very_common_windows_change_no_result(spark, monkeypatch, hot):
    """With nearly every window taken as very common, pairs and shares stay."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(i, text(i % 7, 60, "ab") + text(50 + i % 3, 40, "ab") + text(i, 20, "ab")) for i in range(30)]
    want = [(pairs(docs), {r.doc_id: r.shared_chars for r in Spans(docs).shares().collect()}), (pairs(frame(spark, rows), least=12), {r.doc_id: r.shared_chars for r in Spans(frame(spark, rows), least=12).shares().collect()})]
    monkeypatch.setattr(spans, "HOT", hot)
    got = [(pairs(docs), {r.doc_id: r.shared_chars for r in Spans(docs).shares().collect()}), (pairs(frame(spark, rows), least=12), {r.doc_id: r.shared_chars for r in Spans(frame(spark, rows), least=12).shares().collect()})]
    assert got == want


def test_long_text_in_segments(spark):
    big = text(8, 3 * spans.SEGMENT + 17)
    for at in (spans.SEGMENT - 200, spans.SEGMENT - 399, spans.SEGMENT - 1, 2 * spans.SEGMENT - 798):
        assert pairs(frame(spark, [(1, big), (2, "#" + big[at : at + 400] + "#")])) == {(1, 2)}


def test_small_lengths_against_brute_force(spark):
    rng = random.Random(9)
    for least in (6, 12):
        rows = [(i, text(rng.random(), rng.randrange(0, 60), "ab")) for i in range(25)]
        assert pairs(frame(spark, rows), least=least) == slow_pairs(rows, least)


def test_maximal_repeat_is_the_longest_match():
    a, b = (spans._codes(text(s, 300) + text(99, 120) + text(s + 10, 50)) for s in (1, 2))
    roller = spans.Roller(20, 40)
    got = spans.shared(a, b, roller.all_windows(a), roller.all_windows(b), 40, 20)
    m = SequenceMatcher(None, a.tolist(), b.tolist(), autojunk=False).find_longest_match()
    assert got == {(m.a, m.b, m.size)}
    assert np.array_equal(a[m.a : m.a + m.size], b[m.b : m.b + m.size])
