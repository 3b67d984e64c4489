from collections import Counter

import numpy as np
import pytest

from patchmill.llm import mixing


def letters(texts):
    return [[ord(c) for c in t] for t in texts]


def mix(spark, docs, targets, **kw):
    d = spark.createDataFrame(docs, "doc_id long, source string, text string, n long, block int")
    t = spark.createDataFrame(targets, "source string, target_share double, max_repeats int, n long")
    return mixing.Mix(d, t, letters, **kw)


def corpus():
    rng = np.random.default_rng(1)
    out = []
    for i in range(900):
        s = ["big", "Big-One", "small"][0 if i < 600 else 1 if i < 870 else 2]
        out.append((i, s, "".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(1, 90))), 0, 0))
    return out


TARGETS = [("big", 0.5, 1, 0), ("big_one", 0.3, 1, 0), (" SMALL ", 0.2, 4, 0), ("gone", 0.0, 1, 0)]


def test_shares_and_limits(spark):
    docs = corpus()
    m = mix(spark, docs, TARGETS, block=16, shard=64)
    got = {r.source: r for r in m.shares().collect()}
    assert set(got) == {"big", "big_one", "small"}
    for s, p, most in (("big", 0.5, 1), ("big_one", 0.3, 1), ("small", 0.2, 4)):
        assert abs(got[s].share - p) < 0.07 and 1 <= got[s].most_uses <= most
    assert sum(r.used_tokens for r in got.values()) > 0.5 * 4 * got["small"].n_tokens / 0.2
    uses = {r.doc_id: r for r in m.record_uses().collect()}
    assert {d: len(t) for d, _, t, *_ in docs} == {d: r.n_tokens for d, r in uses.items()}
    assert sum(r.used_tokens for r in uses.values()) == sum(r.used_tokens for r in got.values())


def test_slots_blocks_and_tokens(spark):
    docs = corpus()
    m = mix(spark, docs, TARGETS, block=16, shard=64)
    rows = m.mixed().collect()
    assert len(rows) == m.slots == len({(r.shard, r.slot) for r in rows})
    assert {(r.shard, r.slot) for r in rows} == {(i // 64, i % 64) for i in range(m.slots)}
    text = {d: t for d, _, t, *_ in docs}
    blocks = {(r.source, r.block): "".join(map(chr, r.tokens)) for r in m.token_blocks().collect()}
    for r in rows:
        assert "".join(text[p.doc_id][p.first : p.last] for p in r.pieces) == blocks[r.source, r.block] and len(blocks[r.source, r.block]) == r.n_tokens
    # every token of every record lies in one block
    assert Counter("".join(blocks.values())) == Counter("".join(text.values()))
    assert all(len(t) == 16 for (s, b), t in blocks.items() if b < max(k[1] for k in blocks if k[0] == s))
    # each use of a source is a permutation: no block twice in one use
    assert max(Counter((r.source, r.block, r.use) for r in rows).values()) == 1
    again = mix(spark, docs[::-1], TARGETS, block=16, shard=64)
    assert {(r.shard, r.slot, r.source, r.block, r.use) for r in again.assignments().collect()} == {(r.shard, r.slot, r.source, r.block, r.use) for r in rows}


def test_dirt(spark):
    docs = [(1, "A b", "x" * 5000, 0, 0), (1, "A b", "x" * 5000, 0, 0), (2, "a-b", None, 0, 0), (3, "a_b", "", 0, 0), (None, "a_b", "yy", 0, 0), (4, None, "zz", 0, 0), (5, "other", "zz", 0, 0)]
    m = mix(spark, docs, [("a b", 0.5, 2, 0), ("gone", 0.5, 9, 0), (None, 1.0, 1, 0), ("a_b", None, 1, 0)], block=100)
    got = {r.source: r for r in m.shares().collect()}
    assert got["a_b"].n_tokens == 5000 and got["a_b"].used_tokens == 10000 and got["a_b"].most_uses == 2 and got["a_b"].share == 1.0
    assert got["gone"].used_tokens == 0 and got["gone"].share == 0.0
    assert m.slots == 100 and m.mixed().count() == 100
    for docs_, targets in (([], TARGETS), (corpus(), []), (docs, [("other", 1.0, 1, 0), ("a_b", 1e-9, 1, 0)])):
        e = mix(spark, docs_, targets)
        assert e.mixed().count() == e.slots <= 1 and e.shares().count() == (3 if targets is TARGETS else len(targets))


def test_slots_beyond_a_limit_go_elsewhere(spark):
    docs = [(i, ["a", "b", "c"][i % 3], "x" * 10, 0, 0) for i in range(900)]
    for seed in range(4):
        m = mix(spark, docs, [("a", 0.4, 1, 0), ("b", 0.3, 1, 0), ("c", 0.3, 1, 0)], block=10, shard=50, seed=seed)
        got = m.assignments().collect()
        n = Counter(r.source for r in got)
        assert m.slots == len(got) == 750 and max(n.values()) <= 300 and min(n.values()) > 150
        assert len({(r.source, r.block) for r in got}) == 750 and {r.use for r in got} == {0}
    assert mixing.Mix._give(7, np.array([0, 3, 100]), np.array([0.5, 0.4, 0.1])).tolist() == [0, 3, 4]


@pytest.mark.parametrize("n", [1, 2, 3, 64, 1000])
def test_permutations(n):
    seen = [tuple(mixing.permute(np.arange(n), n, seed)) for seed in range(5)]
    assert all(sorted(p) == list(range(n)) for p in seen)
    assert n < 64 or len(set(seen)) == 5


def test_public_tokenizer_round_trip():
    t = mixing.RankTokenizer("/opt/tokenizers/byte_bpe_50k.tiktoken")
    texts = ["def f(x):\n    return x\r\n", "<|endoftext|>", "é漢", "a" * 3000]
    ids = t(texts)
    assert [mixing._loaded[t.key].decode(i) for i in ids] == texts


def test_slots_and_blocks_are_joined_by_a_shuffle(spark):
    p = mix(spark, corpus(), TARGETS, block=64, shard=50).mixed()._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=merge" in p
