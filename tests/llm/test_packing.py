import random
import time

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from leafwork.llm.mixing import Tree, mix, permuted, quotas, split_tree
from leafwork.llm.packing import pack, successors
from leafwork.llm.tokens import token_count


def test_every_item_in_containers(spark):
    rng = random.Random(3)
    sizes = [(f"d{i}", rng.choice([7, 7, 7, 30, 90, 250])) for i in range(300)] + [("long", 250), ("exact", 100), ("none", None), ("zero", 0), ("less", -3), ("d#1", 40), ("d~1", 40), ("long", 250)]
    df = spark.createDataFrame([(k, s, "x") for k, s in sizes], "key string, size long, container string")
    rows = pack(df, 100).collect()
    got, fill = {}, {}
    for r in rows:
        got.setdefault(r.key, []).append((r.piece, r.size))
        if r.container is not None:
            fill[r.container] = fill.get(r.container, 0) + r.size
    assert {k: sum(s for _, s in v) for k, v in got.items()} == {k: max(s or 0, 0) for k, s in sizes}
    assert max(fill.values()) <= 100 and sorted(got["long"]) == [(0, 100), (1, 100), (2, 50)] and got["none"] == [(0, 0)]
    assert all(len(v) == 1 for k, v in got.items() if dict(sizes)[k] is None or dict(sizes)[k] <= 100)
    assert sum(fill.values()) > 0.95 * 100 * len(fill)
    assert pack(df.limit(0), 100).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 4), st.integers(0, 4)), max_size=6))
def test_runs_match_as_single_gaps(counts):
    stack, want = [], []
    for part, (items, gaps) in enumerate(counts):
        for i in range(items):
            if stack:
                want.append(((part, i), stack.pop()))
        stack += [(part, g) for g in reversed(range(gaps))]
    got = [((p, i), (q, g + i - lo)) for p, lo, hi, q, g in successors(dict(enumerate(counts))) for i in range(lo, hi + 1)]
    assert got == want


def test_splitting_tree():
    for blocks, shards in (([5, 0, 70], 4), ([1], 8), ([100, 33, 7, 1], 5)):
        tree = split_tree(blocks, shards, 1)
        assert tree.sum(axis=0).tolist() == blocks and np.ptp(tree.sum(axis=1)) <= 1 and tree.min() >= 0
    for n in (1, 2, 9, 64, 97, 5000):
        got = permuted(np.arange(n), np.full(n, n), np.full(n, 7))
        assert sorted(got.tolist()) == list(range(n))
    assert np.ptp(np.diff(got)) > 1  # no stride
    assert quotas({"a": 100, "b": 10, "x": 5}, {"a": (0.6, 1), "b": (0.2, 3), "c": (0.2, 9)}) == {"a": 90, "b": 30}
    assert quotas({}, {"a": (1.0, 1)}) == {} and quotas({"a": 4}, {"a": (0.0, 1)}) == {}


def test_lookup_is_the_tree():
    blocks, shards = [300_000, 41, 7_000], 20_000
    tree, whole = Tree(blocks, shards, 3), split_tree(blocks, shards, 3)
    source = np.repeat([0, 1, 2], blocks)
    at = tree.place(source, np.concatenate([np.arange(b) for b in blocks]))
    group = tree.group(source, at)
    shard = tree.shard(group, source, at)
    assert len(tree.nodes) <= 8192 and len(tree.nodes) < shards
    got = np.zeros_like(whole)
    np.add.at(got, (shard, source), 1)
    assert (got == whole).all()


def test_very_many_shards(spark):
    docs = spark.range(20_000).selectExpr("id AS key", "if(id % 3 = 0, 'a', 'b') AS source", "1 + id % 50 AS tokens")
    targets = spark.createDataFrame([("a", 0.5, 3), ("b", 0.5, 1)], "source string, target_share double, max_repeats int")
    began = time.time()
    selection, shares = mix(docs, targets, shards=100_000, blocks_per_shard=4)
    n, different = selection.selectExpr("count(*)", "count(DISTINCT key, repeat)").first()
    assert n == different == shares.selectExpr("sum(documents)").first()[0] + selection.where("repeat > 0").count() and n > 10_000
    assert time.time() - began < 60


def test_mix(spark):
    docs = [(i, "big" if i % 3 else "small", 1 + i % 17, 0) for i in range(900)] + [(5000, None, 4, 0), (5001, "other", 9, 0), (5002, "big", 0, 0), (5003, "big", None, 0), (1, "big", 2, 0)]
    df = spark.createDataFrame(docs, "key long, source string, tokens long, shard int")
    targets = spark.createDataFrame([("big", 0.5, 1), ("small", 0.4, 3), ("absent", 0.1, 2), (None, 0.3, 1)], "source string, target_share double, max_repeats int")
    selection, shares = mix(df, targets, shards=4)
    rows = selection.collect()
    of = {s: sum(r.tokens for r in rows if r.source == s) for s in ("big", "small")}
    total = sum(of.values())
    assert abs(of["big"] / total - 5 / 9) < 0.005 and abs(of["small"] / total - 4 / 9) < 0.005
    assert len({(r.key, r["repeat"]) for r in rows}) == len(rows) and max(r["repeat"] for r in rows if r.source == "small") <= 2 and max(r["repeat"] for r in rows if r.source == "big") == 0
    for s in range(4):
        assert sorted(r.position for r in rows if r.shard == s) == list(range(1, 1 + sum(r.shard == s for r in rows)))
    got = {r.source: (r.documents, r.most_repeats) for r in shares.collect()}
    assert got["absent"] == (0, 0) and got["big"][1] == 1 and set(got) == {"big", "small", "absent"}
    for a, b in ((df.limit(0), targets), (df, targets.limit(0))):
        assert mix(a, b)[0].count() == 0


def test_tokens_of_whole_texts(spark):
    df = spark.createDataFrame([("",), (None,), ("le vers",), ("mot " * 50_000,)], "t string")
    assert [r.n for r in df.where("t IS NULL OR t = ''").select(token_count(df.t).alias("n")).collect()] == [0, 0]
    one, two = (r.n for r in df.where("length(t) > 1").select(token_count(df.t).alias("n")).collect())
    assert 2 <= min(one, two) <= 4 and max(one, two) >= 50_000
