"""Records of several sources mixed to target weights.

Quotas of the sources, in blocks, are split exactly among the output shards by
a tree of multivariate hypergeometric draws; each shard takes disjoint blocks
of each source's permuted records and is shuffled on its own.
"""

from __future__ import annotations

from functools import lru_cache
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType
from pyspark.sql.window import WindowSpec

from leafwork.session import cut

_SHARD_TOKENS = 20_000_000
#: Documents of a hash bucket, about: what one task orders.
_BUCKET_ROWS = 500_000
#: Parts of the tree that the driver splits; each part's shards are split where they are needed.
_GROUPS = 4096
#: Blocks of all sources, at most: a draw cannot take more.
_MOST_BLOCKS = 900_000_000


def quotas(tokens: dict[str, int], targets: dict[str, tuple[float, int]]) -> dict[str, int]:
    """Tokens to take of each source: the largest total at which all sources that have any reach their share.

    A target without tokens cannot be reached, and the others share the whole
    in their proportions. No source gives more than its tokens times its
    repeats.
    """
    have = {s: (share, max(1, repeats)) for s, (share, repeats) in targets.items() if share > 0 and tokens.get(s, 0) > 0}
    if not have:
        return {}
    whole = sum(share for share, _ in have.values())
    total = min(tokens[s] * repeats / (share / whole) for s, (share, repeats) in have.items())
    return {s: int(total * share / whole) for s, (share, _) in have.items()}


def _halves(lo: int, hi: int, quota: np.ndarray, shards: int, total: int, seed: int) -> tuple[np.ndarray, int]:
    """Blocks of each source that go to the left half of the shards ``lo`` to ``hi``, and where the right half begins; the same wherever it is drawn."""
    mid = (lo + hi) // 2
    size = total * mid // shards - total * lo // shards
    rng = np.random.default_rng([seed, lo, hi])
    return rng.multivariate_hypergeometric(quota, size, method="marginals") if quota.sum() else quota, mid


def _split(lo: int, hi: int, quota: np.ndarray, shards: int, total: int, seed: int, leaf: int) -> list[tuple[int, int, np.ndarray]]:
    """The nodes of at most ``leaf`` shards below a node, in order."""
    out, todo = [], [(lo, hi, quota)]
    while todo:
        lo, hi, quota = todo.pop()
        if hi - lo <= leaf:
            out.append((lo, hi, quota))
            continue
        left, mid = _halves(lo, hi, quota, shards, total, seed)
        todo += [(mid, hi, quota - left), (lo, mid, left)]
    return out


def split_tree(blocks: list[int], shards: int, seed: int) -> np.ndarray:
    """shards x sources: how many blocks of each source a shard gets; columns sum to ``blocks``, rows differ by one at most."""
    quota = np.array(blocks, dtype=np.int64)
    return np.array([q for _, _, q in _split(0, shards, quota, shards, int(quota.sum()), seed, 1)], dtype=np.int64).reshape(shards, len(blocks))


def permuted(numbers: np.ndarray, sizes: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Each number's place in a random permutation of 0 to its size, one permutation for each key.

    Four Feistel rounds over the even number of bits that hold the size; a
    place beyond the size is permuted again until it is inside.
    """
    bits = np.ceil(np.log2(np.maximum(sizes, 2)) / 2).astype(np.uint64)
    mask = (np.uint64(1) << bits) - np.uint64(1)
    out, todo = numbers.astype(np.uint64), np.ones(len(numbers), dtype=bool)
    with np.errstate(over="ignore"):
        while todo.any():
            b, m, k, x = bits[todo], mask[todo], keys.astype(np.uint64)[todo], out[todo]
            left, right = x >> b, x & m
            for turn in range(4):
                h = (right + k) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(turn + 1)
                h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
                left, right = right, left ^ ((h ^ (h >> np.uint64(29))) & m)
            out[todo] = (left << b) | right
            todo = out >= sizes.astype(np.uint64)
    return out.astype(np.int64)


class Tree:
    """Which shard takes a block of a source: the driver's part of the tree is sent, the rest is drawn on demand."""

    def __init__(self, blocks: list[int], shards: int, seed: int):
        self.blocks, self.shards, self.seed = np.array(blocks, dtype=np.int64), shards, seed
        self.total = int(self.blocks.sum())
        self.nodes = _split(0, shards, self.blocks, shards, self.total, seed, max(1, ceil(shards / _GROUPS)))
        self.ends = np.cumsum([q for _, _, q in self.nodes], axis=0)  # groups x sources

    def place(self, source: np.ndarray, number: np.ndarray) -> np.ndarray:
        return permuted(number, self.blocks[source], self.seed * 1000 + source)

    def group(self, source: np.ndarray, at: np.ndarray) -> np.ndarray:
        out = np.zeros(len(at), dtype=np.int64)
        for j in np.unique(source):
            out[source == j] = np.searchsorted(self.ends[:, j], at[source == j], side="right")
        return out

    def shard(self, group: np.ndarray, source: np.ndarray, at: np.ndarray) -> np.ndarray:
        out = np.zeros(len(at), dtype=np.int64)
        for g in np.unique(group):
            lo, _, quota = self.nodes[g]
            mine = np.flatnonzero(group == g)
            ends = self._below(int(g))
            for j in np.unique(source[mine]):
                rows = mine[source[mine] == j]
                out[rows] = lo + np.searchsorted(ends[:, j], at[rows] - (self.ends[g, j] - quota[j]), side="right")
        return out

    @lru_cache(maxsize=64)  # noqa: B019
    def _below(self, g: int) -> np.ndarray:
        lo, hi, quota = self.nodes[g]
        return np.cumsum([q for _, _, q in _split(lo, hi, quota, self.shards, self.total, self.seed, 1)], axis=0)


def mix(docs: DataFrame, targets: DataFrame, shards: int | None = None, blocks_per_shard: int = 64, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """(selection, shares).

    There are ``shards`` output shards, or one for every 20 million tokens and
    at least 16. ``docs`` has key (unique), source and tokens, ``targets`` has source,
    target_share and max_repeats. The selection has key, source, repeat, tokens,
    shard and position: a row for each time a document is taken, ``repeat``
    counting from 0. Of each source documents are taken in a permuted order,
    whole passes first, until its quota is met to half a document. shares has a
    row for each target: source, target_share, tokens, documents, reached_share
    and most_repeats.

    A source without target gives nothing; a target without documents, with
    null or no share, or null source reaches 0; documents with null source or
    no tokens are not taken; of repeated keys one row counts; with empty tables
    both are empty or zero. Offsets are found by sums over hash buckets of each
    source, as many as its rows need, so a source that holds a third of all
    rows is not ordered in one task. A block's shard is looked up in the tree,
    of which the driver splits and sends 4,096 parts at most; the shards of a
    part are drawn, with seeds of their own, by the tasks that hold it. The
    targets are a short list that the driver reads.
    """
    spark = docs.sparkSession
    wanted = targets.where("source IS NOT NULL").groupBy("source").agg(F.max(F.coalesce("target_share", F.lit(0.0))).alias("target_share"), F.max(F.coalesce("max_repeats", F.lit(1))).alias("max_repeats"))
    goal = {r.source: (r.target_share, r.max_repeats) for r in wanted.collect()}
    rows = docs.where("source IS NOT NULL AND tokens > 0").select("key", "source", F.col("tokens").cast("long").alias("tokens")).dropDuplicates(["key"])
    rows = rows.where(F.col("source").isin(list(goal))) if goal else rows.limit(0)
    rows = cut(rows.withColumn("order", F.xxhash64(F.lit(seed), "key")))
    had = rows.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("n")).collect()
    have = {r.source: r.tokens for r in had}
    buckets = {r.source: max(1, ceil(r.n / _BUCKET_ROWS)) for r in had}
    quota = quotas(have, goal)
    names = sorted(quota)
    shards = shards or max(16, -(-sum(quota.values()) // _SHARD_TOKENS))
    block = max(1, -(-sum(quota.values()) // min(shards * blocks_per_shard, _MOST_BLOCKS)))
    counts = [max(1, -(-quota[s] // block)) for s in names]
    tree = Tree(counts, shards, seed)
    sent = spark.sparkContext.broadcast(tree)
    # One row for each source that has a target.
    plan = spark.createDataFrame([(s, j, quota[s], have[s], goal[s][1], counts[j], buckets[s]) for j, s in enumerate(names)], "source string, j int, quota long, have long, repeats int, blocks long, buckets int")

    rows = rows.join(F.broadcast(plan), "source").withColumn("bucket", F.pmod(F.shiftright("order", 20), F.col("buckets")))
    sums = rows.groupBy("source", "bucket").agg(F.sum("tokens").alias("tokens"))
    before = F.sum("tokens").over(_until("source", "bucket")) - F.col("tokens")
    starts = sums.select("source", "bucket", before.alias("start"))
    inside = F.sum("tokens").over(_until("source", "bucket", within=True)) - F.col("tokens")
    placed = rows.withColumn("inside", inside).join(starts, ["source", "bucket"])
    copies = placed.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.col("repeats") - 1)))
    copies = copies.withColumn("offset", F.col("start") + F.col("inside") + F.col("repeat") * F.col("have")).where(F.col("offset") + F.col("tokens") / 2 <= F.col("quota"))
    number = F.least((F.col("offset") / block).cast("long"), F.col("blocks") - 1)
    place = F.pandas_udf(lambda j, n: pd.Series(sent.value.place(j.to_numpy(), n.to_numpy())), LongType())
    group = F.pandas_udf(lambda j, at: pd.Series(sent.value.group(j.to_numpy(), at.to_numpy())), IntegerType())
    shard = F.pandas_udf(lambda g, j, at: pd.Series(sent.value.shard(g.to_numpy(), j.to_numpy(), at.to_numpy())), IntegerType())
    copies = copies.select("key", "source", "repeat", "tokens", "j", place("j", number).alias("at"))
    taken = copies.withColumn("group", group("j", "at")).repartition("group").withColumn("shard", shard("group", "j", "at"))
    # Rows of a group are together already: the window by group and shard needs no shuffle of its own.
    shuffled = Window.partitionBy("group", "shard").orderBy(F.xxhash64(F.lit(seed + 1), "key", "repeat"), "key", "repeat")
    selection = cut(taken.withColumn("position", F.row_number().over(shuffled)).select("key", "source", "repeat", "tokens", "shard", "position"))
    reached = selection.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.countDistinct("key").alias("documents"), (F.max("repeat") + 1).alias("most_repeats"))
    total = sum(r.tokens for r in reached.select("tokens").collect()) or 1
    shares = wanted.join(reached, "source", "left").na.fill(0, ["tokens", "documents", "most_repeats"])
    return selection, shares.select("source", "target_share", "tokens", "documents", (F.col("tokens") / total).alias("reached_share"), "most_repeats")


def _until(*by: str, within: bool = False) -> WindowSpec:
    if within:
        return Window.partitionBy(*by).orderBy("order", "key").rowsBetween(Window.unboundedPreceding, 0)
    return Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, 0)
