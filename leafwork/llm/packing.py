"""Items of varying size put into containers of one capacity.

Bulk-synchronous best fit. In each round items and gaps are range-sorted
together, largest first; one sweep gives each item the smallest gap still free
that holds it; gaps shrink, and the round repeats with the items left over.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from math import ceil

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafwork.session import cut, forget

#: Items and gaps of a range, about: what one task sweeps with its stack in memory.
RANGE_ROWS = 100_000
_SWEPT = "part int, kind string, rank long, item string, slot string, size long"


def _sweep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Match within one range: a gap is put on a stack, an item takes the top, which is the smallest gap before it."""
    part, stack, n = TaskContext.get().partitionId(), [], 0
    for x in batches:
        rows = []
        for kind, key, size in zip(x["kind"], x["key"], x["size"], strict=True):
            if kind == 0:
                stack.append((key, size))
            elif stack:
                rows.append((part, "match", 0, key, stack.pop()[0], size))
            else:
                rows.append((part, "item", n, key, None, size))
                n += 1
        yield pd.DataFrame(rows, columns=["part", "kind", "rank", "item", "slot", "size"])
    rows = [(part, "gap", rank, None, key, size) for rank, (key, size) in enumerate(reversed(stack))]
    yield pd.DataFrame(rows, columns=["part", "kind", "rank", "item", "slot", "size"])


def successors(counts: dict[int, tuple[int, int]]) -> list[tuple[int, int, int, int, int]]:
    """(item range, first rank, last rank, gap range, first gap rank) over the ranges' left-over (items, gaps).

    The same stack as in :func:`_sweep`, of runs of gaps instead of single gaps.
    """
    out, stack = [], []
    for part in sorted(counts):
        items, gaps = counts[part]
        done = 0
        while done < items and stack:
            where, first, left = stack.pop()
            k = min(left, items - done)
            out.append((part, done, done + k - 1, where, first))
            done += k
            if k < left:
                stack.append((where, first + k, left - k))
        if gaps:
            stack.append((part, 0, gaps))
    return out


def _match(items: DataFrame, slots: DataFrame, parts: int) -> tuple[DataFrame, DataFrame]:
    """The swept ranges, and item, slot, size: each item with the smallest free slot that holds it, the largest items first."""
    spark = items.sparkSession
    events = slots.select(F.lit(0).alias("kind"), F.col("slot").alias("key"), "size").unionByName(items.select(F.lit(1).alias("kind"), F.col("item").alias("key"), "size"))
    order = [F.col("size").desc(), F.col("kind").asc(), F.xxhash64("key").asc(), F.col("key").asc()]
    swept = cut(events.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInPandas(_sweep, _SWEPT))
    local = swept.where("kind = 'match'").select("item", "slot", "size")
    left = swept.where("kind <> 'match'").groupBy("part").pivot("kind", ["item", "gap"]).count().na.fill(0).collect()
    runs = successors({r.part: (r.item, r.gap) for r in left})
    if not runs:
        return swept, local
    runs = spark.createDataFrame(runs, "part int, lo long, hi long, gap_part int, gap_lo long")
    waiting = swept.where("kind = 'item'").select("part", "rank", "item", "size")
    # One row for each two ranges at most, whatever the number of items.
    sent = waiting.join(F.broadcast(runs), "part").where("rank BETWEEN lo AND hi").select("item", "size", "gap_part", (F.col("gap_lo") + F.col("rank") - F.col("lo")).alias("gap_rank"))
    gaps = swept.where("kind = 'gap'").select(F.col("part").alias("gap_part"), F.col("rank").alias("gap_rank"), "slot")
    return swept, local.unionByName(sent.join(gaps, ["gap_part", "gap_rank"]).select("item", "slot", "size"))


def pack(sizes: DataFrame, capacity: int, parts: int | None = None) -> DataFrame:
    """key, piece, container, size: every item in a container of ``capacity``.

    ``sizes`` has key (string, unique) and size. An item larger than the
    capacity, and no other, is split: into full pieces, each filling a
    container, and a rest that is packed like an item; pieces count from 0.
    Containers are opened by the least number that could hold what is left, so
    few have room left over. Where gaps are more than twice as large as the
    largest item left, a gap takes several items in one round.

    An item of null, zero or negative size needs no room and has a null
    container; of rows with one key the largest counts; ties in size are broken
    by a hash of the key, so equal sizes spread over all ranges; an empty table
    gives no rows. A round has as many ranges as its items and gaps need, or
    ``parts``; the files of the round before are deleted.
    """
    spark = sizes.sparkSession
    every = cut(sizes.groupBy("key").agg(F.max(F.coalesce("size", F.lit(0)).cast("long")).alias("size")))
    no_room = every.where("size <= 0").select("key", F.lit(0).alias("piece"), F.lit(None).cast("string").alias("container"), F.lit(0).cast("long").alias("size"))
    room = every.where("size > 0")
    full = room.where(F.col("size") >= capacity).select("key", F.explode(F.sequence(F.lit(0), (F.col("size") / capacity).cast("int") - 1)).alias("piece"))
    full = full.select("key", "piece", F.concat_ws("#", F.lit("f"), "key", "piece").alias("container"), F.lit(capacity).cast("long").alias("size"))
    rest = room.select(F.concat_ws("#", "key", (F.col("size") / capacity).cast("int")).alias("item"), (F.col("size") % capacity).alias("size")).where("size > 0")
    items = cut(rest)
    bins = items.select(F.lit("").alias("container"), F.lit(0).cast("long").alias("gap")).limit(0)
    placed: list[DataFrame] = []
    wave = 0
    while True:
        total, largest, least, n = items.agg(F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.max("size"), F.lit(0)), F.min("size"), F.count(F.lit(1))).first()
        if not n:
            break
        share = F.greatest(F.lit(1), (F.col("gap") / largest).cast("int"))
        widest, places = bins.agg(F.max("gap"), F.sum(share)).first()
        if (widest or 0) < least:
            opened = min(n, ceil(total / capacity))
            new = spark.range(0, opened, 1, ceil(opened / RANGE_ROWS)).select(F.concat(F.lit(f"b{wave}#"), F.col("id")).alias("container"), F.lit(capacity).cast("long").alias("gap"))
            bins, wave, places = cut(bins.unionByName(new)), wave + 1, (places or 0) + opened * max(1, capacity // largest)
        slots = bins.where("gap > 0").select("container", "gap", F.explode(F.sequence(F.lit(1), share)).alias("k"), share.alias("share"))
        slots = slots.select(F.concat_ws("~", "container", "k").alias("slot"), (F.col("gap") / F.col("share")).cast("long").alias("size"))
        swept, matched = _match(items, slots, parts or ceil((n + places) / RANGE_ROWS))
        got = cut(matched.withColumn("container", F.substring_index("slot", "~", 1)).select("item", "container", "size"))
        placed.append(got)
        used = got.groupBy("container").agg(F.sum("size").alias("used"))
        old = bins, items, swept
        bins = cut(bins.join(used, "container", "left").select("container", (F.col("gap") - F.coalesce("used", F.lit(0))).alias("gap")).where("gap > 0"))
        items = cut(items.join(got.select("item"), "item", "left_anti"))
        forget(*old)
    out = full.unionByName(no_room)
    if placed:
        rows = reduce(DataFrame.unionByName, placed)
        piece = F.substring_index("item", "#", -1)
        key = F.expr("substring(item, 1, length(item) - length(substring_index(item, '#', -1)) - 1)")
        out = out.unionByName(rows.select(key.alias("key"), piece.cast("int").alias("piece"), "container", "size"))
    return out
