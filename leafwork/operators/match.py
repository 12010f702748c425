"""Matching: cascades, scored choice, ranges, interval and band anti-joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def best(df: DataFrame, by: list[str], score: list[Column], order: list[Column], keep: list[str]) -> DataFrame:
    """The row of each group with the highest score; ties go to the first in ``order``."""
    # The smallest struct of negated scores and order: an aggregate with partial sums, no sort of a group.
    rank = F.struct(*[(-s).alias(f"s{k}") for k, s in enumerate(score)], *[o.alias(f"o{k}") for k, o in enumerate(order)])
    return df.groupBy(*by).agg(F.min_by(F.struct(*keep), rank).alias("_best")).select(*by, "_best.*")


def cascade_lookup(df: DataFrame, tiers: list[tuple[str, DataFrame, list[str], str]], value: str, default: str) -> DataFrame:
    """``value`` from the first tier that has the row's key, and ``tier``, its name.

    Each tier is (name, table, key columns shared with ``df``, value column); a
    tier with several rows for a key gives the smallest value.
    """
    rows = df
    for k, (_, tab, key, col) in enumerate(tiers):
        rows = rows.join(tab.groupBy(*key).agg(F.min(col).alias(f"_v{k}")), key, "left")
    found = F.coalesce(*[F.col(f"_v{k}") for k in range(len(tiers))])
    name = reduce(lambda c, k: c.when(F.col(f"_v{k}").isNotNull(), tiers[k][0]), range(1, len(tiers)), F.when(F.col("_v0").isNotNull(), tiers[0][0])).otherwise(default)
    return rows.withColumns({value: found, "tier": name}).drop(*[f"_v{k}" for k in range(len(tiers))])


def range_join(points: DataFrame, spans: DataFrame, at: str, lo: str, hi: str, width: int, on: list[str] | None = None) -> DataFrame:
    """Points with the spans that hold them, by an equality join on buckets of ``width``.

    A span is in every bucket it touches, so choose a width near the length of
    the usual span; each point is in one bucket, so no pair comes twice.
    """
    keys = [*(on or []), "_bucket"]
    left = points.withColumn("_bucket", F.floor(F.col(at) / width))
    right = spans.where(F.col(lo) <= F.col(hi)).withColumn("_bucket", F.explode(F.sequence(F.floor(F.col(lo) / width), F.floor(F.col(hi) / width))))
    return left.join(right, keys).where((F.col(at) >= F.col(lo)) & (F.col(at) <= F.col(hi))).drop("_bucket")


def salted_join(left: DataFrame, right: DataFrame, on: list[str], rows: int = 2000) -> DataFrame:
    """Inner join in which a key with more than ``rows`` left rows is cut into parts of about as many, each with all right rows of the key.

    What a hot key puts out is then spread over tasks, which a join that splits
    by the bytes it reads does not do. ``left`` is read twice: cut it before.
    """
    hot = left.groupBy(*on).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > rows).select(*on, F.ceil(F.col("_n") / rows).cast("int").alias("_salts"))
    one = F.coalesce("_salts", F.lit(1))
    a = left.join(hot, on, "left").withColumn("_salt", F.pmod(F.xxhash64(*left.columns), one).cast("int")).drop("_salts")
    b = right.join(hot, on, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), one - 1))).drop("_salts")
    return a.join(b, [*on, "_salt"]).drop("_salt")


def outside_spans(points: DataFrame, spans: DataFrame, on: list[str], at: str, start: str, end: str) -> DataFrame:
    """Points of a group in none of its spans, ends excluded."""
    other = spans.select(*[F.col(c).alias(f"_{c}") for c in on], F.col(start).alias("_start"), F.col(end).alias("_end"))
    same = [F.col(c) == F.col(f"_{c}") for c in on]
    return points.join(other, [*same, F.col(at) >= F.col("_start"), F.col(at) < F.col("_end")], "left_anti")


def not_near(left: DataFrame, right: DataFrame, on: list[str], at: str, band: int) -> DataFrame:
    """Rows of ``left`` without a row of ``right`` in the group at most ``band`` away."""
    other = right.select(*[F.col(c).alias(f"_{c}") for c in on], F.col(at).alias("_at"))
    same = [F.col(c) == F.col(f"_{c}") for c in on]
    return left.join(other, [*same, F.abs(F.col(at) - F.col("_at")) <= band], "left_anti")


def overlay(base: DataFrame, over: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Base rows with the overlay's columns where it has the key, and ``provenance``."""
    new = over.select(key, *[F.col(c).alias(f"_{c}") for c in columns], F.lit(True).alias("_has"))
    rows = base.join(new, key, "left")
    has = F.coalesce("_has", F.lit(False))
    return rows.withColumns({c: F.when(has, F.col(f"_{c}")).otherwise(F.col(c)) for c in columns} | {"provenance": F.when(has, "overlay").otherwise("base")}).drop("_has", *[f"_{c}" for c in columns])


def multiset_difference(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Rows of ``left``, repeats kept, whose key ``right`` lacks."""
    return left.join(right.select(*on).distinct(), on, "left_anti")


def first_wins(df: DataFrame, key: list[str], order: list[Column], columns: list[str]) -> DataFrame:
    """The first row of each key."""
    return best(df, key, [], order, columns)


def upsert_curated(derived: DataFrame, curated: DataFrame, used: DataFrame, key: str) -> DataFrame:
    """Derived rows, and the curated ones that are used and not derived."""
    extra = curated.join(used.select(key).distinct(), key, "left_semi").join(derived.select(key).distinct(), key, "left_anti")
    return derived.unionByName(extra, allowMissingColumns=True)


def shared_letters(a: Column, b: Column) -> Column:
    """How many different characters two texts share."""
    return F.size(F.array_intersect(F.array_distinct(F.split(a, "")), F.array_distinct(F.split(b, ""))))


def prefixes_agree(a: Column, b: Column, least: int = 2) -> Column:
    """Whether the shorter of two keys begins the longer and has ``least`` letters."""
    n = F.least(F.length(a), F.length(b))
    return (n >= least) & (F.substr(a, F.lit(1), n) == F.substr(b, F.lit(1), n))
