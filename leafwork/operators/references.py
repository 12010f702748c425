"""References to rows that are missing, withdrawn or entered later."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Parent:
    """Rows referred to: ``key`` (one or more columns), from when, until when."""

    name: str
    rows: DataFrame
    key: tuple[Column, ...]
    since: Column
    until: Column


@dataclass(frozen=True)
class Child:
    """Rows that refer to ``parent`` by ``key``; the last key column is reported."""

    field: str
    parent: str
    rows: DataFrame
    key: tuple[Column, ...]
    record: Column
    at: Column


def _tagged(name: str, key: tuple[Column, ...]) -> list[Column]:
    whole = F.array(*[c.cast("string") for c in key])
    return [F.lit(name).alias("parent"), whole.alias("key")]


def broken_references(parents: list[Parent], children: list[Child]) -> DataFrame:
    """One row for every record and key that fails: ref_field, rec_key, ref_key, status, ym.

    status is ``missing`` where no parent has the key, else ``deleted`` where
    every such parent ended, else ``late`` where the earliest parent began
    after the record. ym is the month of the record.

    Parent and child keys are put in one long table and grouped by parent table
    and key, with partial aggregation before the shuffle, so a key that a third
    of all rows bears is one row per map task. Only keys whose group fails are
    joined to the records again.

    A key with a null part is no reference. A record with a null time can be
    missing or deleted, never late, and its ym is null. Parents without a start
    never make a reference late. Repeated rows give one result. Empty tables
    give the obvious results: without parents everything is missing, without
    children nothing is reported. Other columns are not read.
    """
    long_parents, long_children = None, None
    for p in parents:
        rows = p.rows.select(*_tagged(p.name, p.key), F.lit(1).alias("is_parent"), p.until.isNull().cast("int").alias("live"), p.since.cast("timestamp_ntz").alias("since"))
        long_parents = rows if long_parents is None else long_parents.unionByName(rows)
    for c in children:
        rows = c.rows.select(*_tagged(c.parent, c.key), F.lit(c.field).alias("ref_field"), c.record.cast("string").alias("rec_key"), c.at.cast("timestamp_ntz").alias("at"))
        rows = rows.where(~F.exists("key", lambda x: x.isNull()))
        long_children = rows if long_children is None else long_children.unionByName(rows)

    never = F.lit(None).cast("timestamp_ntz")
    tagged = long_parents.select("parent", "key", "is_parent", "live", "since", never.alias("at")).unionByName(
        long_children.select("parent", "key", F.lit(0).alias("is_parent"), F.lit(0).alias("live"), never.alias("since"), "at")
    )
    failing = (
        tagged.groupBy("parent", "key")
        .agg(F.max("is_parent").alias("has_parent"), F.max("live").alias("any_live"), F.min("since").alias("since"), F.min("at").alias("first_use"), F.min("is_parent").alias("no_child"))
        .where((F.col("no_child") == 0) & ((F.col("has_parent") == 0) | (F.col("any_live") == 0) | (F.col("since") > F.col("first_use"))))
        .select("parent", "key", "has_parent", "any_live", "since")
    )
    status = F.when(F.col("has_parent") == 0, "missing").when(F.col("any_live") == 0, "deleted").when(F.col("since") > F.col("at"), "late")
    return (
        long_children.join(failing, ["parent", "key"])
        .select("ref_field", "rec_key", F.element_at("key", -1).alias("ref_key"), status.alias("status"), F.date_format("at", "yyyy-MM").alias("ym"))
        .where(F.col("status").isNotNull())
        .distinct()
    )


def broken_reference_report(found: DataFrame) -> DataFrame:
    """Failed references per field, month and status."""
    return found.groupBy("ref_field", "ym", "status").agg(F.count(F.lit(1)).alias("refs"), F.countDistinct("ref_key").alias("keys"))
