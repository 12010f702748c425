"""Writers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def json_document(df: DataFrame, path: str, order: list[str]) -> None:
    """One JSON array of all rows in order: rows are sorted in parallel and written through one task row by row, so none holds them all."""
    rows = df.orderBy(*order).select(F.to_json(F.struct(*order, *[c for c in df.columns if c not in order])).alias("value"))
    rows.coalesce(1).mapInPandas(_bracketed, "value string").write.mode("overwrite").text(path, lineSep=" ")


def _bracketed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    lead = "["
    for x in batches:
        yield pd.DataFrame({"value": [(lead if i == 0 else ",") + v for i, v in enumerate(x["value"])]})
        lead = "," if len(x) else lead
    yield pd.DataFrame({"value": ["]" if lead == "," else "[]"]})


def json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def csv_log(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def joined_text(df: DataFrame, group: list[str], order: str, text: str, between: str = "\n\n") -> DataFrame:
    """group, text: the texts of a group in order, one string; a group is a book, which one row can hold."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(order), F.col(text).alias("t"))))
    return df.groupBy(*group).agg(F.array_join(F.transform(rows, lambda r: r["t"]), between).alias("text"))


def changed_only(before: DataFrame, after: DataFrame, key: str, text: str) -> DataFrame:
    """Rows of ``after`` that differ from those before; they are written to a new place, never over what is read."""
    old = before.select(key, F.col(text).alias("_old"))
    return after.join(old, key, "left").where(~F.col(text).eqNullSafe(F.col("_old"))).drop("_old")


def text_by(df: DataFrame, path: str, key: str, text: str) -> None:
    """A folder for each key with its text."""
    df.select(key, F.col(text).alias("value")).write.mode("overwrite").partitionBy(key).text(path)


def report(flags: DataFrame) -> DataFrame:
    """category, items, lines of a flag table, the largest category first: a Markdown report is its presentation."""
    line = F.format_string("- %s: %s", "key", "detail")
    rows = flags.groupBy("category").agg(F.count(F.lit(1)).alias("items"), F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("lines"))
    return rows.orderBy(F.desc("items"), "category")
