"""Word index, keyword in context, filters over it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafwork.functions.text import fold_key


def words(df: DataFrame, keep: list[str], text: str) -> DataFrame:
    """keep, pos, word: the words of a text in order, lower case."""
    found = F.regexp_extract_all(F.lower(text), F.lit(r"(\p{L}+)"), F.lit(1))
    return df.select(*keep, F.posexplode(found).alias("pos", "word"))


def inverted_index(df: DataFrame, key: str, text: str) -> DataFrame:
    """word, uses, places: how often a word occurs and in how many rows; its postings are :func:`words`."""
    return words(df, [key], text).groupBy("word").agg(F.count(F.lit(1)).alias("uses"), F.countDistinct(key).alias("places"))


def in_context(df: DataFrame, key: str, text: str, hit: Column, around: int = 2) -> DataFrame:
    """key, pos, word, before, after for the words that ``hit`` (a condition on word) holds for."""
    w = Window.partitionBy(key).orderBy("pos")
    side = lambda lo, hi: F.array_join(F.collect_list("word").over(w.rowsBetween(lo, hi)), " ")
    return words(df, [key], text).withColumns({"before": side(-around, -1), "after": side(1, around)}).where(hit).select(key, "pos", "word", "before", "after")


def folded_filter(df: DataFrame, text: str, query: str) -> DataFrame:
    """Rows whose folded text holds the folded query; an empty query keeps all."""
    return df.where(fold_key(F.col(text)).contains(fold_key(F.lit(query))))


def buckets(df: DataFrame, name: str, visible: Column) -> DataFrame:
    """letter, shown, total, visible: first letters of ``name`` and how many of their rows are visible."""
    letter = F.upper(F.substring(fold_key(F.col(name)), 1, 1)).alias("letter")
    return df.groupBy(letter).agg(F.count_if(visible).alias("shown"), F.count(F.lit(1)).alias("total"), F.bool_or(visible).alias("visible"))
