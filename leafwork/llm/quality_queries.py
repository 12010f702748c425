"""Queries on the quality of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from leafwork.llm.quality import quality
from leafwork.sources.tables import table


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents")).where("form <> 'natural'").select("doc_id", "form")


def p9_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"))


QUERIES = {"p9_found": p9_found, "p9_stats": p9_stats}
SQL: dict[str, str] = {}
