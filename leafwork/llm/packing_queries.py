"""Queries that pack and mix documents by their tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafwork.llm.mixing import mix
from leafwork.llm.packing import pack
from leafwork.llm.tokens import token_count
from leafwork.session import cut
from leafwork.sources.tables import table

CAPACITY = 2048


def _sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return cut(docs.select("doc_id", "source", token_count(F.col("text")).alias("tokens")))


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack(_sizes(spark, sf_dir).select(F.col("doc_id").cast("string").alias("key"), F.col("tokens").alias("size")), CAPACITY)
    return packed.select(F.col("key").cast("long").alias("doc_id"), "piece", "container", F.col("size").alias("tokens"))


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of containers, tokens and share of room used."""
    packed = p7_containers(spark, sf_dir).where("container IS NOT NULL")
    totals = packed.agg(F.countDistinct("container").alias("containers"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"))
    return totals.withColumn("used_share", F.col("tokens") / (F.greatest("containers", F.lit(1)) * CAPACITY))


def _mixed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = _sizes(spark, sf_dir).select(F.col("doc_id").alias("key"), "source", "tokens")
    return mix(docs, table(spark, sf_dir, "mix_targets"))


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixed(spark, sf_dir)[0].withColumnRenamed("key", "doc_id")


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixed(spark, sf_dir)[1]


QUERIES = {"p7_containers": p7_containers, "p7_fill": p7_fill, "p8_mix": p8_mix, "p8_shares": p8_shares}
SQL: dict[str, str] = {}
