"""Queries that map typed sigla to the list of sigla."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafwork.llm.listing import map_to_list
from leafwork.sources.tables import table


def _typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = table(spark, sf_dir, "citations").select("rec_id", "siglum").unionByName(table(spark, sf_dir, "sigla_overrides").select("rec_id", "siglum"))
    return records.where("siglum IS NOT NULL").join(table(spark, sf_dir, "siglum_list").select("siglum"), "siglum", "left_anti")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = _typed(spark, sf_dir)
    mapped = map_to_list(records, table(spark, sf_dir, "siglum_list"))
    return records.join(mapped, records["siglum"] == mapped["typed"]).select("rec_id", "listed").distinct()


def p6_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed values that stand for no entry, with the number of their records."""
    records = _typed(spark, sf_dir)
    none = map_to_list(records, table(spark, sf_dir, "siglum_list")).where("listed = ''")
    return records.join(none, records["siglum"] == none["typed"]).groupBy("siglum").agg(F.countDistinct("rec_id").alias("records"))


QUERIES = {"p6_found": p6_found, "p6_unmatched": p6_unmatched}
SQL: dict[str, str] = {}
