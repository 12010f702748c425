"""Queries on text that prints alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafwork.llm.canon import alike_classes, alike_pairs, canonical_text, fingerprints
from leafwork.session import cut
from leafwork.sources.tables import table

_TEXTS = (("chansons", "chanson_id", "incipit"), ("citations", "rec_id", "definition"), ("page_files", "file_name", "body"))


def _prints(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [fingerprints(table(spark, sf_dir, t), t, F.col(k), F.col(x)) for t, k, x in _TEXTS]
    return cut(parts[0].unionByName(parts[1]).unionByName(parts[2]))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alike_pairs(_prints(spark, sf_dir))


def p1_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alike_classes(_prints(spark, sf_dir))


def p1_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text in its canonical form, a row for each row of the tables that has one; nothing is shuffled."""
    out = None
    for t, k, x in _TEXTS:
        rows = table(spark, sf_dir, t).select(F.lit(t).alias("tab"), F.col(k).cast("string").alias("key"), F.col(x).alias("text")).where("text IS NOT NULL")
        rows = rows.select("tab", "key", canonical_text(F.col("text")).alias("text"))
        out = rows if out is None else out.unionByName(rows)
    return out


QUERIES = {"p1_found": p1_found, "p1_classes": p1_classes, "p1_canonical": p1_canonical}
SQL: dict[str, str] = {}
