"""Queries on broken references."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafwork.operators.references import Child, Parent, broken_reference_report, broken_references
from leafwork.sources.tables import table


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    col = F.col
    usage, entries, manifest = (table(spark, sf_dir, n) for n in ("siglum_usage", "bibliography_entry", "manifest"))
    citations, chansons, numbers = (table(spark, sf_dir, n) for n in ("citations", "chansons", "page_numbers"))
    pages = chansons.select("chanson_id", "catalogued_at", F.explode("texte.pages").alias("page"))
    return broken_references(
        [
            Parent("siglum_usage", usage, (col("vol"), col("siglum")), col("first_seen"), col("retired_at")),
            Parent("bibliography_entry", entries, (col("vol"), col("title")), col("added_at"), col("withdrawn_at")),
            Parent("manifest", manifest, (col("pageid"),), col("added_at"), col("withdrawn_at")),
        ],
        [
            Child("citations.siglum", "siglum_usage", citations, (col("vol"), col("siglum")), col("rec_id"), col("entered_at")),
            Child("citations.bibliography.title", "bibliography_entry", citations, (col("vol"), col("bibliography.title")), col("rec_id"), col("entered_at")),
            Child("chansons.texte.pages", "manifest", pages, (col("page"),), col("chanson_id"), col("catalogued_at")),
            Child("page_numbers.pageid", "manifest", numbers, (col("pageid"),), col("pageid"), col("read_at")),
        ],
    )


def p3_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return broken_reference_report(p3_found(spark, sf_dir))


FOUND_SQL = """
WITH parents AS (
  SELECT 'u' AS p, vol, siglum AS k, first_seen AS since, retired_at AS until FROM siglum_usage
  UNION ALL SELECT 'b', vol, title, added_at, withdrawn_at FROM bibliography_entry
  UNION ALL SELECT 'm', 0, pageid, added_at, withdrawn_at FROM manifest),
keys AS (SELECT p, vol, k, bool_and(until IS NOT NULL) AS gone, min(since) AS since FROM parents GROUP BY p, vol, k),
refs AS (
  SELECT DISTINCT 'citations.siglum' AS f, 'u' AS p, vol, siglum AS k, CAST(rec_id AS VARCHAR) AS r, entered_at AS t FROM citations
  UNION SELECT 'citations.bibliography.title', 'b', vol, bibliography.title, CAST(rec_id AS VARCHAR), entered_at FROM citations
  UNION SELECT 'chansons.texte.pages', 'm', 0, unnest(texte.pages), CAST(chanson_id AS VARCHAR), catalogued_at FROM chansons
  UNION SELECT 'page_numbers.pageid', 'm', 0, pageid, pageid, read_at FROM page_numbers),
judged AS (
  SELECT f, r, refs.k AS k, t, CASE WHEN keys.k IS NULL THEN 'missing' WHEN gone THEN 'deleted' WHEN since > t THEN 'late' END AS s
  FROM refs LEFT JOIN keys ON refs.p = keys.p AND refs.vol = keys.vol AND refs.k = keys.k WHERE refs.k IS NOT NULL)
SELECT DISTINCT f AS ref_field, r AS rec_key, k AS ref_key, s AS status, strftime(t, '%Y-%m') AS ym FROM judged WHERE s IS NOT NULL
"""

QUERIES = {"p3_found": p3_found, "p3_report": p3_report}
SQL = {
    "p3_found": FOUND_SQL,
    "p3_report": f"SELECT ref_field, ym, status, count(*) AS refs, count(DISTINCT ref_key) AS keys FROM ({FOUND_SQL}) GROUP BY ALL",
}
