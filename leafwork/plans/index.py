"""Queries on word-index documents and on notes: reference grammar, targets, rendering."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafwork.functions.grammar import notes_once, reference_list, render
from leafwork.functions.text import from_roman
from leafwork.operators.apparatus import lines
from leafwork.operators.match import best
from leafwork.sources.tables import table


def index_entries(spark: SparkSession, d: str) -> DataFrame:
    rows = lines(table(spark, d, "documents"), ["doc_id"], "text").where(F.col("line").rlike(r"^\p{L}+ [IVXLC]+, [0-9]+(;|$)"))
    entry = rows.select("doc_id", F.col("no").cast("long").alias("no"), F.regexp_extract("line", r"^(\p{L}+) ", 1).alias("word"), F.explode(reference_list(F.regexp_replace("line", r"^\p{L}+ ", ""))).alias("r"))
    return entry.select("doc_id", "no", "word", F.col("r.song").alias("song"), F.col("r.verse").alias("verse"))


def index_targets_all(spark: SparkSession, d: str) -> DataFrame:
    """Songs that the index entries name, a row for each volume that has the number."""
    songs = table(spark, d, "chansons").groupBy("vol", "num").agg(F.min("chanson_id").alias("chanson_id"))
    uses = index_entries(spark, d).groupBy("song").agg(F.count(F.lit(1)).alias("uses"), F.countDistinct("word").alias("words")).withColumn("num", from_roman(F.col("song")))
    return uses.join(songs, "num", "left").select("song", F.col("num").cast("long").alias("num"), "uses", "words", "vol", "chanson_id", F.col("chanson_id").isNull().alias("missing"))


def first_note_order(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "page_files").select("file_name", F.array_join(notes_once(F.regexp_replace("body", r"(?m)^\[\^[^\]]+\]:.*$", "")), ",").alias("notes"))


def commonest_word(spark: SparkSession, d: str) -> DataFrame:
    words = table(spark, d, "documents").select("source", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}{6,})"), F.lit(1))).alias("word"))
    counts = words.groupBy("source", "word").agg(F.count(F.lit(1)).alias("uses"))
    return best(counts, ["source"], [F.col("uses")], [F.col("word")], ["word", "uses"])


def page_html(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "page_files").select("file_name", render(F.col("body")).alias("html"))


QUERIES = {f.__name__: f for f in (index_entries, index_targets_all, first_note_order, commonest_word, page_html)}

_ENTRIES = """SELECT doc_id, no, regexp_extract(line, '^(\\p{L}+) ', 1) AS word, regexp_extract(g, '([IVXLC]+),', 1) AS song, CAST(unnest(regexp_extract_all(regexp_extract(g, ',(.*)$', 1), '[0-9]+')) AS INTEGER) AS verse FROM (
  SELECT doc_id, no, line, trim(unnest(string_split(regexp_replace(line, '^\\p{L}+ ', ''), ';'))) AS g FROM (SELECT doc_id, generate_subscripts(l, 1) AS no, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)) WHERE regexp_matches(line, '^\\p{L}+ [IVXLC]+, [0-9]+(;|$)'))
  WHERE regexp_matches(g, '^[IVXLC]+\\s*,')"""
_VALUE = "list_sum(list_transform(range(1, length(song) + 1), lambda i: (CASE WHEN i < length(song) AND {v}[substr(song, i, 1)] < {v}[substr(song, i + 1, 1)] THEN -1 ELSE 1 END) * {v}[substr(song, i, 1)]))".replace("{v}", "MAP {'I': 1, 'V': 5, 'X': 10, 'L': 50, 'C': 100}")
SQL = {
    "index_entries": _ENTRIES,
    "first_note_order": """WITH f AS (SELECT file_name, label, min(i) AS i FROM (SELECT file_name, generate_subscripts(ms, 1) AS i, unnest(ms) AS label FROM (SELECT file_name, regexp_extract_all(regexp_replace(body, '(?m)^\\[\\^[^\\]]+\\]:.*$', '', 'g'), '\\[\\^([^\\]]+)\\]', 1) AS ms FROM page_files)) GROUP BY 1, 2)
      SELECT p.file_name, coalesce(string_agg(label, ',' ORDER BY i), '') AS notes FROM page_files p LEFT JOIN f ON f.file_name = p.file_name GROUP BY 1""",
    "index_targets_all": f"""WITH u AS (SELECT song, count(*) AS uses, count(DISTINCT word) AS words FROM ({_ENTRIES}) GROUP BY 1), n AS (SELECT *, CAST({_VALUE} AS BIGINT) AS num FROM u), s AS (SELECT vol, num, min(chanson_id) AS chanson_id FROM chansons GROUP BY 1, 2)
      SELECT song, n.num, uses, words, vol, chanson_id, chanson_id IS NULL AS missing FROM n LEFT JOIN s ON n.num = s.num""",
    "commonest_word": "WITH c AS (SELECT source, word, count(*) AS uses FROM (SELECT source, unnest(regexp_extract_all(lower(text), '\\p{L}{6,}')) AS word FROM documents) GROUP BY 1, 2) SELECT source, word, uses FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY uses DESC, word) AS n FROM c) WHERE n = 1",
}
