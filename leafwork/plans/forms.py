"""Queries on forms of names, titles, lines and labels: one scalar rule or two over a whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafwork.functions.edition import CAESURA, FENCE, HANDS, HEAD_MARKS, head_words
from leafwork.functions.grammar import around, parallels
from leafwork.functions.rules import quoted, replaced, sql_replaced
from leafwork.functions.text import attributes, label_tail, last_capitals, split_references, superscript, title_case, url_quote
from leafwork.operators.ordered import fenced
from leafwork.plans.layout import _FENCED, final_labels
from leafwork.plans.layout import SQL as LAYOUT_SQL
from leafwork.plans.pages import LINES, _lines
from leafwork.sources.tables import table

LOCATORS = ((r"(^|[^\p{L}])pp?\. ?([0-9])", "\\1p. \\2"),)


def entry_forms(spark: SparkSession, d: str) -> DataFrame:
    """Of each entry its surname in capitals, its author with capitals at the head of words, its reviews with locators in one form, how many references they are, and its title in an address."""
    t = table(spark, d, "bibliography_entry")
    reviews = F.array_join(F.transform("reviews", lambda r: r["text"]), ". ")
    return t.select("entry_id", last_capitals(F.col("author")).alias("surname"), title_case(F.col("author")).alias("cased"), replaced(reviews, LOCATORS).alias("reviews"), F.size(split_references(reviews)).cast("long").alias("references"), url_quote(F.col("title")).alias("address"))


def heading_lines(spark: SparkSession, d: str) -> DataFrame:
    """Marked headings among the documents, without marks, in small letters."""
    rows = table(spark, d, "documents").select(F.explode(F.split("text", "\n")).alias("line")).where(F.col("line").rlike(r"^#{1,6}\s"))
    return rows.groupBy(head_words(F.col("line")).alias("heading")).agg(F.count(F.lit(1)).alias("times"))


def clean_texts(spark: SparkSession, d: str) -> DataFrame:
    """Documents without a fence around them and without blanks at their ends, raised letters as markup."""
    text = superscript(replaced(F.col("text"), FENCE))
    return table(spark, d, "documents").select("doc_id", F.length(text).cast("long").alias("letters"), F.substring(F.md5(text), 1, 12).alias("digest"))


def verse_forms(spark: SparkSession, d: str) -> DataFrame:
    """Verses with gaps and hand notes as markup, by the language of their fence."""
    rows = fenced(_lines(spark, d), ["file_name"], ["no"], "line").where("inside AND trim(line) <> ''")
    return rows.select("file_name", "no", replaced(replaced(F.col("line"), HANDS), CAESURA).alias("verse"))


def fence_languages(spark: SparkSession, d: str) -> DataFrame:
    """Languages and number of classes that fences give."""
    rows = _lines(spark, d).where(F.col("line").rlike(r"^:::\s*\{")).select(attributes(F.col("line")).alias("a"))
    return rows.groupBy(F.try_element_at("a.keys", F.lit("lang")).alias("lang"), F.size("a.classes").cast("long").alias("classes")).agg(F.count(F.lit(1)).alias("fences"))


def card_sides(spark: SparkSession, d: str) -> DataFrame:
    """Titles and what stands behind the stroke of library cards."""
    t = table(spark, d, "library_records")
    return t.select("lib_id", F.explode(parallels(F.col("title_line"))).alias("p")).select("lib_id", "p.left", "p.right")


def phrase_contexts(spark: SparkSession, d: str) -> DataFrame:
    """Phrases that refer back with the letters around them."""
    return _lines(spark, d).select("file_name", "no", F.explode(around(F.col("line"), r"op\. cit\.", 40, 24)).alias("context"))


def label_tails(spark: SparkSession, d: str) -> DataFrame:
    """How often each number stands last in the final labels of notes."""
    return final_labels(spark, d).groupBy(label_tail(F.col("final")).alias("number")).agg(F.count(F.lit(1)).alias("labels"))


QUERIES = {f.__name__: f for f in (entry_forms, heading_lines, clean_texts, verse_forms, fence_languages, card_sides, phrase_contexts, label_tails)}

_REVIEWS = "array_to_string(list_transform(reviews, lambda r: r.text), '. ')"
_CASED = "array_to_string(list_transform(string_split(lower(author), ' '), lambda w: CASE WHEN w IN ('de', 'du', 'des', 'la', 'le', 'von', 'van', 'di') THEN w ELSE upper(substr(w, 1, 1)) || substr(w, 2) END), ' ')"
_CLEAN = f"regexp_replace({sql_replaced('text', FENCE)}, '\\^([^^ ]+)\\^', '<sup>\\1</sup>', 'g')"
SQL = {
    "entry_forms": f"""SELECT entry_id, list_filter(regexp_split_to_array(author, '[ ,]+'), lambda w: regexp_matches(w, '^\\p{{Lu}}{{2,}}$'))[-1] AS surname, {_CASED} AS cased, {sql_replaced(_REVIEWS, LOCATORS)} AS reviews,
      len(string_split(regexp_replace({_REVIEWS}, '([0-9\\])])\\.\\s+', '\\1' || chr(1), 'g'), chr(1))) AS "references", url_encode(title) AS address FROM bibliography_entry""",
    "heading_lines": f"SELECT lower(trim({sql_replaced('line', HEAD_MARKS)})) AS heading, count(*) AS times FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents) WHERE regexp_matches(line, '^#{{1,6}}\\s') GROUP BY 1",
    "clean_texts": f"SELECT doc_id, length({_CLEAN}) AS letters, substr(md5({_CLEAN}), 1, 12) AS digest FROM documents",
    "verse_forms": f"SELECT file_name, no, {sql_replaced('line', (*HANDS, *CAESURA))} AS verse FROM ({_FENCED} FROM ({LINES})) WHERE inside AND trim(line) <> ''",
    "fence_languages": f"""SELECT nullif(regexp_extract(line, '[\\s{{]lang="?([^\\s"}}]+)', 1), '') AS lang, len(list_filter(regexp_split_to_array(regexp_extract(line, '\\{{([^}}]*)\\}}', 1), '\\s+'), lambda x: starts_with(x, '.'))) AS classes, count(*) AS fences FROM ({LINES}) WHERE regexp_matches(line, '^:::\\s*\\{{') GROUP BY 1, 2""",
    "card_sides": """SELECT lib_id, trim(regexp_extract(line, '^(.*?) / (.*?)(?: \\(v\\. ?(\\d+)\\))?$', 1)) AS "left", trim(regexp_extract(line, '^(.*?) / (.*?)(?: \\(v\\. ?(\\d+)\\))?$', 2)) AS "right" FROM (SELECT lib_id, unnest(string_split(title_line, chr(10))) AS line FROM library_records) WHERE contains(line, ' / ')""",
    "phrase_contexts": f"SELECT file_name, no, unnest(regexp_extract_all(line, {quoted('(?s).{0,40}(?:op' + chr(92) + '. cit' + chr(92) + '.).{0,24}')})) AS context FROM ({LINES})",
    "label_tails": f"SELECT regexp_extract(final, '([^-]*)$', 1) AS number, count(*) AS labels FROM ({LAYOUT_SQL['final_labels']}) GROUP BY 1",
}
