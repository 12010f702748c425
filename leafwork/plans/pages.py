"""Queries on pages, lines and notes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafwork.functions.rules import sql_spots
from leafwork.functions.text import ends_sentence, is_heading, line_kind, places
from leafwork.operators.apparatus import lines, note_marks, residual
from leafwork.operators.concordance import buckets, folded_filter, in_context, inverted_index, words
from leafwork.operators.match import not_near, outside_spans, overlay
from leafwork.operators.ordered import carry_forward, carry_number, fenced, heal_words, islands, overflow_pairs, pager, ranges, zip_by_rank
from leafwork.sources.sinks import joined_text
from leafwork.sources.tables import table

LINES = "SELECT file_name, pageid, provenance, CAST(generate_subscripts(l, 1) AS BIGINT) AS no, unnest(l) AS line FROM (SELECT file_name, pageid, provenance, string_split(body, chr(10)) AS l FROM page_files)"
MARKS = f"""SELECT file_name, no, regexp_extract(m, '\\[\\^([^\\]]+)\\]', 1) AS label, i = 0 AND regexp_matches(line, '^\\[\\^[^\\]]+\\]:') AS def
FROM (SELECT file_name, no, line, generate_subscripts(ms, 1) - 1 AS i, unnest(ms) AS m FROM (SELECT file_name, no, line, regexp_extract_all(line, '\\[\\^[^\\]]+\\]:?') AS ms FROM ({LINES})))"""
WORDS = "SELECT doc_id, generate_subscripts(w, 1) - 1 AS pos, unnest(w) AS word FROM (SELECT doc_id, regexp_extract_all(lower(text), '\\p{L}+') AS w FROM documents)"


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return lines(table(spark, d, "page_files"), ["file_name", "pageid", "provenance"], "body").withColumn("no", F.col("no").cast("long"))


def _marks(spark: SparkSession, d: str) -> DataFrame:
    return note_marks(_lines(spark, d), ["file_name"])


def token_counts(spark: SparkSession, d: str) -> DataFrame:
    return words(table(spark, d, "documents"), ["lang"], "text").groupBy("lang").agg(F.count(F.lit(1)).alias("tokens"), F.countDistinct("word").alias("different"))


def page_lines(spark: SparkSession, d: str) -> DataFrame:
    return _lines(spark, d).groupBy("file_name").agg(F.count(F.lit(1)).alias("lines"), F.count_if(F.col("line") == "").alias("blank"), F.max(F.length("line")).cast("long").alias("longest"))


def line_kinds(spark: SparkSession, d: str) -> DataFrame:
    return _lines(spark, d).groupBy(line_kind(F.col("line")).alias("kind")).agg(F.count(F.lit(1)).alias("lines"))


def paragraph_islands(spark: SparkSession, d: str) -> DataFrame:
    rows = islands(_lines(spark, d), ["file_name"], ["no"], F.col("line") == "")
    return rows.where("line <> ''").groupBy("file_name", "island").agg(F.min("no").alias("first"), F.max("no").alias("last"), F.sum(F.length("line")).alias("letters"))


def fenced_verse(spark: SparkSession, d: str) -> DataFrame:
    rows = fenced(_lines(spark, d), ["file_name"], ["no"], "line").where("inside")
    return rows.groupBy("file_name").agg(F.count(F.lit(1)).alias("verses"), F.min("no").alias("first"), F.min_by("line", "no").alias("incipit"))


def verse_numbers_read(spark: SparkSession, d: str) -> DataFrame:
    """Verses by the numbers printed before them; whose SQL is fixed, takes a number from the length of the line."""
    rows = fenced(_lines(spark, d), ["file_name"], ["no"], "line").where("inside AND trim(line) <> ''")
    given = F.nullif(F.regexp_extract(F.trim("line"), r"^([0-9]{1,9})\s*[.·]\s", 1), F.lit(""))
    return carry_number(rows, ["file_name"], ["no"], given, "verse").select("file_name", "no", "verse")


def note_residual(spark: SparkSession, d: str) -> DataFrame:
    return residual(_marks(spark, d), ["file_name"]).groupBy("file_name", "label", "fault").agg(F.count(F.lit(1)).alias("times"))


def note_overflow(spark: SparkSession, d: str) -> DataFrame:
    faults = residual(_marks(spark, d), ["file_name"])
    at = faults.withColumns({"vol": F.regexp_extract("file_name", r"v(\d+)p", 1), "idx": F.regexp_extract("file_name", r"p(\d+)\.md", 1).cast("int")})
    return overflow_pairs(at.where("fault = 'dangling'"), at.where("fault = 'orphan'"), ["vol"], "idx", "label")


def note_order(spark: SparkSession, d: str) -> DataFrame:
    marks = _marks(spark, d)
    refs = marks.where(~F.col("is_definition")).select("file_name", "no", "at", F.col("label").alias("ref"))
    defs = marks.where("is_definition").select("file_name", F.col("no").alias("def_no"), F.col("label").alias("def"))
    return zip_by_rank(refs, defs, ["file_name"], ["no", "at"], ["def_no"], only_equal=True).select("file_name", F.col("place").cast("long").alias("place"), "ref", "def")


def note_texts(spark: SparkSession, d: str) -> DataFrame:
    marks = _marks(spark, d)
    text = _lines(spark, d).where(F.col("line").rlike(r"^\[\^[^\]]+\]:"))
    last = text.select("file_name", F.regexp_extract("line", r"^\[\^([^\]]+)\]", 1).alias("label"), "no", F.regexp_replace("line", r"^\[\^[^\]]+\]: ?", "").alias("note")).groupBy("file_name", "label").agg(F.max_by("note", "no").alias("note"))
    return marks.where(~F.col("is_definition")).select("file_name", "label").distinct().join(last, ["file_name", "label"], "left")


def overlay_merge(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "page_files")
    base, over = pages.where("provenance = 'base'"), pages.where("provenance = 'overlay'")
    return overlay(base.select("pageid", "body"), over.select("pageid", "body"), "pageid", ["body"]).select("pageid", "provenance", F.length("body").cast("long").alias("letters"))


def keys_without_base(spark: SparkSession, d: str) -> DataFrame:
    """Second transcriptions of pages that have no first one, and numbers read from pages that the manifest does not have."""
    pages = table(spark, d, "page_files").select("pageid", "provenance")
    over = pages.where("provenance = 'overlay'").select("pageid").join(pages.where("provenance = 'base'"), "pageid", "left_anti").select(F.lit("transcription").alias("of"), "pageid")
    numbers = table(spark, d, "page_numbers").select("pageid").join(table(spark, d, "manifest").select("pageid"), "pageid", "left_anti").select(F.lit("number").alias("of"), "pageid")
    return over.union(numbers).distinct()


def word_heal(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "page_files").where("provenance = 'base'").select(F.regexp_extract("pageid", r"^v(\d+)p", 1).alias("vol"), "pageid", F.regexp_replace("body", r"\s+$", "").alias("body"))
    return heal_words(pages, ["vol"], "pageid", "body").where("healed <> body").select("pageid", F.right("healed", F.lit(20)).alias("ending"), F.length("healed").cast("long").alias("letters"))


def open_pages(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "page_files").where("provenance = 'base' AND body <> ''").select(F.regexp_extract("pageid", r"^v(\d+)p", 1).alias("vol"), "pageid", ends_sentence(F.col("body")).alias("closed"))
    return pager(pages, ["vol"], ["pageid"], "closed").select("pageid", "closed", F.coalesce(~F.col("previous"), F.lit(False)).alias("goes_on"))


def section_spans(spark: SparkSession, d: str) -> DataFrame:
    """Runs of pages of one kind, each to the page before the next run, the last to the end of its volume or the page before its back matter."""
    m = table(spark, d, "manifest").groupBy("vol", "idx").agg(F.min("kind").alias("kind"))
    w = Window.partitionBy("vol")
    back = F.min(F.when(F.col("kind").isin("bibliographie", "index", "table-matieres"), F.col("idx"))).over(w)
    m = m.withColumns({"before": F.lag("kind").over(w.orderBy("idx")), "bound": F.coalesce(back - 1, F.max("idx").over(w))})
    heads = m.where("before IS NULL OR before <> kind").select("vol", "idx", "kind", "bound")
    return ranges(heads, ["vol"], "idx", F.col("bound")).drop("bound")


def manifest_pager(spark: SparkSession, d: str) -> DataFrame:
    return pager(table(spark, d, "manifest").select("vol", "page_order", "pageid", "file_name").distinct(), ["vol"], ["page_order", "file_name"], "pageid").select("page_order", "pageid", "previous", "following")


def printed_carry(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "manifest").groupBy("vol", "idx").agg(F.max("printed").alias("printed"))
    return carry_forward(m, ["vol"], ["idx"], F.nullif("printed", F.lit("")), "carried").select("vol", "idx", "carried")


def printed_join(spark: SparkSession, d: str) -> DataFrame:
    numbers = table(spark, d, "page_numbers").groupBy("pageid").agg(F.max("printed_number").alias("n"))
    return table(spark, d, "manifest").select("pageid", "kind").distinct().join(numbers, "pageid", "left").select("pageid", "kind", F.coalesce("n", F.lit("")).alias("printed"))


def kind_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "manifest").groupBy("kind").agg(F.count(F.lit(1)).alias("pages"), F.count_if(F.col("printed") == "").alias("unnumbered"))


def quotes_in_notes_all(spark: SparkSession, d: str) -> DataFrame:
    """Every italic passage outside the parentheses of its line, repeats at their own places; whose SQL is fixed, has first places in lines under 400 letters."""
    rows = _lines(spark, d).select("file_name", "no", "line")
    stars = rows.select("file_name", "no", F.inline(places(F.col("line"), r"\*[^*]+\*|[^*]+|\*", "*")).alias("at", "quote")).distinct()
    spans = rows.select("file_name", "no", F.inline(places(F.col("line"), r"\([^)]+\)|[^(]+|\(", "(")).alias("from", "span"))
    spans = spans.select("file_name", "no", "from", (F.col("from") + F.length("span")).alias("to"))
    return outside_spans(stars, spans, ["file_name", "no"], "at", "from", "to").select("file_name", "no", F.col("at").cast("long").alias("at"), "quote")


def headings_apart(spark: SparkSession, d: str) -> DataFrame:
    rows = _lines(spark, d)
    heads = rows.where(is_heading(F.col("line"))).select("file_name", "no", "line")
    return not_near(heads, rows.where(F.col("line").rlike(r"\[\^")).select("file_name", "no"), ["file_name"], "no", 2)


def page_links(spark: SparkSession, d: str) -> DataFrame:
    found = _lines(spark, d).select("file_name", F.regexp_extract("file_name", r"v(\d+)p", 1).cast("int").alias("vol"), F.explode(F.array_distinct(F.regexp_extract_all("line", F.lit(r"p\. ([0-9]+)"), F.lit(1)))).alias("printed")).distinct()
    target = table(spark, d, "manifest").where("printed <> ''").groupBy("vol", "printed").agg(F.max_by("pageid", "page_order").alias("target"))
    return found.join(target, ["vol", "printed"]).select("file_name", "printed", "target")


def document_text(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "page_files").where("provenance = 'base'").withColumn("vol", F.regexp_extract("pageid", r"^v(\d+)p", 1))
    return joined_text(pages, ["vol"], "pageid", "body").select("vol", F.length("text").cast("long").alias("letters"), F.substring(F.md5("text"), 1, 12).alias("digest"))


def word_index(spark: SparkSession, d: str) -> DataFrame:
    return inverted_index(table(spark, d, "documents"), "doc_id", "text")


def word_in_context_all(spark: SparkSession, d: str) -> DataFrame:
    """The word in documents of any language; whose SQL is fixed, has those marked as French."""
    return in_context(table(spark, d, "documents"), "doc_id", "text", F.col("word").startswith("rossi")).withColumn("pos", F.col("pos").cast("long"))


def search_folded(spark: SparkSession, d: str) -> DataFrame:
    return folded_filter(table(spark, d, "chansons").select("chanson_id", "incipit").where("incipit IS NOT NULL"), "incipit", "Ai Las")


def letter_buckets(spark: SparkSession, d: str) -> DataFrame:
    return buckets(table(spark, d, "siglum_list"), "title", F.col("category") == "periodical")


QUERIES = {f.__name__: f for f in (token_counts, page_lines, line_kinds, paragraph_islands, fenced_verse, verse_numbers_read, note_residual, note_overflow, note_order, note_texts, overlay_merge, keys_without_base, word_heal, open_pages, section_spans, manifest_pager, printed_carry, printed_join, kind_counts, quotes_in_notes_all, headings_apart, page_links, document_text, word_index, word_in_context_all, search_folded, letter_buckets)}

_HEAD = "(regexp_matches(line, '^#{1,6} ') OR (length(line) <= 64 AND regexp_matches(line, '^[^\\p{Ll}]*\\p{Lu}{2}[^\\p{Ll}]*$')))"
_ISLANDS = f"SELECT *, CAST(sum(CASE WHEN line = '' THEN 1 ELSE 0 END) OVER (PARTITION BY file_name ORDER BY no) AS BIGINT) AS island FROM ({LINES})"
_FENCE = f"""SELECT file_name, no, line FROM (SELECT *, last_value(CASE WHEN regexp_matches(line, '^:::\\s*\\{{') THEN 1 WHEN regexp_matches(line, '^:::\\s*$') THEN 0 END IGNORE NULLS)
  OVER (PARTITION BY file_name ORDER BY no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS o FROM ({LINES})) WHERE o = 1 AND NOT starts_with(line, ':::')"""
_FAULTS = f"""SELECT file_name, label, 'dangling' AS fault FROM ({MARKS}) a WHERE NOT def AND NOT EXISTS (SELECT 1 FROM ({MARKS}) b WHERE b.def AND b.file_name = a.file_name AND b.label = a.label)
UNION ALL SELECT file_name, label, 'orphan' FROM ({MARKS}) a WHERE def AND NOT EXISTS (SELECT 1 FROM ({MARKS}) b WHERE NOT b.def AND b.file_name = a.file_name AND b.label = a.label)"""
SQL = {
    "token_counts": "SELECT lang, count(*) AS tokens, count(DISTINCT word) AS different FROM (SELECT lang, unnest(regexp_extract_all(lower(text), '\\p{L}+')) AS word FROM documents) GROUP BY lang",
    "page_lines": f"SELECT file_name, count(*) AS lines, count(*) FILTER (line = '') AS blank, max(length(line)) AS longest FROM ({LINES}) GROUP BY 1",
    "line_kinds": f"""SELECT CASE WHEN starts_with(line, '<!-- page:') THEN 'anchor' WHEN regexp_matches(line, '^\\[\\^[^\\]]+\\]:') THEN 'definition' WHEN starts_with(line, ':::') THEN 'fence'
      WHEN regexp_matches(line, '^\\s*(-{{3,}}|\\*{{3,}})\\s*$') THEN 'rule' WHEN regexp_matches(line, '^\\s*[+*]\\s*$') THEN 'star' WHEN regexp_matches(line, '^\\s*$') THEN 'blank' WHEN {_HEAD} THEN 'heading' ELSE 'text' END AS kind, count(*) AS lines FROM ({LINES}) GROUP BY 1""",
    "paragraph_islands": f"SELECT file_name, island, min(no) AS first, max(no) AS last, CAST(sum(length(line)) AS BIGINT) AS letters FROM ({_ISLANDS}) WHERE line <> '' GROUP BY 1, 2",
    "fenced_verse": f"SELECT file_name, count(*) AS verses, min(no) AS first, arg_min(line, no) AS incipit FROM ({_FENCE}) GROUP BY 1",
    "verse_numbers_read": f"""WITH v AS (SELECT file_name, no, row_number() OVER w AS pos, CAST(nullif(regexp_extract(trim(line), '^([0-9]{{1,9}})\\s*[.·]\\s', 1), '') AS BIGINT) AS g FROM ({_FENCE}) WHERE trim(line) <> '' WINDOW w AS (PARTITION BY file_name ORDER BY no)),
      u AS (SELECT *, last_value(g IGNORE NULLS) OVER w AS base, last_value(CASE WHEN g IS NOT NULL THEN pos END IGNORE NULLS) OVER w AS seat FROM v WINDOW w AS (PARTITION BY file_name ORDER BY no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
      SELECT file_name, no, coalesce(base + pos - seat, pos) AS verse FROM u""",
    "note_residual": f"SELECT file_name, label, fault, count(*) AS times FROM ({_FAULTS}) GROUP BY ALL",
    "note_overflow": f"""WITH f AS (SELECT *, regexp_extract(file_name, 'v(\\d+)p', 1) AS vol, CAST(regexp_extract(file_name, 'p(\\d+)\\.md', 1) AS INTEGER) AS idx FROM ({_FAULTS})),
      d AS (SELECT *, row_number() OVER (PARTITION BY vol, idx ORDER BY label) AS r FROM f WHERE fault = 'dangling'), o AS (SELECT *, row_number() OVER (PARTITION BY vol, idx ORDER BY label) AS r FROM f WHERE fault = 'orphan')
      SELECT d.vol, d.idx, d.label, o.label AS next_label FROM d JOIN o ON d.vol = o.vol AND d.idx + 1 = o.idx AND d.r = o.r""",
    "note_order": f"""WITH r AS (SELECT file_name, label, row_number() OVER (PARTITION BY file_name ORDER BY no, i) AS place, count(*) OVER (PARTITION BY file_name) AS n FROM ({MARKS.replace("AS def", "AS def, i")}) WHERE NOT def),
      d AS (SELECT file_name, label, row_number() OVER (PARTITION BY file_name ORDER BY no) AS place, count(*) OVER (PARTITION BY file_name) AS n FROM ({MARKS}) WHERE def)
      SELECT r.file_name, r.place, r.label AS ref, d.label AS def FROM r JOIN d ON r.file_name = d.file_name AND r.place = d.place AND r.n = d.n""",
    "note_texts": f"""WITH n AS (SELECT file_name, regexp_extract(line, '^\\[\\^([^\\]]+)\\]', 1) AS label, arg_max(regexp_replace(line, '^\\[\\^[^\\]]+\\]: ?', ''), no) AS note FROM ({LINES}) WHERE regexp_matches(line, '^\\[\\^[^\\]]+\\]:') GROUP BY 1, 2)
      SELECT r.file_name, r.label, note FROM (SELECT DISTINCT file_name, label FROM ({MARKS}) WHERE NOT def) r LEFT JOIN n ON r.file_name = n.file_name AND r.label = n.label""",
    "overlay_merge": "SELECT b.pageid, CASE WHEN o.pageid IS NULL THEN 'base' ELSE 'overlay' END AS provenance, length(CASE WHEN o.pageid IS NULL THEN b.body ELSE o.body END) AS letters FROM page_files b LEFT JOIN (SELECT * FROM page_files WHERE provenance = 'overlay') o ON b.pageid = o.pageid WHERE b.provenance = 'base'",
    "keys_without_base": "SELECT DISTINCT 'transcription' AS \"of\", pageid FROM page_files WHERE provenance = 'overlay' AND pageid NOT IN (SELECT pageid FROM page_files WHERE provenance = 'base') UNION SELECT 'number', pageid FROM page_numbers WHERE pageid NOT IN (SELECT pageid FROM manifest)",
    "section_spans": """WITH m AS (SELECT vol, idx, min(kind) AS kind FROM manifest GROUP BY 1, 2), b AS (SELECT *, lag(kind) OVER (PARTITION BY vol ORDER BY idx) AS p, coalesce(min(CASE WHEN kind IN ('bibliographie', 'index', 'table-matieres') THEN idx END) OVER (PARTITION BY vol) - 1, max(idx) OVER (PARTITION BY vol)) AS bound FROM m)
      SELECT vol, idx, kind, coalesce(lead(idx) OVER (PARTITION BY vol ORDER BY idx) - 1, bound) AS until FROM b WHERE p IS NULL OR p <> kind""",
    "word_heal": """WITH p AS (SELECT regexp_extract(pageid, '^v(\\d+)p', 1) AS vol, pageid, regexp_replace(body, '\\s+$', '') AS body FROM page_files WHERE provenance = 'base'),
      w AS (SELECT *, regexp_extract(lead(body) OVER (PARTITION BY vol ORDER BY pageid), '^(\\S+)', 1) AS nx, coalesce(regexp_matches(lag(body) OVER (PARTITION BY vol ORDER BY pageid), '([\\p{L}0-9]+)-$'), false) AS bf FROM p),
      o AS (SELECT *, CASE WHEN bf THEN regexp_replace(body, '^\\S+\\s*', '') ELSE body END AS own FROM w),
      h AS (SELECT pageid, body, CASE WHEN regexp_matches(body, '([\\p{L}0-9]+)-$') AND coalesce(nx, '') <> '' THEN regexp_replace(own, '-$', '') || nx ELSE own END AS healed FROM o)
      SELECT pageid, right(healed, 20) AS ending, length(healed) AS letters FROM h WHERE healed <> body""",
    "open_pages": """WITH p AS (SELECT regexp_extract(pageid, '^v(\\d+)p', 1) AS vol, pageid, regexp_matches(regexp_replace(regexp_replace(body, '(\\[\\^[^\\]]*\\])+\\s*$', ''), '[»")\\]*\\s]+$', ''), '[.!?…:]$') AS closed FROM page_files WHERE provenance = 'base' AND body <> '')
      SELECT pageid, closed, coalesce(NOT lag(closed) OVER (PARTITION BY vol ORDER BY pageid), false) AS goes_on FROM p""",
    "manifest_pager": "SELECT page_order, pageid, lag(pageid) OVER w AS previous, lead(pageid) OVER w AS following FROM (SELECT DISTINCT vol, page_order, pageid, file_name FROM manifest) WINDOW w AS (PARTITION BY vol ORDER BY page_order, file_name)",
    "printed_carry": "SELECT vol, idx, last_value(nullif(printed, '') IGNORE NULLS) OVER (PARTITION BY vol ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS carried FROM (SELECT vol, idx, max(printed) AS printed FROM manifest GROUP BY 1, 2)",
    "printed_join": "SELECT m.pageid, kind, coalesce(n, '') AS printed FROM (SELECT DISTINCT pageid, kind FROM manifest) m LEFT JOIN (SELECT pageid, max(printed_number) AS n FROM page_numbers GROUP BY 1) p ON m.pageid = p.pageid",
    "kind_counts": "SELECT kind, count(*) AS pages, count(*) FILTER (printed = '') AS unnumbered FROM manifest GROUP BY 1",
    "quotes_in_notes_all": f"""SELECT DISTINCT file_name, no, q.at + 1 AS "at", q.found AS quote FROM (SELECT file_name, no, unnest(list_filter(stars, lambda q: len(list_filter(spans, lambda s: s.at <= q.at AND q.at < s.at + length(s.found))) = 0)) AS q FROM (
      SELECT file_name, no, {sql_spots("line", "[*][^*]+[*]")} AS stars, {sql_spots("line", "[(][^)]+[)]")} AS spans FROM ({LINES})))""",
    "headings_apart": f"SELECT file_name, no, line FROM ({LINES}) h WHERE {_HEAD} AND NOT EXISTS (SELECT 1 FROM ({LINES}) n WHERE n.file_name = h.file_name AND regexp_matches(n.line, '\\[\\^') AND abs(n.no - h.no) <= 2)",
    "page_links": f"""WITH f AS (SELECT DISTINCT file_name, CAST(regexp_extract(file_name, 'v(\\d+)p', 1) AS INTEGER) AS vol, unnest(regexp_extract_all(line, 'p\\. ([0-9]+)', 1)) AS printed FROM ({LINES})),
      t AS (SELECT vol, printed, arg_max(pageid, page_order) AS target FROM manifest WHERE printed <> '' GROUP BY 1, 2) SELECT file_name, f.printed, target FROM f JOIN t ON f.vol = t.vol AND f.printed = t.printed""",
    "document_text": "SELECT vol, length(text) AS letters, substr(md5(text), 1, 12) AS digest FROM (SELECT regexp_extract(pageid, '^v(\\d+)p', 1) AS vol, string_agg(body, chr(10) || chr(10) ORDER BY pageid, body) AS text FROM page_files WHERE provenance = 'base' GROUP BY 1)",
    "word_index": f"SELECT word, count(*) AS uses, count(DISTINCT doc_id) AS places FROM ({WORDS}) GROUP BY 1",
    "word_in_context_all": f"""WITH w AS ({WORDS}), c AS (SELECT doc_id, pos, word, array_to_string(list(word) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), ' ') AS before,
      array_to_string(list(word) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING), ' ') AS after FROM w) SELECT doc_id, pos, word, coalesce(before, '') AS before, coalesce(after, '') AS after FROM c WHERE starts_with(word, 'rossi')""",
    "search_folded": "SELECT chanson_id, incipit FROM chansons WHERE contains(regexp_replace(lower(translate(incipit, 'àâäáãåçéèêëíìîïñóòôöõúùûüýÿÀÂÄÁÃÅÇÉÈÊËÍÌÎÏÑÓÒÔÖÕÚÙÛÜÝ', 'aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY')), '[^a-z0-9]+', '', 'g'), 'ailas')",
    "letter_buckets": "SELECT upper(substr(regexp_replace(lower(strip_accents(title)), '[^a-z0-9]+', '', 'g'), 1, 1)) AS letter, count(*) FILTER (category = 'periodical') AS shown, count(*) AS total, bool_or(category = 'periodical') AS visible FROM siglum_list GROUP BY 1",
}
