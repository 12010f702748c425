"""Queries on verses, the words of indexes and the verses they mean, witnesses, songs and their order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafwork.functions.edition import REF_START, hanging_indent, lemma_and_reference, printed_label
from leafwork.functions.rules import quoted
from leafwork.functions.text import common_prefix, fold_key, from_roman
from leafwork.operators.match import best
from leafwork.operators.ordered import carry_number, fenced, islands
from leafwork.plans.index import _VALUE
from leafwork.plans.layout import _BLOCKS, _FENCED, SQL_PLACE, blocks, placed
from leafwork.plans.pages import LINES, _lines
from leafwork.plans.records import _FOLD
from leafwork.sources.tables import table

NUMBERED = r"^([0-9]{1,9})\s*[.·]\s+"


def strophes(spark: SparkSession, d: str) -> DataFrame:
    """file_name, no, strophe, verse, text: the verses of every page; a blank line or a fence begins a strophe, a printed number is a verse's own, others count on."""
    rows = fenced(_lines(spark, d), ["file_name"], ["no"], "line")
    breaks = F.col("line").rlike(r"^\s*:{3,}") | (F.col("inside") & (F.trim("line") == ""))
    rows = islands(rows, ["file_name"], ["no"], breaks, "part").where("inside AND trim(line) <> ''")
    strophe = F.dense_rank().over(Window.partitionBy("file_name").orderBy("part"))
    given = F.nullif(F.regexp_extract(F.trim("line"), NUMBERED, 1), F.lit(""))
    rows = carry_number(rows.withColumn("strophe", strophe.cast("long")), ["file_name"], ["no"], given, "verse")
    return rows.select("file_name", "no", "strophe", "verse", F.regexp_replace(F.trim("line"), NUMBERED, "").alias("text"))


def song_strophes(spark: SparkSession, d: str) -> DataFrame:
    """Each strophe's verses and first words."""
    return strophes(spark, d).groupBy("file_name", "strophe").agg(F.count(F.lit(1)).alias("verses"), F.min("verse").alias("first"), F.max("verse").alias("last"), F.min_by("text", "no").alias("incipit"))


def strophe_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Strophes and the paragraphs behind them: within a run of strophes and the run of paragraphs that follows, one to one if there are as many of both."""
    rows = blocks(spark, d).where("kind <> 'note'").select("file_name", "island", "kind")
    w = Window.partitionBy("file_name").orderBy("island")
    rows = rows.withColumns({"before": F.lag("kind").over(w), "gap": F.col("island") - F.lag("island").over(w)})
    # Verses of one strophe follow each other; a strophe or a paragraph is a unit, and a verse behind a paragraph begins a group.
    unit = F.sum((F.coalesce(F.col("before") != "verse", F.lit(True)) | (F.col("kind") != "verse") | (F.col("gap") > 1)).cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    group = F.sum(((F.col("kind") == "verse") & F.coalesce(F.col("before") != "verse", F.lit(True))).cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    units = rows.withColumns({"unit": unit, "grp": group}).where("grp > 0").groupBy("file_name", "grp", "unit").agg(F.min("kind").alias("kind"), F.min("island").alias("island"))
    place = F.row_number().over(Window.partitionBy("file_name", "grp", "kind").orderBy("unit"))
    units = units.withColumns({"place": place.cast("long"), "of": F.count(F.lit(1)).over(Window.partitionBy("file_name", "grp", "kind"))})
    side = lambda kind, name: units.where(F.col("kind") == kind).select("file_name", "grp", "place", "of", F.col("island").alias(name))
    return side("verse", "strophe").join(side("paragraph", "translation"), ["file_name", "grp", "place", "of"]).select("file_name", "grp", "place", "strophe", "translation")


def index_words(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, no, vol, lemma, ref: the entries of the word indexes, one a line, cut at the reference; the volume is that of the index's page."""
    rows = table(spark, d, "documents").select("doc_id", F.regexp_extract(F.coalesce("pageid", F.lit("")), r"^v(\d+)p", 1).alias("vol"), F.posexplode(F.split("text", "\n")).alias("no", "line"))
    rows = rows.where(F.col("line").rlike(r"^\p{L}[^0-9=;:.]* \(?[IVXLC]{1,8}\s*,"))
    return rows.select("doc_id", F.col("no").cast("long").alias("no"), F.nullif("vol", F.lit("")).cast("int").alias("vol"), lemma_and_reference(F.col("line")).alias("e")).select("doc_id", "no", "vol", "e.lemma", "e.ref").where("lemma <> ''")


def references(words: DataFrame) -> DataFrame:
    """Rows of ``words`` for each verse named: song, label, verse; ``passim`` and ``14 ×`` name a song without verse, and references to other places in parentheses are left out."""
    chunks = words.select("doc_id", "no", "vol", "lemma", F.explode(F.split("ref", ";")).alias("chunk"))
    rest = F.trim(F.regexp_extract(F.trim("chunk"), r"^([IVXLC]{1,8})\s*,\s*(.*)$", 2))
    rows = chunks.select("doc_id", "no", "vol", "lemma", F.regexp_extract(F.trim("chunk"), r"^([IVXLC]{1,8})\s*,\s*(.*)$", 1).alias("song"), rest.alias("rest")).where("song <> ''")
    times = F.regexp_extract("rest", r"^\(?\s*(\d+)\s*[x×]\s*\)?", 1)
    bare = F.regexp_replace("rest", r"(?i)\(\s*(?:v\.|voir|cf\.)[^)]*\)", "")
    labels = F.when(F.lower("rest").contains("passim") & ~F.col("rest").rlike("[0-9]"), F.array(F.lit("passim"))).when(times != "", F.array(F.concat(times, F.lit(" ×")))).otherwise(F.regexp_extract_all(bare, F.lit(r"\d+(?:\([a-z0-9]\))?"), F.lit(0)))
    rows = rows.select("doc_id", "no", "vol", "lemma", "song", F.explode(labels).alias("label"))
    return rows.withColumn("verse", F.when(F.col("label").rlike(r"^\d+(\([a-z0-9]\))?$"), F.regexp_extract("label", r"^(\d+)", 1).cast("int")))


def concordance(spark: SparkSession, d: str) -> DataFrame:
    """Entries of the word indexes with their songs, verses, letter and the forms they are searched by."""
    rows = references(index_words(spark, d)).groupBy("doc_id", "no", "lemma").agg(F.countDistinct("song").alias("songs"), F.count(F.lit(1)).alias("places"))
    return rows.select("doc_id", "no", "lemma", F.upper(F.substring(fold_key(F.col("lemma")), 1, 1)).alias("letter"), "songs", "places", fold_key(F.col("lemma")).alias("search"))


def mark_rank(token: Column, form: Column) -> Column:
    """How well a word answers a form: 1000 and its length the same, 500 a longer word that begins so, 200 a shorter, else the letters shared; null below what its length asks."""
    shared, n = common_prefix(token, form), F.length(form)
    least = F.when(n <= 4, n).otherwise(F.greatest(F.lit(4), F.ceil(n * 0.6)))
    rank = F.when(token == form, 1000 + n).when(shared == n, 500 + shared).when(shared == F.length(token), 200 + shared).otherwise(shared)
    return F.when((token != "") & (form != "") & ((token == form) | (shared >= least)), rank)


def concordance_marks(spark: SparkSession, d: str) -> DataFrame:
    """Each verse an index names, with the word in it that answers the lemma, and why there is none.

    Verses are those of the song's pages in the volume of the index, counted
    through the song; the last of two equal numbers counts. An index without
    page has no verses.
    """
    uses = references(index_words(spark, d)).where("vol IS NOT NULL AND verse IS NOT NULL").withColumn("num", from_roman(F.col("song")).cast("int"))
    songs = table(spark, d, "chansons").groupBy("vol", "num").agg(F.min_by("texte.pages", "chanson_id").alias("pages")).select("vol", "num", F.posexplode("pages").alias("at", "pageid"))
    files = table(spark, d, "page_files").where("provenance = 'base'").select("file_name", "pageid")
    lines = songs.join(files, "pageid").join(strophes(spark, d).select("file_name", "no", "text"), "file_name")
    lines = lines.withColumn("verse", F.row_number().over(Window.partitionBy("vol", "num").orderBy("at", "no")))
    rows = uses.join(lines.select("vol", "num", "verse", "text"), ["vol", "num", "verse"], "left")
    form = fold_key(F.col("lemma"))
    words = F.filter(F.transform(F.regexp_extract_all("text", F.lit(r"\p{L}+"), F.lit(0)), lambda t, i: F.struct(mark_rank(fold_key(t), form).alias("rank"), (-i).alias("i"), t.alias("word"))), lambda x: x["rank"].isNotNull())
    rows = rows.withColumn("mark", F.array_max(words)["word"])
    why = F.when(F.col("text").isNull(), "no verse").when(F.col("mark").isNull(), "unmarked").otherwise("marked")
    return rows.select("doc_id", "no", "song", "label", "mark", why.alias("state"))


def verse_references(spark: SparkSession, d: str) -> DataFrame:
    """Verses that pages refer to, numbers of 1 to 160 only, and whether the volume has a verse of that number on any page."""
    found = table(spark, d, "page_files").select("file_name", F.explode(F.regexp_extract_all("body", F.lit(r"\(v\. ?(\d{1,4})\)"), F.lit(1))).alias("n")).withColumn("verse", F.col("n").cast("long")).where("verse BETWEEN 1 AND 160").transform(placed)
    have = strophes(spark, d).transform(placed).select("vol", "verse").distinct().withColumn("there", F.lit(True))
    return found.groupBy("file_name", "vol", "verse").agg(F.count(F.lit(1)).alias("times")).join(have, ["vol", "verse"], "left").select("file_name", "verse", "times", F.coalesce("there", F.lit(False)).alias("there"))


def witnesses(spark: SparkSession, d: str) -> DataFrame:
    """Witnesses that definitions name and the apparatus knows: a letter with 2 means that witness if there is one, else the letter; case counts."""
    named = table(spark, d, "citations").where("definition LIKE 'chansonniers %'").select("rec_id", F.regexp_extract("definition", r"^chansonniers ([A-Z0-9²^]+)", 1).alias("sigla")).distinct()
    tokens = named.select("rec_id", F.explode(F.regexp_extract_all("sigla", F.lit(r"[A-Z](?:\^?[2²]\^?)?"), F.lit(0))).alias("token"))
    tokens = tokens.select("rec_id", "token", F.substring("token", 1, 1).alias("letter"), F.when(F.col("token").rlike("[2²]"), F.concat(F.substring("token", 1, 1), F.lit("2"))).alias("second"))
    rows = table(spark, d, "documents").where("source = 'apparatus'").select(F.explode(F.regexp_extract_all("text", F.lit(r"(?m)^([A-Z][A-Z²]*)[;\t ]"), F.lit(1))).alias("cell"))
    known = rows.select(F.explode(F.regexp_extract_all("cell", F.lit("[A-Z]²?"), F.lit(0))).alias("k")).select(F.replace("k", F.lit("²"), F.lit("2")).alias("key")).distinct()
    out = tokens.join(known.toDF("second").withColumn("k2", F.col("second")), "second", "left").join(known.toDF("letter").withColumn("k1", F.col("letter")), "letter", "left")
    return out.groupBy("token", F.coalesce("k2", "k1").alias("witness")).agg(F.count(F.lit(1)).alias("records"))


def song_navigation(spark: SparkSession, d: str) -> DataFrame:
    """Songs with their label, pages, printed numbers, neighbours in the volume and the works its bibliography has on those pages."""
    printed = table(spark, d, "manifest").where("printed <> ''").groupBy("pageid").agg(F.max_by("printed", "page_order").alias("printed"))
    songs = table(spark, d, "chansons").select("chanson_id", "vol", "num", "roman", "incipit", F.concat(F.coalesce("remarques.pages", F.array().cast("array<string>")), F.coalesce("texte.pages", F.array().cast("array<string>"))).alias("pages"))
    ends = songs.select("chanson_id", F.posexplode("pages").alias("i", "pageid")).join(printed, "pageid").groupBy("chanson_id").agg(F.min_by("printed", "i").alias("first"), F.max_by("printed", "i").alias("last"))
    w = Window.partitionBy("vol").orderBy("num", "chanson_id")
    rows = songs.withColumns({"before": F.lag("roman").over(w), "after": F.lead("roman").over(w)}).join(ends, "chanson_id", "left")
    works = table(spark, d, "bibliography_entry").groupBy("vol").agg(F.count(F.lit(1)).alias("works"))
    label = F.concat_ws(". ", "roman", "incipit")
    return rows.join(works, "vol", "left").select("chanson_id", label.alias("label"), F.size("pages").cast("long").alias("pages"), printed_label(F.col("first"), F.col("last")).alias("printed"), "before", "after", F.coalesce("works", F.lit(0)).alias("works"))


def page_notes(spark: SparkSession, d: str) -> DataFrame:
    """Every page with the labels of its notes nested in their order, and how many there are."""
    rows = _lines(spark, d).where(F.col("line").rlike(r"^\[\^[^\]]+\]:")).select("file_name", "no", F.regexp_extract("line", r"^\[\^([^\]]+)\]", 1).alias("label"))
    nested = rows.groupBy("file_name").agg(F.array_sort(F.collect_list(F.struct("no", "label"))).alias("notes"))
    return table(spark, d, "page_files").select("file_name").join(nested, "file_name", "left").select("file_name", F.coalesce(F.array_join(F.transform("notes", lambda x: x["label"]), " "), F.lit("")).alias("labels"), F.greatest(F.coalesce(F.size("notes"), F.lit(0)), F.lit(0)).cast("long").alias("n"))


def siglum_order(spark: SparkSession, d: str) -> DataFrame:
    """Sigla of a category in the order of a reader: accents and case aside, numbers by value."""
    padded = F.regexp_replace(F.regexp_replace("siglum", r"([0-9]+)", "00000000$1"), r"0*([0-9]{8})([^0-9]|$)", "$1$2")
    w = Window.partitionBy("category").orderBy(fold_key(padded), "siglum")
    return table(spark, d, "siglum_list").select("siglum", "category", F.row_number().over(w).cast("long").alias("place"))


def longest_first(spark: SparkSession, d: str) -> DataFrame:
    """The sigla of each category as one alternation, longest first, so that none hides a longer one."""
    rows = table(spark, d, "siglum_list").groupBy("category").agg(F.array_sort(F.collect_list(F.struct((-F.length("siglum")).alias("n"), "siglum"))).alias("s"))
    return rows.select("category", F.array_join(F.transform("s", lambda x: x["siglum"]), "|").alias("pattern"))


def usage_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages of each use of a siglum, short ids first, then by text."""
    rows = table(spark, d, "siglum_usage").select("vol", "siglum", F.explode("pages").alias("p")).distinct().groupBy("vol", "siglum").agg(F.array_sort(F.collect_list(F.struct(F.length("p").alias("n"), "p"))).alias("s"))
    return rows.select("vol", "siglum", F.array_join(F.transform("s", lambda x: x["p"]), " ").alias("pages"))


def usage_spread(spark: SparkSession, d: str) -> DataFrame:
    """Sigla of a volume on an axis of uses: equal ones share a rank and are fanned out by how many pages they are on, and each has its height on a scale."""
    t = table(spark, d, "siglum_usage").groupBy("vol", "siglum").agg(F.sum("uses").alias("uses"), F.sum(F.size("pages")).alias("on"))
    tie = Window.partitionBy("vol", "uses")
    cote = F.dense_rank().over(Window.partitionBy("vol").orderBy("uses"))
    t = t.withColumns({"cote": cote, "fan": (F.row_number().over(tie.orderBy(F.desc("on"), "siglum")) - 1 - (F.count(F.lit(1)).over(tie) - 1) / 2) * 15})
    top = F.max("cote").over(Window.partitionBy("vol"))
    height = F.when(top > 1, 40 + 372 * (1 - (F.col("cote") - 1) / (top - 1))).otherwise(F.lit(40.0))
    return t.select("vol", "siglum", F.col("cote").cast("long").alias("cote"), F.col("fan").cast("double").alias("fan"), F.round(height, 3).alias("height"))


def flag_order(spark: SparkSession, d: str) -> DataFrame:
    """Records without what they should have, numbered by category, volume and key, the key as text."""
    c = table(spark, d, "citations").select("rec_id", "vol", F.explode(F.array(F.when(F.col("siglum").isNull(), F.lit("no siglum")), F.when(F.col("definition").isNull(), F.lit("no definition")), F.when(F.col("printed").isNull(), F.lit("no page")))).alias("category")).where("category IS NOT NULL").distinct()
    place = F.row_number().over(Window.partitionBy("category", "vol").orderBy(F.col("rec_id").cast("string")))
    return c.select("category", "vol", "rec_id", place.cast("long").alias("place"))


def hanging_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines with a colon among the first letters, and the width their continuation hangs at."""
    rows = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("no", "line")).where(F.col("line").rlike(r"^[^:]{1,40}:"))
    return rows.groupBy("doc_id", hanging_indent(F.col("line")).cast("long").alias("indent")).agg(F.count(F.lit(1)).alias("lines"))


def first_sources(spark: SparkSession, d: str) -> DataFrame:
    """Documents of a siglum and page as one: how many, and the source of the first that has a language."""
    t = table(spark, d, "documents").where("siglum IS NOT NULL AND pageid IS NOT NULL")
    return t.groupBy("siglum", "pageid").agg(F.count(F.lit(1)).alias("documents"), F.min_by("source", F.when(F.col("lang").isNotNull(), F.col("doc_id"))).alias("source"))


def commonest_form(spark: SparkSession, d: str) -> DataFrame:
    """Of each siglum of a volume the definition most records have; the first text on a tie."""
    t = table(spark, d, "citations").where("siglum IS NOT NULL AND definition IS NOT NULL").groupBy("vol", "siglum", "definition").agg(F.countDistinct("rec_id").alias("records"))
    return best(t, ["vol", "siglum"], [F.col("records")], [F.col("definition")], ["definition", "records"])


def index_page_links(spark: SparkSession, d: str) -> DataFrame:
    """Pages that indexes of names refer to by printed numbers, in the volume of the index; a number of no page has none."""
    rows = table(spark, d, "documents").where("pageid IS NOT NULL").select("doc_id", F.regexp_extract("pageid", r"^v(\d+)p", 1).alias("vol"), F.explode(F.split("text", "\n")).alias("line"))
    rows = rows.where(F.col("line").rlike(r"^\p{Lu}[^0-9]* [0-9]{1,3}(?:, [0-9]{1,3})*\.?$")).select("doc_id", F.expr("try_cast(vol AS INT)").alias("vol"), F.trim(F.regexp_extract("line", "^([^0-9]*)", 1)).alias("name"), F.explode(F.regexp_extract_all("line", F.lit("[0-9]+"), F.lit(0))).alias("printed"))
    at = table(spark, d, "manifest").where("printed <> ''").groupBy("vol", "printed").agg(F.max_by("pageid", "page_order").alias("target"))
    return rows.join(at, ["vol", "printed"], "left").groupBy("doc_id", "name", "printed", "target").agg(F.count(F.lit(1)).alias("times"))


def siglum_references(spark: SparkSession, d: str) -> DataFrame:
    """Sigla of the list in the evidence of citations, those set before a page apart: the word is taken whole, with its stops or without."""
    token = r"[\p{L}][\p{L}0-9.²\-]*(?: ?,? ?pp?\.)?"
    found = table(spark, d, "citations").where("evidence IS NOT NULL").select("rec_id", F.explode(F.regexp_extract_all("evidence", F.lit(token), F.lit(0))).alias("t"))
    rows = found.select("rec_id", F.regexp_replace("t", r" ?,? ?pp?\.$", "").alias("word"), F.col("t").rlike(r"[ ,]pp?\.$").alias("page"))
    known = table(spark, d, "siglum_list").select("siglum")
    exact = rows.join(known, rows["word"] == known["siglum"])
    bare = rows.join(known, rows["word"] == known["siglum"], "left_anti").withColumn("short", F.regexp_replace("word", r"\.+$", ""))
    short = bare.join(known, bare["short"] == known["siglum"]).drop("short")
    return exact.unionByName(short).groupBy("siglum").agg(F.count(F.lit(1)).alias("times"), F.count_if("page").alias("before_page"), F.countDistinct("rec_id").alias("records"))


QUERIES = {f.__name__: f for f in (song_strophes, strophe_pairs, concordance, concordance_marks, verse_references, witnesses, song_navigation, page_notes, siglum_order, longest_first, usage_pages, usage_spread, flag_order, hanging_lines, first_sources, commonest_form, index_page_links, siglum_references)}

_STROPHES = f"""SELECT file_name, no, CAST(dense_rank() OVER (PARTITION BY file_name ORDER BY part) AS BIGINT) AS strophe, row_number() OVER (PARTITION BY file_name ORDER BY no) AS pos, CAST(nullif(regexp_extract(trim(line), {quoted(NUMBERED)}, 1), '') AS BIGINT) AS g, regexp_replace(trim(line), {quoted(NUMBERED)}, '') AS text FROM (
  SELECT *, sum(CASE WHEN regexp_matches(line, '^\\s*:{{3,}}') OR (inside AND trim(line) = '') THEN 1 ELSE 0 END) OVER (PARTITION BY file_name ORDER BY no) AS part FROM ({_FENCED} FROM ({LINES}))) WHERE inside AND trim(line) <> ''"""
_VERSES = f"""SELECT file_name, no, strophe, text, coalesce(base + pos - seat, pos) AS verse FROM (SELECT *, last_value(g IGNORE NULLS) OVER w AS base, last_value(CASE WHEN g IS NOT NULL THEN pos END IGNORE NULLS) OVER w AS seat FROM ({_STROPHES}) WINDOW w AS (PARTITION BY file_name ORDER BY no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""
_WORDS = f"""SELECT doc_id, no, CAST(nullif(vol, '') AS INTEGER) AS vol, trim(CASE WHEN regexp_matches(line, {quoted(REF_START)}) THEN regexp_extract(line, {quoted(REF_START)}, 1) ELSE line END) AS lemma, trim(regexp_extract(line, {quoted(REF_START)}, 2)) AS ref FROM (
  SELECT doc_id, vol, generate_subscripts(l, 1) - 1 AS no, unnest(l) AS line FROM (SELECT doc_id, regexp_extract(coalesce(pageid, ''), '^v(\\d+)p', 1) AS vol, string_split(text, chr(10)) AS l FROM documents)) WHERE regexp_matches(line, '^\\p{{L}}[^0-9=;:.]* \\(?[IVXLC]{{1,8}}\\s*,')"""
_USES = f"""SELECT doc_id, no, vol, lemma, song, label, CASE WHEN regexp_matches(label, '^\\d+(\\([a-z0-9]\\))?$') THEN CAST(regexp_extract(label, '^(\\d+)', 1) AS INTEGER) END AS verse FROM (SELECT doc_id, no, vol, lemma, song, unnest(CASE WHEN contains(lower(rest), 'passim') AND NOT regexp_matches(rest, '[0-9]') THEN ['passim']
    WHEN regexp_extract(rest, '^\\(?\\s*(\\d+)\\s*[x×]\\s*\\)?', 1) <> '' THEN [regexp_extract(rest, '^\\(?\\s*(\\d+)\\s*[x×]\\s*\\)?', 1) || ' ×'] ELSE regexp_extract_all(regexp_replace(rest, '(?i)\\(\\s*(?:v\\.|voir|cf\\.)[^)]*\\)', '', 'g'), '\\d+(?:\\([a-z0-9]\\))?') END) AS label FROM (
  SELECT doc_id, no, vol, lemma, regexp_extract(trim(chunk), '^([IVXLC]{{1,8}})\\s*,\\s*(.*)$', 1) AS song, trim(regexp_extract(trim(chunk), '^([IVXLC]{{1,8}})\\s*,\\s*(.*)$', 2)) AS rest FROM (SELECT doc_id, no, vol, lemma, unnest(string_split(ref, ';')) AS chunk FROM ({_WORDS}) WHERE lemma <> '')) WHERE song <> '')"""
_UNITS = f"""SELECT file_name, grp, unit, min(kind) AS kind, min(island) AS island FROM (SELECT *, sum(CASE WHEN coalesce(bf <> 'verse', true) OR kind <> 'verse' OR gap > 1 THEN 1 ELSE 0 END) OVER w AS unit, CAST(sum(CASE WHEN kind = 'verse' AND coalesce(bf <> 'verse', true) THEN 1 ELSE 0 END) OVER w AS BIGINT) AS grp FROM (
  SELECT file_name, island, kind, lag(kind) OVER w AS bf, island - lag(island) OVER w AS gap FROM ({_BLOCKS}) WHERE kind <> 'note' WINDOW w AS (PARTITION BY file_name ORDER BY island)) WINDOW w AS (PARTITION BY file_name ORDER BY island)) WHERE grp > 0 GROUP BY 1, 2, 3"""
_T, _F = _FOLD.format("t"), _FOLD.format("lemma")
SQL = {
    "song_strophes": f"SELECT file_name, strophe, count(*) AS verses, min(verse) AS first, max(verse) AS last, arg_min(text, no) AS incipit FROM ({_VERSES}) GROUP BY 1, 2",
    "strophe_pairs": f"""WITH u AS (SELECT *, row_number() OVER (PARTITION BY file_name, grp, kind ORDER BY unit) AS place, count(*) OVER (PARTITION BY file_name, grp, kind) AS n FROM ({_UNITS}))
      SELECT a.file_name, a.grp, a.place, a.island AS strophe, b.island AS translation FROM u a JOIN u b ON a.file_name = b.file_name AND a.grp = b.grp AND a.place = b.place AND a.n = b.n WHERE a.kind = 'verse' AND b.kind = 'paragraph'""",
    "concordance": f"SELECT doc_id, no, lemma, upper(substr({_F}, 1, 1)) AS letter, count(DISTINCT song) AS songs, count(*) AS places, {_F} AS search FROM ({_USES}) GROUP BY doc_id, no, lemma",
    "concordance_marks": f"""WITH u AS (SELECT *, CAST({_VALUE} AS INTEGER) AS num FROM ({_USES}) WHERE vol IS NOT NULL AND verse IS NOT NULL), s AS (SELECT vol, num, generate_subscripts(p, 1) AS seat, unnest(p) AS pageid FROM (SELECT vol, num, arg_min(texte.pages, chanson_id) AS p FROM chansons GROUP BY 1, 2)),
      v AS (SELECT s.vol, s.num, row_number() OVER (PARTITION BY s.vol, s.num ORDER BY seat, no) AS verse, text FROM s JOIN page_files f ON f.pageid = s.pageid AND f.provenance = 'base' JOIN ({_STROPHES}) l ON l.file_name = f.file_name),
      j AS (SELECT u.*, v.text, row_number() OVER () AS rid FROM u LEFT JOIN v ON v.vol = u.vol AND v.num = u.num AND v.verse = u.verse), w AS (SELECT rid, generate_subscripts(ts, 1) AS i, unnest(ts) AS t, lemma FROM (SELECT rid, lemma, regexp_extract_all(text, '\\p{{L}}+') AS ts FROM j WHERE text IS NOT NULL)),
      k AS (SELECT rid, i, t, {_T} AS a, {_F} AS b FROM w), c AS (SELECT *, coalesce(list_max(list_filter(range(1, least(length(a), length(b)) + 1), lambda n: substr(a, 1, n) = substr(b, 1, n))), 0) AS cp FROM k),
      r AS (SELECT rid, t, i, CASE WHEN a = b THEN 1000 + length(b) WHEN cp = length(b) THEN 500 + cp WHEN cp = length(a) THEN 200 + cp ELSE cp END AS score FROM c WHERE a <> '' AND b <> '' AND (a = b OR cp >= CASE WHEN length(b) <= 4 THEN length(b) ELSE greatest(4, ceil(length(b) * 0.6)) END)),
      m AS (SELECT rid, t FROM (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY score DESC, i) AS n FROM r) WHERE n = 1)
      SELECT doc_id, no, song, label, m.t AS mark, CASE WHEN text IS NULL THEN 'no verse' WHEN m.t IS NULL THEN 'unmarked' ELSE 'marked' END AS state FROM j LEFT JOIN m ON j.rid = m.rid""",
    "verse_references": f"""WITH f AS (SELECT file_name, CAST(unnest(regexp_extract_all(body, '\\(v\\. ?(\\d{{1,4}})\\)', 1)) AS BIGINT) AS verse, {SQL_PLACE} FROM page_files), h AS (SELECT DISTINCT regexp_extract(file_name, 'v(\\d+)p', 1) AS vol, verse FROM ({_VERSES}))
      SELECT file_name, f.verse, count(*) AS times, h.verse IS NOT NULL AS there FROM f LEFT JOIN h ON h.vol = f.vol AND h.verse = f.verse WHERE f.verse BETWEEN 1 AND 160 GROUP BY file_name, f.verse, h.verse""",
    "witnesses": """WITH t AS (SELECT rec_id, unnest(regexp_extract_all(s, '[A-Z](?:\\^?[2²]\\^?)?')) AS token FROM (SELECT DISTINCT rec_id, regexp_extract(definition, '^chansonniers ([A-Z0-9²^]+)', 1) AS s FROM citations WHERE definition LIKE 'chansonniers %')),
      k AS (SELECT DISTINCT replace(unnest(regexp_extract_all(cell, '[A-Z]²?')), '²', '2') AS key FROM (SELECT unnest(regexp_extract_all(text, '(?m)^([A-Z][A-Z²]*)[;\\t ]', 1)) AS cell FROM documents WHERE source = 'apparatus'))
      SELECT token, coalesce(b.key, a.key) AS witness, count(*) AS records FROM t LEFT JOIN k a ON a.key = substr(token, 1, 1) LEFT JOIN k b ON regexp_matches(token, '[2²]') AND b.key = substr(token, 1, 1) || '2' GROUP BY 1, 2""",
    "song_navigation": """WITH p AS (SELECT pageid, arg_max(printed, page_order) AS printed FROM manifest WHERE printed <> '' GROUP BY 1), s AS (SELECT *, list_concat(coalesce(remarques.pages, []), coalesce(texte.pages, [])) AS pages FROM chansons),
      e AS (SELECT chanson_id, arg_min(printed, i) AS first, arg_max(printed, i) AS last FROM (SELECT chanson_id, generate_subscripts(pages, 1) AS i, unnest(pages) AS pageid FROM s) x JOIN p ON p.pageid = x.pageid GROUP BY 1), w AS (SELECT vol, count(*) AS works FROM bibliography_entry GROUP BY 1)
      SELECT s.chanson_id, concat_ws('. ', roman, incipit) AS label, len(pages) AS pages, CASE WHEN first IS NULL THEN '' WHEN first = last THEN 'p. ' || first ELSE 'pp. ' || first || '–' || last END AS printed, lag(roman) OVER o AS before, lead(roman) OVER o AS after, coalesce(works, 0) AS works
      FROM s LEFT JOIN e ON e.chanson_id = s.chanson_id LEFT JOIN w ON w.vol = s.vol WINDOW o AS (PARTITION BY s.vol ORDER BY num, s.chanson_id)""",
    "page_notes": f"SELECT file_name, coalesce(string_agg(label, ' ' ORDER BY no), '') AS labels, count(label) AS n FROM (SELECT file_name, no, CASE WHEN regexp_matches(line, '^\\[\\^[^\\]]+\\]:') THEN regexp_extract(line, '^\\[\\^([^\\]]+)\\]', 1) END AS label FROM ({LINES})) GROUP BY 1",
    "index_page_links": """WITH l AS (SELECT doc_id, TRY_CAST(regexp_extract(pageid, '^v(\\d+)p', 1) AS INTEGER) AS vol, unnest(string_split(text, chr(10))) AS line FROM documents WHERE pageid IS NOT NULL), r AS (SELECT doc_id, vol, trim(regexp_extract(line, '^([^0-9]*)', 1)) AS name, unnest(regexp_extract_all(line, '[0-9]+')) AS printed FROM l WHERE regexp_matches(line, '^\\p{Lu}[^0-9]* [0-9]{1,3}(?:, [0-9]{1,3})*\\.?$')),
      m AS (SELECT vol, printed, arg_max(pageid, page_order) AS target FROM manifest WHERE printed <> '' GROUP BY 1, 2) SELECT doc_id, name, r.printed, target, count(*) AS times FROM r LEFT JOIN m ON m.vol = r.vol AND m.printed = r.printed GROUP BY 1, 2, 3, 4""",
    "siglum_references": """WITH t AS (SELECT rec_id, unnest(regexp_extract_all(evidence, '[\\p{L}][\\p{L}0-9.²\\-]*(?: ?,? ?pp?\\.)?')) AS t FROM citations WHERE evidence IS NOT NULL), w AS (SELECT rec_id, regexp_replace(t, ' ?,? ?pp?\\.$', '') AS word, regexp_matches(t, '[ ,]pp?\\.$') AS page FROM t)
      SELECT siglum, count(*) AS times, count(*) FILTER (page) AS before_page, count(DISTINCT rec_id) AS records FROM w JOIN siglum_list s ON s.siglum = w.word OR (s.siglum = regexp_replace(w.word, '\\.+$', '') AND w.word NOT IN (SELECT siglum FROM siglum_list)) GROUP BY 1""",
    "siglum_order": f"SELECT siglum, category, row_number() OVER (PARTITION BY category ORDER BY {_FOLD.format(chr(0))}, siglum) AS place FROM siglum_list".replace(chr(0), "regexp_replace(regexp_replace(siglum, '([0-9]+)', '00000000\\1', 'g'), '0*([0-9]{8})([^0-9]|$)', '\\1\\2', 'g')"),
    "longest_first": "SELECT category, string_agg(siglum, '|' ORDER BY -length(siglum), siglum) AS pattern FROM siglum_list GROUP BY 1",
    "usage_pages": "SELECT vol, siglum, string_agg(p, ' ' ORDER BY length(p), p) AS pages FROM (SELECT DISTINCT vol, siglum, unnest(pages) AS p FROM siglum_usage) GROUP BY 1, 2",
    "usage_spread": """WITH u AS (SELECT vol, siglum, sum(uses) AS uses, sum(len(pages)) AS n FROM siglum_usage GROUP BY 1, 2), r AS (SELECT *, dense_rank() OVER (PARTITION BY vol ORDER BY uses) AS cote, (row_number() OVER (PARTITION BY vol, uses ORDER BY n DESC, siglum) - 1 - (count(*) OVER (PARTITION BY vol, uses) - 1) / 2) * 15 AS fan FROM u), t AS (SELECT *, max(cote) OVER (PARTITION BY vol) AS top FROM r)
      SELECT vol, siglum, cote, CAST(fan AS DOUBLE) AS fan, round(CASE WHEN top > 1 THEN 40 + 372 * (1 - (cote - 1) / (top - 1)) ELSE 40.0 END, 3) AS height FROM t""",
    "flag_order": "SELECT category, vol, rec_id, row_number() OVER (PARTITION BY category, vol ORDER BY CAST(rec_id AS VARCHAR)) AS place FROM (SELECT DISTINCT rec_id, vol, unnest([CASE WHEN siglum IS NULL THEN 'no siglum' END, CASE WHEN definition IS NULL THEN 'no definition' END, CASE WHEN printed IS NULL THEN 'no page' END]) AS category FROM citations) WHERE category IS NOT NULL",
    "hanging_lines": "SELECT doc_id, length(regexp_replace(regexp_replace(regexp_extract(line, '^([^:]*:[   ]?)', 1), '\\{[^}]*\\}', '', 'g'), '[*_`\\[\\]]', '', 'g')) AS indent, count(*) AS lines FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE regexp_matches(line, '^[^:]{1,40}:') GROUP BY 1, 2",
    "first_sources": "SELECT siglum, pageid, count(*) AS documents, arg_min(source, CASE WHEN lang IS NOT NULL THEN doc_id END) AS source FROM documents WHERE siglum IS NOT NULL AND pageid IS NOT NULL GROUP BY 1, 2",
    "commonest_form": "SELECT vol, siglum, definition, records FROM (SELECT *, row_number() OVER (PARTITION BY vol, siglum ORDER BY records DESC, definition) AS n FROM (SELECT vol, siglum, definition, count(DISTINCT rec_id) AS records FROM citations WHERE siglum IS NOT NULL AND definition IS NOT NULL GROUP BY 1, 2, 3)) WHERE n = 1",
}
