"""Queries on what notes and definitions cite, and on the bibliography they cite."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafwork.functions.edition import (
    ALIASES, AUTHOR, BACK, BACK_TITLE, CAP, CITATION, EXTENT, GLUED, INITIALS, LEAD, POINT, QUOTES, SIGLUM_STOP, SPAN, TAIL, cited_points, clean_title, entry_title, is_siglum, journal, match_title, opens_author, plausible_heading, short_author, siglum_short, title_score, with_locus,
)
from leafwork.functions.rules import quoted, replaced, spots, sql_replaced, sql_spots
from leafwork.functions.text import fold_key, short_title
from leafwork.operators.apparatus import ascii_key
from leafwork.operators.match import best
from leafwork.operators.ordered import carry_forward, running_distinct
from leafwork.plans.layout import _BLOCKS, SQL_PLACE, blocks, placed
from leafwork.plans.records import _FOLD
from leafwork.session import cut
from leafwork.sources.tables import table

CAPITALS = rf"{CAP}{CAP}[A-ZÀ-ÖØ-Þ'’\-]+"
PHRASE = r"(?i)(?:op|ouv|art|loc)\.?\s*cit[ée]?\.?|ibid\.?"
LOCATOR = r"pp?\.\s*([0-9IVXLCivxlc]+(?:\s*[-–]\s*[0-9IVXLCivxlc]+)?)"
_CITED = r"""^(.*?)\s*,\s*(\*[^*]+\*|"[^"]{4,}"|'[^']{4,}')$"""


def author_key(author: Column) -> Column:
    """The first run of capitals of an author, else the last word, folded."""
    capitals = F.nullif(F.regexp_extract(author, f"({CAPITALS})", 1), F.lit(""))
    return fold_key(F.coalesce(capitals, F.regexp_extract(author, r"([^\s]+)\s*$", 1)))


def notes(spark: SparkSession, d: str) -> DataFrame:
    """doc, vol, note (its place), text: notes of the pages, each transcription of a volume a document, and definitions of citations, each volume's another."""
    page = blocks(spark, d).where("kind = 'note'").transform(placed)
    page = page.select(F.concat_ws("-", "provenance", "vol").alias("doc"), F.col("vol").cast("int").alias("vol"), (F.col("idx") * 10000 + F.col("island")).cast("long").alias("note"), F.regexp_replace("text", r"^\[\^[^\]]+\]:[ \t]?", "").alias("text"))
    defined = table(spark, d, "citations").where("definition IS NOT NULL").groupBy("vol", "rec_id").agg(F.min("definition").alias("text"))
    return page.unionByName(defined.select(F.concat(F.lit("defined-"), F.col("vol")).alias("doc"), "vol", F.col("rec_id").alias("note"), "text"))


def events(spark: SparkSession, d: str, rows: DataFrame) -> DataFrame:
    """doc, vol, note, at, kind, author, title of what each note cites: works in full, works named before, and bare references back outside these. Sigla are no authors."""
    cited = spots(F.col("text"), CITATION)
    event = lambda at, kind, author, title: F.struct(at.alias("at"), kind.alias("kind"), author.alias("author"), title.alias("title"))
    squeezed = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))

    def of_citation(c: Column) -> Column:
        title = squeezed(F.regexp_replace(F.regexp_extract(c["found"], _CITED, 2), "^.|.$", ""))
        author = F.regexp_replace(squeezed(F.regexp_extract(c["found"], _CITED, 1)), LEAD, "")
        kind = F.when(title.rlike(BACK_TITLE), F.lit("named")).when(F.length(title) >= 4, F.lit("full"))
        return event(c["at"], kind, author, F.when(kind == "full", title))

    none = F.lit(None).cast("string")
    inside = lambda b: F.exists("cited", lambda c: (c["at"] <= b["at"]) & (b["at"] < c["at"] + F.length(c["found"])))
    rows = rows.withColumns({"cited": cited, "back": spots(F.col("text"), BACK)})
    bare = F.transform(F.filter("back", lambda b: ~inside(b)), lambda b: event(b["at"], F.lit("bare"), none, none))
    out = rows.select("doc", "vol", "note", F.explode(F.concat(F.transform("cited", of_citation), bare)).alias("e")).select("doc", "vol", "note", "e.*").where("kind IS NOT NULL")
    sigla = table(spark, d, "siglum_list").select("siglum")
    named = F.coalesce("author", F.lit(""))
    return out.join(sigla, (F.col("siglum") == named) | (F.col("siglum") == F.regexp_replace(named, r"\.+$", "")), "left_anti")


def note_events(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d, notes(spark, d)).select("doc", "note", F.col("at").cast("long").alias("at"), "kind", "author", "title")


def linked(spark: SparkSession, d: str, rows: DataFrame) -> DataFrame:
    """Every reference back of the notes ``rows`` with what it means and how that was found.

    A named one means the author's last work cited in full before, else the
    first of the author in the volume's bibliography, else the last note before
    this one that names the author. A bare one means the last work cited, which
    a named reference resolved in the notes renews. ``Id.`` bears the author of
    the last full citation.
    """
    e = events(spark, d, rows)
    order = ["note", "at", "kind"]
    same = F.lower(F.coalesce("author", F.lit(""))).isin("id.")
    e = carry_forward(e, ["doc"], order, F.when((F.col("kind") == "full") & ~same, F.col("author")), "last_author", exclusive=True)
    e = cut(e.withColumn("author", F.when(same, F.coalesce("last_author", "author")).otherwise(F.col("author"))).drop("last_author").withColumn("key", author_key(F.coalesce("author", F.lit("")))))
    work = F.struct(F.col("note").alias("target_note"), "author", "title")
    e = carry_forward(e, ["doc", "key"], order, F.when(F.col("kind") == "full", work), "by_author", exclusive=True)
    e = running_distinct(e.withColumn("title_key", F.when(F.col("kind") == "full", fold_key(F.col("title")))), ["doc", "key"], order, "title_key", "works")
    e = carry_forward(e, ["doc"], order, F.when(F.col("kind") == "full", work).when(F.col("kind") == "named", F.col("by_author")), "last_work", exclusive=True)
    listed = table(spark, d, "bibliography_entry").where("author IS NOT NULL").select("vol", author_key(F.col("author")).alias("key"), "entry_id", "author", "title")
    listed = listed.groupBy("vol", "key").agg(F.min_by(F.struct("author", "title"), "entry_id").alias("listed"), F.count(F.lit(1)).alias("listed_works"))
    tokens = F.array_distinct(F.regexp_extract_all("text", F.lit(CAPITALS), F.lit(0)))
    sigla = table(spark, d, "siglum_list").select(F.col("siglum").alias("token"))
    names = rows.select("doc", "note", F.explode(tokens).alias("token")).where("NOT token RLIKE '^[IVXLCDM]+$'").join(sigla, "token", "left_anti")
    names = names.select("doc", "note", fold_key(F.col("token")).alias("key"), F.col("note").alias("naming")).distinct()
    both = e.unionByName(names, allowMissingColumns=True)
    earlier = F.max("naming").over(Window.partitionBy("doc", "key").orderBy("note").rangeBetween(Window.unboundedPreceding, -1))
    e = both.withColumn("mention", earlier).where("naming IS NULL AND kind <> 'full'").join(listed, ["vol", "key"], "left")
    named, met, note = F.col("kind") == "named", F.col("by_author").isNotNull(), F.col("last_work").isNotNull()
    source = F.when(named & met, "note").when(named & F.col("listed").isNotNull(), "bibliography").when(named & F.col("mention").isNotNull(), "mention").when(~named & note, "last")
    sure = lambda works: F.when(works <= 1, "high").otherwise("medium")
    by = lambda a, b, c, last: F.when(F.col("source") == "note", a).when(F.col("source") == "bibliography", b).when(F.col("source") == "mention", c).when(F.col("source") == "last", last)
    none = F.lit(None)
    return e.withColumn("source", source).select(
        "doc", "vol", "note", "at", "kind", "author", "source",
        by(F.col("by_author.target_note"), none, F.col("mention"), F.col("last_work.target_note")).alias("target_note"),
        by(F.col("by_author.author"), F.col("listed.author"), F.col("author"), F.col("last_work.author")).alias("target_author"),
        by(F.col("by_author.title"), F.col("listed.title"), none, F.col("last_work.title")).alias("target_title"),
        F.coalesce(by(sure(F.col("works")), sure(F.col("listed_works")), F.lit("low"), F.lit("medium")), F.lit("unresolved")).alias("confidence"),
    )


def note_links(spark: SparkSession, d: str) -> DataFrame:
    return linked(spark, d, cut(notes(spark, d))).select("doc", "note", F.col("at").cast("long").alias("at"), "kind", "author", "source", "target_note", "target_title", "confidence")


def note_choices(spark: SparkSession, d: str) -> DataFrame:
    """What is written for each phrase that refers back, or why a reader must decide.

    The i-th phrase of a note is held to the i-th reference resolved in it; if
    there are not as many, none is. An ibid. gets the page of its antecedent if
    that gives one only.
    """
    text = cut(notes(spark, d))
    links = cut(linked(spark, d, text))
    refs = links.where("confidence <> 'unresolved'").withColumn("place", F.row_number().over(Window.partitionBy("doc", "note").orderBy("at", "kind")))
    rows = text.select("doc", "note", "text", F.posexplode(spots(F.col("text"), PHRASE)).alias("place", "m")).withColumn("place", F.col("place") + 1)
    in_note = Window.partitionBy("doc", "note")
    counts = refs.groupBy("doc", "note").agg(F.count(F.lit(1)).alias("refs"))
    rows = rows.withColumn("phrases", F.count(F.lit(1)).over(in_note)).join(counts, ["doc", "note"], "left").join(refs.drop("at", "vol"), ["doc", "note", "place"], "left")
    pages = F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(LOCATOR), F.lit(1)), lambda p: F.regexp_replace(p, r"\s+", "")))
    antecedent = text.select("doc", F.col("note").alias("target_note"), F.when(F.size(pages) == 1, pages[0]).alias("page"))
    rows = rows.join(antecedent, ["doc", "target_note"], "left")
    before = F.substr("text", F.greatest(F.col("m.at") - 39, F.lit(1)), F.least(F.col("m.at"), F.lit(40)))
    after = F.substr("text", F.col("m.at") + F.length("m.found") + 1, F.lit(24))
    siglum = F.regexp_extract(F.regexp_replace(before, r"\{\.underline\}", ""), r"(?:^|[^\p{L}])([A-Z][A-Za-z.\-]{1,6})[\]\}]?[,\s*]*$", 1)
    sigla = table(spark, d, "siglum_list").select(F.col("siglum").alias("kept")).withColumn("is_siglum", F.lit(True))
    rows = rows.withColumn("kept", siglum).join(sigla, "kept", "left")
    beside = after.rlike(r"^[,\s]*\*?,?\s*pp?\.") | after.rlike(r"(?i)pp?\.\s*[0-9ixvlc]")
    ibid = F.lower("m.found").startswith("ibid")
    short = F.concat(F.lit("*"), short_title(F.coalesce("target_title", F.lit(""))), F.lit("*"))
    full = F.concat_ws(", ", short_author(F.coalesce("target_author", F.lit(""))), short)
    choice = (
        F.when(F.col("phrases") != F.coalesce("refs", F.lit(0)), "flag: counts differ").when(F.col("confidence") == "low", "flag: low confidence")
        .when(ibid & ~beside & F.col("page").isNull(), "ibid. without page").when(ibid, "ibid.").when(F.col("kind") == "named", "title").when(F.coalesce("is_siglum", F.lit(False)), "flag: siglum kept").otherwise("author and title")
    )
    written = F.when(choice.startswith("flag"), F.concat(F.lit("*"), F.col("m.found"), F.lit("*"))).when(choice == "title", short).when((choice == "ibid.") & ~beside, F.concat(full, F.lit(", p. "), F.col("page"))).otherwise(full)
    return rows.select("doc", "note", F.col("place").cast("long").alias("place"), F.col("m.found").alias("phrase"), choice.alias("choice"), written.alias("written"))


def article_titles(spark: SparkSession, d: str) -> DataFrame:
    """Titles in single quotes before a journal, and journals that no title so marked stands close before: these are left to a reader."""
    title, signal = r"(?:^|[^0-9A-Za-zÀ-ÿ])'[^']{6,110}'\s*,?\s*dans\s+\*", r",?\s*dans\s+\*"
    rows = notes(spark, d).withColumns({"marked": spots(F.col("text"), title), "signals": spots(F.col("text"), signal)})
    ends = F.transform("marked", lambda t: t["at"] + F.length(F.regexp_extract(t["found"], r"^(.*')", 1)))
    left = F.filter("signals", lambda s: ~F.exists(ends, lambda e: F.abs(s["at"] - e) <= 2) & F.contains(F.substr("text", F.greatest(s["at"] - 119, F.lit(1)), F.least(s["at"], F.lit(120))), F.lit("'")))
    return rows.select("doc", "note", F.size("marked").cast("long").alias("titles"), F.size(left).cast("long").alias("left")).where("titles > 0 OR left > 0")


def entry_parts(spark: SparkSession, d: str) -> DataFrame:
    """What is read out of a bibliography entry: title, title to match, quotes put right, places cited."""
    t = table(spark, d, "bibliography_entry")
    text = F.concat_ws(" ", F.col("text"), F.array_join(F.transform("reviews", lambda r: r["text"]), " "))
    points = F.array_join(F.transform(cited_points(text), lambda p: F.concat_ws(":", F.coalesce(p["vol"], F.lit("")), p["lo"], p["hi"])), " ")
    return t.select("entry_id", entry_title(F.col("text")).alias("title"), match_title(F.col("text")).alias("matched"), clean_title(F.col("title")).alias("clean"), plausible_heading(F.col("title")).alias("heading"), F.md5(replaced(text, QUOTES)).alias("quotes"), points.alias("points"), opens_author(F.regexp_replace("text", "^- ", "")).alias("opens"))


def author_initials(spark: SparkSession, d: str) -> DataFrame:
    """Authors of the bibliography and of works cited in definitions by initials and surname."""
    listed = table(spark, d, "bibliography_entry").where("author IS NOT NULL").select("author")
    cited = table(spark, d, "citations").where("definition IS NOT NULL").select(F.regexp_extract("definition", rf"^({AUTHOR})\s*,", 1).alias("author")).where("author <> ''")
    names = listed.union(cited).distinct()
    return names.select("author", short_author(replaced(F.col("author"), GLUED)).alias("short"))


CITED_NAME = r"(?:^|[^\p{L}])([A-ZÀ-ÖØ-Þ][A-ZÀ-ÖØ-Þ'’\-]{2,})\s*,\s*[A-ZÀ-ÖØ-Þ]"


def surnames(spark: SparkSession, d: str) -> DataFrame:
    """Every surname in capitals of authors, reviewers and definitions; no particles, numerals or sigla."""
    b, c = table(spark, d, "bibliography_entry"), table(spark, d, "citations")
    authors = b.select("author").union(c.select("bibliography.author")).where("author IS NOT NULL").select(F.explode(F.split("author", r"\s+")).alias("name"))
    texts = b.select("text").union(b.select(F.explode("reviews.text"))).union(c.where("definition IS NOT NULL").select("definition"))
    found = texts.select(F.explode(F.regexp_extract_all("text", F.lit(CITED_NAME), F.lit(1))).alias("name"))
    names = authors.union(found).select(F.regexp_replace("name", r"[.,;:!?)\]»”\"'’]+$", "").alias("name")).distinct()
    names = names.where("length(name) >= 3 AND name RLIKE '^[A-ZÀ-ÖØ-Þ][A-ZÀ-ÖØ-Þ’\\'-]*$' AND NOT name RLIKE '^[IVXLCDM]+$' AND lower(name) NOT IN ('des', 'del', 'von', 'van', 'della')")
    return names.join(table(spark, d, "siglum_list").select(F.col("siglum").alias("name")), "name", "left_anti")


SIGNALLED = r"(?:(?:\p{Lu}(?:\.\p{Lu})*\.|\p{Lu}\p{Ll}+(?:-\p{Lu}?\p{Ll}+)*\.?|MM\.|Mme\.?|Mlle\.?) +)?[A-ZÀ-ÖØ-Þ][A-ZÀ-ÖØ-Þ'’]{2,}(?:-[A-ZÀ-ÖØ-Þ][A-ZÀ-ÖØ-Þ'’]*)*"


def names_in_notes(spark: SparkSession, d: str) -> DataFrame:
    """Surnames in notes and definitions: words in capitals that are known, or that an initial, a given name or an honorific stands before."""
    found = notes(spark, d).select("doc", F.explode(F.regexp_extract_all(replaced(F.col("text"), GLUED), F.lit(SIGNALLED), F.lit(0))).alias("found"))
    parts = F.split("found", " +")
    rows = found.select("doc", F.element_at(parts, -1).alias("name"), (F.size(parts) > 1).alias("signalled")).where("NOT name RLIKE '^[IVXLCDM]+$'")
    rows = rows.join(table(spark, d, "siglum_list").select(F.col("siglum").alias("name")), "name", "left_anti").groupBy("doc", "name").agg(F.count(F.lit(1)).alias("times"), F.count_if("signalled").alias("signalled"))
    known = surnames(spark, d).withColumn("known", F.lit(True))
    return rows.join(known, "name", "left").select("doc", "name", "times", "signalled", F.coalesce("known", F.lit(False)).alias("known")).where("known OR signalled > 0")


def listed_works(spark: SparkSession, d: str) -> DataFrame:
    """Works of the bibliographies among the documents, one a line; a line without author goes on with the author before it."""
    rows = table(spark, d, "documents").where("source = 'bibliography'").select("doc_id", F.posexplode(F.split("text", "\n")).alias("no", "line")).where("trim(line) <> '' AND NOT line RLIKE '^-{3,}$|^[0-9]{3}\\\\.?$'")
    body = F.trim(F.regexp_replace("line", r"^- ", ""))
    begins = (F.col("line").startswith("- ") | opens_author(body)) & ~body.rlike(r"^[*'\"]")
    rows = rows.select("doc_id", F.col("no").cast("long").alias("no"), body.alias("body"), begins.alias("begins"))
    rows = carry_forward(rows, ["doc_id"], ["no"], F.when(F.col("begins"), F.trim(F.regexp_extract("body", "^([^,]*)", 1))), "surname").where("surname IS NOT NULL")
    work = F.when(F.col("begins"), F.trim(F.regexp_extract("body", "^[^,]*,[^,]*,(.*)$", 1))).otherwise(F.col("body"))
    return rows.select("doc_id", "no", "surname", entry_title(work).alias("title"), F.nullif(F.regexp_extract(work, r"([12][0-9]{3})", 1), F.lit("")).alias("year"))


def review_journals(spark: SparkSession, d: str) -> DataFrame:
    """The journal of every review; one that says ibid. has that of the review before."""
    rows = table(spark, d, "bibliography_entry").select("entry_id", F.posexplode("reviews.text").alias("k", "text"))
    said = F.when(F.col("text").rlike(r"(?i)(?:^|[^\p{L}])ibid"), F.lit(None)).otherwise(journal(F.col("text")))
    return carry_forward(rows, ["entry_id"], ["k"], said, "journal").select("entry_id", F.col("k").cast("long").alias("k"), "journal")


def siglum_cites(spark: SparkSession, d: str) -> DataFrame:
    """What each record's siglum stands for in few words, and with its author in front where a page is cited."""
    t = table(spark, d, "citations").where("siglum IS NOT NULL").groupBy("rec_id").agg(F.max_by(F.struct("siglum", "definition", "bibliography"), F.struct("loaded_at", "siglum")).alias("c")).select("rec_id", "c.*")
    t = t.select("rec_id", "definition", F.col("bibliography.author").alias("author"), F.col("bibliography.title").alias("title"))
    of_author = F.regexp_extract("definition", r"^(.+?),?\s*\*([^*]+)\*", 1)
    spelled = F.concat(F.trim(F.regexp_replace(of_author, "[,.]$", "")), F.lit(", "), short_title(F.regexp_extract("definition", r"^(.+?),?\s*\*([^*]+)\*", 2)))
    return t.select("rec_id", siglum_short(F.col("author"), F.col("title"), F.col("definition")).alias("short"), F.when(of_author != "", spelled).alias("page_short"))


def harvested_sigla(spark: SparkSession, d: str) -> DataFrame:
    """Sigla marked by underlining in pages, definitions and evidence, aliases undone: uses and places."""
    p, c = table(spark, d, "page_files"), table(spark, d, "citations")
    texts = p.select(F.col("pageid").alias("place"), F.col("body").alias("text")).union(c.select(F.col("rec_id").cast("string"), "definition")).union(c.select(F.col("rec_id").cast("string"), "evidence")).union(c.select(F.col("rec_id").cast("string"), "siglum"))
    found = texts.select("place", F.explode(F.regexp_extract_all("text", F.lit(r"\[([^\]]+)\]\{\.underline\}"), F.lit(1))).alias("token"))
    alias = F.create_map(*[F.lit(x) for kv in ALIASES.items() for x in kv])
    return found.select("place", F.coalesce(F.try_element_at(alias, F.col("token")), F.col("token")).alias("siglum")).where(is_siglum(F.col("siglum"))).groupBy("siglum").agg(F.count(F.lit(1)).alias("uses"), F.countDistinct("place").alias("places"))


NUMERAL = r"(?:^|[^\p{L}])([IVXLCDM]+)\s*,\s*(\d+)"
LEADING = r"^\*?\[?([A-Za-z0-9À-ÿ][A-Za-z0-9À-ÿ.\-]{0,7})\]?(?:\{\.underline\})?\*?\s*,"


def resolved_entries(spark: SparkSession, d: str) -> DataFrame:
    """The bibliography entry each definition means, with the score and the citation to print.

    First the entry whose siglum leads the definition; else, of the entries
    whose author's surname it has, the best by title and places cited: a title
    scores up to six, a volume two, a page two or three, an only candidate at
    least three. Below three nothing is meant; ties go to the first entry.
    """
    r = table(spark, d, "citations").where("definition IS NOT NULL").groupBy("vol", "rec_id").agg(F.min("definition").alias("text"))
    number = lambda c: F.try_to_number(F.nullif(c, F.lit("")), F.lit("9999999")).cast("int")
    first_page = F.coalesce(number(F.regexp_extract("text", NUMERAL, 2)), number(F.regexp_extract("text", r",\s*p?\.?\s*(\d+)", 1)))
    r = r.select("vol", "rec_id", ascii_key(F.regexp_extract("text", LEADING, 1)).alias("lead"), F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(r"[A-ZÀ-Þ][A-ZÀ-Þ'\-]{2,}"), F.lit(0)), lambda s: fold_key(s))).alias("names"), F.nullif(F.regexp_extract("text", NUMERAL, 1), F.lit("")).alias("volume"), first_page.alias("page"), match_title(F.regexp_extract("text", r"(\*[^*]+\*)", 1)).alias("ref"))
    e = table(spark, d, "bibliography_entry")
    field = F.regexp_extract(F.coalesce("author", F.lit("")), "^([^,]*)", 1)
    keys = F.array_distinct(F.array(fold_key(field), fold_key(F.regexp_extract(field, r"([^ ]+)\s*$", 1))))
    e = cut(e.select("vol", "entry_id", F.col("text").alias("entry"), ascii_key(F.coalesce("siglum", F.lit(""))).alias("siglum"), keys.alias("keys"), match_title(F.col("text")).alias("title"), cited_points(F.col("text")).alias("points")))
    tagged = e.where("siglum <> ''").groupBy("vol", F.col("siglum").alias("lead")).agg(F.min("entry_id").alias("entry_id"))
    by_siglum = r.where("lead <> ''").join(tagged, ["vol", "lead"]).select("rec_id", "entry_id", F.lit(9).alias("score"))
    left = r.join(by_siglum.select("rec_id"), "rec_id", "left_anti")
    keyed = e.select("vol", "entry_id", "title", "points", F.explode("keys").alias("key")).where("key <> ''")
    only = keyed.groupBy("vol", "key").agg((F.count(F.lit(1)) == 1).alias("only"))
    pairs = left.select("vol", "rec_id", "volume", "page", "ref", F.explode("names").alias("key")).where("key <> ''").join(keyed.join(only, ["vol", "key"]), ["vol", "key"])
    at = lambda p: F.when(F.col("volume").isNotNull() & (p["vol"] == F.col("volume")), 2).otherwise(0) + F.when((F.col("page") == p["lo"]) & (p["hi"] > p["lo"]), 3).when(F.col("page").between(p["lo"], p["hi"]), 2).otherwise(0)
    score = F.greatest(title_score(F.col("ref"), F.col("title")), F.coalesce(F.array_max(F.transform("points", at)), F.lit(0)), F.when(F.col("only"), 3).otherwise(0))
    scored = pairs.select("rec_id", "entry_id", score.alias("score")).where("score >= 3")
    found = best(scored, ["rec_id"], [F.col("score")], [F.col("entry_id")], ["entry_id", "score"]).unionByName(by_siglum)
    out = found.join(r.select("rec_id", "volume", "page"), "rec_id").join(e.select("entry_id", "entry", "points"), "entry_id")
    stated = F.exists("points", lambda p: F.col("page").between(p["lo"], p["hi"]))
    return out.select("rec_id", "entry_id", F.col("score").cast("long").alias("score"), F.when(F.coalesce(stated, F.lit(False)), F.col("entry")).otherwise(with_locus(F.col("entry"), F.col("volume"), F.col("page"))).alias("cite"))


def entry_backlinks(spark: SparkSession, d: str) -> DataFrame:
    """Entries that are cited, and by how many records."""
    return resolved_entries(spark, d).groupBy("entry_id").agg(F.count(F.lit(1)).alias("records"), F.min("rec_id").alias("first"))


def edition_hits(spark: SparkSession, d: str) -> DataFrame:
    """The entry whose author and text hold a record's author and the beginning of its title; entries on literature first, then the first.

    The first word of the author is joined by equality; that it is held, and the title's first ten letters, is then asked of the few entries left.
    """
    c = table(spark, d, "citations").where("bibliography.author IS NOT NULL").select("rec_id", "vol", F.upper("bibliography.author").alias("want"), F.substring("bibliography.title", 1, 10).alias("begun")).distinct()
    words = lambda text: F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(r"\p{Lu}{4,}"), F.lit(0)))).alias("word")
    e = table(spark, d, "bibliography_entry").where("author IS NOT NULL").select("vol", "entry_id", "section", "text", F.upper("author").alias("author"))
    pairs = c.select("rec_id", "vol", "want", "begun", words(F.col("want"))).join(e.select("vol", "entry_id", "section", "text", "author", words(F.col("author"))), ["vol", "word"])
    hits = pairs.where(F.contains("author", "word") & F.contains("text", "begun"))
    return hits.groupBy("rec_id").agg(F.min_by("entry_id", F.struct((F.col("section") != "litterature").alias("other"), "entry_id")).alias("entry_id"))


QUERIES = {f.__name__: f for f in (note_events, note_links, note_choices, article_titles, entry_parts, author_initials, surnames, names_in_notes, listed_works, review_journals, siglum_cites, harvested_sigla, resolved_entries, entry_backlinks, edition_hits)}

_NOTES = f"""SELECT provenance || '-' || vol AS doc, CAST(vol AS INTEGER) AS vol, CAST(idx * 10000 + island AS BIGINT) AS note, regexp_replace(text, '^\\[\\^[^\\]]+\\]:[ \\t]?', '') AS text FROM (SELECT *, {SQL_PLACE} FROM ({_BLOCKS})) WHERE kind = 'note'
  UNION ALL SELECT 'defined-' || vol, vol, rec_id, min(definition) FROM citations WHERE definition IS NOT NULL GROUP BY vol, rec_id"""
_EVENTS = f"""SELECT doc, vol, note, e.at AS seat, e.kind AS kind, e.author AS author, e.title AS title FROM (SELECT doc, vol, note, unnest(list_concat(
    list_transform(cited, lambda c: {{'at': c.at, 'kind': CASE WHEN regexp_matches(t(c.found), {quoted(BACK_TITLE)}) THEN 'named' WHEN length(t(c.found)) >= 4 THEN 'full' END,
      'author': regexp_replace(trim(regexp_replace(regexp_extract(c.found, {quoted(_CITED)}, 1), '\\s+', ' ', 'g')), {quoted(LEAD)}, ''), 'title': CASE WHEN NOT regexp_matches(t(c.found), {quoted(BACK_TITLE)}) AND length(t(c.found)) >= 4 THEN t(c.found) END}}),
    list_transform(list_filter(back, lambda b: len(list_filter(cited, lambda c: c.at <= b.at AND b.at < c.at + length(c.found))) = 0), lambda b: {{'at': b.at, 'kind': 'bare', 'author': NULL, 'title': NULL}}))) AS e
  FROM (SELECT *, {sql_spots("text", CITATION)} AS cited, {sql_spots("text", BACK)} AS back FROM ({_NOTES}))) WHERE e.kind IS NOT NULL AND coalesce(e.author, '') NOT IN (SELECT siglum FROM siglum_list) AND regexp_replace(coalesce(e.author, ''), '\\.+$', '') NOT IN (SELECT siglum FROM siglum_list)"""
_TITLE = f"trim(regexp_replace(regexp_replace(regexp_extract(c.found, {quoted(_CITED)}, 2), '^.|.$', '', 'g'), '\\s+', ' ', 'g'))"
_EVENTS = _EVENTS.replace("t(c.found)", _TITLE)


def _sql_key(author: str) -> str:
    return _FOLD.format(f"coalesce(nullif(regexp_extract({author}, {quoted(f'({CAPITALS})')}, 1), ''), regexp_extract({author}, '([^\\s]+)\\s*$', 1))")


_LINKS = f"""WITH n AS MATERIALIZED ({_NOTES}), e0 AS MATERIALIZED ({_EVENTS.replace(f"({_NOTES})", "n")}),
  e1 AS (SELECT *, last_value(CASE WHEN kind = 'full' AND lower(author) <> 'id.' THEN author END IGNORE NULLS) OVER (PARTITION BY doc ORDER BY note, seat, kind ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS la FROM e0),
  e2 AS (SELECT * EXCLUDE (author, la), CASE WHEN lower(coalesce(author, '')) = 'id.' THEN coalesce(la, author) ELSE author END AS author FROM e1), e3 AS (SELECT *, {_sql_key("coalesce(author, '')")} AS key FROM e2),
  e4 AS (SELECT *, last_value(CASE WHEN kind = 'full' THEN {{'n': note, 'a': author, 't': title}} END IGNORE NULLS) OVER w AS mine, count(DISTINCT CASE WHEN kind = 'full' THEN {_FOLD.format("title")} END) OVER w AS works FROM e3 WINDOW w AS (PARTITION BY doc, key ORDER BY note, seat, kind ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  e5 AS (SELECT *, last_value(CASE WHEN kind = 'full' THEN {{'n': note, 'a': author, 't': title}} WHEN kind = 'named' THEN mine END IGNORE NULLS) OVER (PARTITION BY doc ORDER BY note, seat, kind ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM e4),
  b AS (SELECT vol, key, arg_min({{'a': author, 't': title}}, entry_id) AS listed, count(*) AS k FROM (SELECT *, {_sql_key("author")} AS key FROM bibliography_entry WHERE author IS NOT NULL) GROUP BY 1, 2),
  m AS (SELECT DISTINCT doc, note, {_FOLD.format("token")} AS key FROM (SELECT doc, note, unnest(regexp_extract_all(text, {quoted(CAPITALS)})) AS token FROM n) WHERE NOT regexp_matches(token, '^[IVXLCDM]+$') AND token NOT IN (SELECT siglum FROM siglum_list)),
  f AS (SELECT e5.*, b.listed, b.k, (SELECT max(m.note) FROM m WHERE m.doc = e5.doc AND m.key = e5.key AND m.note < e5.note) AS mention FROM e5 LEFT JOIN b ON b.vol = e5.vol AND b.key = e5.key WHERE kind <> 'full'),
  s AS (SELECT *, CASE WHEN kind = 'named' AND mine IS NOT NULL THEN 'note' WHEN kind = 'named' AND listed IS NOT NULL THEN 'bibliography' WHEN kind = 'named' AND mention IS NOT NULL THEN 'mention' WHEN kind <> 'named' AND last IS NOT NULL THEN 'last' END AS source FROM f),
  l AS (SELECT doc, note, seat, kind, author, source, CASE source WHEN 'note' THEN mine.n WHEN 'mention' THEN mention WHEN 'last' THEN last.n END AS target_note, CASE source WHEN 'note' THEN mine.a WHEN 'bibliography' THEN listed.a WHEN 'mention' THEN author WHEN 'last' THEN last.a END AS target_author,
    CASE source WHEN 'note' THEN mine.t WHEN 'bibliography' THEN listed.t WHEN 'last' THEN last.t END AS target_title,
    CASE source WHEN 'note' THEN CASE WHEN works <= 1 THEN 'high' ELSE 'medium' END WHEN 'bibliography' THEN CASE WHEN k <= 1 THEN 'high' ELSE 'medium' END WHEN 'mention' THEN 'low' WHEN 'last' THEN 'medium' ELSE 'unresolved' END AS confidence FROM s)"""


def _sql_short(title: str) -> str:
    head = f"regexp_replace(regexp_extract(regexp_replace({title}, '[*_«»]', '', 'g'), '^([^,(]*)', 1), '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g')"
    end = f"regexp_extract(substr({head}, 1, 38), '^(.*) [^ ]*$', 1)"
    return f"CASE WHEN length({head}) <= 38 THEN {head} WHEN {end} = '' THEN substr({head}, 1, 38) || '…' ELSE {end} || '…' END"


def _sql_author(author: str) -> str:
    parts = f"regexp_split_to_array(trim({author}), '\\s+et\\s+|\\s*&\\s*')"

    def one(name: str) -> str:
        surname = f"trim(regexp_extract({name}, {quoted(TAIL)}, 1))"
        given = f"list_transform(list_filter(string_split(regexp_replace({name}, {quoted(TAIL)}, ''), ' '), lambda g: regexp_matches(g, '^[A-Za-zÀ-ÿ]')), lambda g: CASE WHEN regexp_matches(g, {quoted(INITIALS)}) THEN g ELSE upper(substr(g, 1, 1)) || '.' END)"
        return f"CASE WHEN {surname} = '' OR NOT contains({name}, ' ') THEN {name} ELSE array_to_string(list_append({given}, {surname}), ' ') END"

    first, second = one(f"({parts})[1]"), one(f"({parts})[2]")
    return f"CASE WHEN len({parts}) > 2 THEN ({first}) || ' et al.' WHEN len({parts}) = 2 THEN ({first}) || ' et ' || ({second}) ELSE {first} END"


_NAMES = f"""SELECT DISTINCT name FROM (SELECT regexp_replace(name, '[.,;:!?)\\]»”"''’]+$', '') AS name FROM (
    SELECT unnest(regexp_split_to_array(author, '\\s+')) AS name FROM (SELECT author FROM bibliography_entry UNION ALL SELECT bibliography.author FROM citations) WHERE author IS NOT NULL
    UNION ALL SELECT unnest(regexp_extract_all(text, {quoted(CITED_NAME)}, 1)) FROM (SELECT text FROM bibliography_entry UNION ALL SELECT unnest(list_transform(reviews, lambda r: r.text)) FROM bibliography_entry UNION ALL SELECT definition FROM citations WHERE definition IS NOT NULL)))
  WHERE length(name) >= 3 AND regexp_matches(name, '^[A-ZÀ-ÖØ-Þ][A-ZÀ-ÖØ-Þ’''-]*$') AND NOT regexp_matches(name, '^[IVXLCDM]+$') AND lower(name) NOT IN ('des', 'del', 'von', 'van', 'della') AND name NOT IN (SELECT siglum FROM siglum_list)"""
_OPENS = "contains({0}, ',') AND length({1}) <= 30 AND len(regexp_extract_all({1}, '\\p{{L}}')) >= 2 AND regexp_matches({1}, '^[A-ZÀ-Þ]{{2}}') AND len(regexp_extract_all({1}, '\\p{{Lu}}')) >= 0.7 * len(regexp_extract_all({1}, '\\p{{L}}'))"


def _sql_opens(line: str) -> str:
    head = f"trim(regexp_extract(regexp_replace({line}, '\\[([^\\]]*)\\]\\{{\\.underline\\}}', '\\1', 'g'), '^([^,]*)', 1))"
    return _OPENS.format(line, head)


def _sql_entry_title(text: str) -> str:
    return f"trim(coalesce(nullif(regexp_extract({text}, '''([^'']{{4,}})''', 1), ''), regexp_extract({text}, '\\*([^*]+)\\*', 1)))"


def _sql_ascii(text: str) -> str:
    return f"upper(regexp_replace(replace(translate({text}, 'àâäáãåçéèêëíìîïñóòôöõúùûüýÿÀÂÄÁÃÅÇÉÈÊËÍÌÎÏÑÓÒÔÖÕÚÙÛÜÝ', 'aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY'), '0', 'O'), '[^A-Za-z]', '', 'g'))"


def _sql_match(text: str) -> str:
    found = f"""coalesce(nullif(regexp_extract({text}, '\\*([^*]+)\\*', 1), ''), regexp_extract({text}, '["“'']([^"”'']{{5,}})["”'']', 1))"""
    return f"regexp_replace(lower(translate({found}, 'àâäáãåçéèêëíìîïñóòôöõúùûüýÿÀÂÄÁÃÅÇÉÈÊËÍÌÎÏÑÓÒÔÖÕÚÙÛÜÝ', 'aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY')), '^[ .]+|[ .]+$', '', 'g')"


def _sql_points(text: str) -> str:
    full = f"list_transform(list_zip(regexp_extract_all({text}, {quoted(POINT)}, 1), regexp_extract_all({text}, {quoted(POINT)}, 2), regexp_extract_all({text}, {quoted(POINT)}, 3)), lambda x: {{'vol': x[1], 'lo': TRY_CAST(x[2] AS INTEGER), 'hi': TRY_CAST(coalesce(nullif(x[3], ''), x[2]) AS INTEGER)}})"
    bare = f"list_transform(list_zip(regexp_extract_all({text}, {quoted(SPAN)}, 1), regexp_extract_all({text}, {quoted(SPAN)}, 2)), lambda x: {{'vol': CAST(NULL AS VARCHAR), 'lo': TRY_CAST(x[1] AS INTEGER), 'hi': TRY_CAST(x[2] AS INTEGER)}})"
    return f"list_concat({full}, list_filter({bare}, lambda b: len(list_filter({full}, lambda p: p.lo = b.lo AND p.hi = b.hi)) = 0))"


_CLEAN = "regexp_replace(regexp_replace(regexp_replace(title, '^[\\s*]+|[\\s*]+$', '', 'g'), '\\s+', ' ', 'g'), '\\s+$', '')"
_ALLTEXT = "concat_ws(' ', text, array_to_string(list_transform(reviews, lambda r: r.text), ' '))"
_SHAPE = "length(s) <= 9 AND NOT contains(s, ' ') AND regexp_matches(s, '^\\p{Lu}') AND ((upper(s) = s AND regexp_matches(s, '\\p{L}')) OR contains(s, '.') OR regexp_matches(s, '^[A-Z][A-Za-z]{0,3}\\.?(-[A-Z]\\.?)?$'))"
_RESOLVED = f"""WITH r0 AS (SELECT vol, rec_id, min(definition) AS text FROM citations WHERE definition IS NOT NULL GROUP BY 1, 2),
  r AS MATERIALIZED (SELECT vol, rec_id, {_sql_ascii(f"regexp_extract(text, {quoted(LEADING)}, 1)")} AS lead, list_distinct(list_transform(regexp_extract_all(text, '[A-ZÀ-Þ][A-ZÀ-Þ''\\-]{{2,}}'), lambda s: {_FOLD.format("s")})) AS names, nullif(regexp_extract(text, {quoted(NUMERAL)}, 1), '') AS volume,
    coalesce(TRY_CAST(nullif(regexp_extract(text, {quoted(NUMERAL)}, 2), '') AS INTEGER), TRY_CAST(nullif(regexp_extract(text, ',\\s*p?\\.?\\s*(\\d+)', 1), '') AS INTEGER)) AS page, {_sql_match("regexp_extract(text, '(\\*[^*]+\\*)', 1)")} AS ref FROM r0),
  e AS MATERIALIZED (SELECT vol, entry_id, text AS entry, {_sql_ascii("coalesce(siglum, '')")} AS siglum, list_distinct([{_FOLD.format("regexp_extract(coalesce(author, ''), '^([^,]*)', 1)")}, {_FOLD.format("regexp_extract(regexp_extract(coalesce(author, ''), '^([^,]*)', 1), '([^ ]+)\\s*$', 1)")}]) AS keys, {_sql_match("text")} AS title, {_sql_points("text")} AS points FROM bibliography_entry),
  g AS (SELECT rec_id, min(entry_id) AS entry_id, 9 AS score FROM r JOIN e ON r.vol = e.vol AND r.lead = e.siglum WHERE lead <> '' GROUP BY 1),
  k AS (SELECT vol, entry_id, title, points, unnest(keys) AS key FROM e), o AS (SELECT *, count(*) OVER (PARTITION BY vol, key) = 1 AS sole FROM k WHERE key <> ''),
  p AS (SELECT rec_id, entry_id, ref, title, volume, page, points, sole FROM (SELECT *, unnest(names) AS key FROM r WHERE rec_id NOT IN (SELECT rec_id FROM g)) l JOIN o ON l.vol = o.vol AND l.key = o.key),
  w AS (SELECT *, regexp_extract_all(ref, '[a-zà-ÿ]{{4,}}') AS rw, regexp_extract_all(title, '[a-zà-ÿ]{{3,}}') AS ew FROM p),
  s AS (SELECT rec_id, entry_id, greatest(CASE WHEN length(ref) < 4 OR title = '' OR ref IS NULL OR title IS NULL THEN 0 WHEN starts_with(title, ref) OR starts_with(replace(title, ' ', ''), replace(ref, ' ', '')) THEN 6 WHEN starts_with(title, substr(ref, 1, greatest(6, length(ref) - 2))) THEN 5
      WHEN len(rw) > 0 AND len(list_filter(rw, lambda a: len(list_filter(ew, lambda b: starts_with(b, a) OR starts_with(a, b))) > 0)) >= CASE WHEN len(rw) <= 2 THEN len(rw) ELSE len(rw) - 1 END THEN 4 ELSE 0 END,
    coalesce(list_max(list_transform(points, lambda q: CASE WHEN volume IS NOT NULL AND q.vol = volume THEN 2 ELSE 0 END + CASE WHEN page = q.lo AND q.hi > q.lo THEN 3 WHEN page BETWEEN q.lo AND q.hi THEN 2 ELSE 0 END)), 0), CASE WHEN sole THEN 3 ELSE 0 END) AS score FROM w),
  f AS (SELECT rec_id, entry_id, score FROM (SELECT *, row_number() OVER (PARTITION BY rec_id ORDER BY score DESC, entry_id) AS n FROM s WHERE score >= 3) WHERE n = 1 UNION ALL SELECT * FROM g)"""
SQL = {
    "note_events": f'SELECT doc, note, seat AS "at", kind, author, title FROM ({_EVENTS})',
    "note_links": f'{_LINKS} SELECT doc, note, seat AS "at", kind, author, source, target_note, target_title, confidence FROM l',
    "note_choices": f"""{_LINKS}, rf AS (SELECT *, row_number() OVER (PARTITION BY doc, note ORDER BY seat, kind) AS place FROM l WHERE confidence <> 'unresolved'), ct AS (SELECT doc, note, count(*) AS refs FROM rf GROUP BY 1, 2),
      ph AS (SELECT doc, note, text, generate_subscripts(sp, 1) AS place, unnest(sp) AS m, len(sp) AS phrases FROM (SELECT *, {sql_spots("text", PHRASE)} AS sp FROM n)),
      an AS (SELECT doc, note, CASE WHEN len(pg) = 1 THEN pg[1] END AS page FROM (SELECT doc, note, list_distinct(list_transform(regexp_extract_all(text, {quoted(LOCATOR)}, 1), lambda p: regexp_replace(p, '\\s+', '', 'g'))) AS pg FROM n)),
      j AS (SELECT ph.*, coalesce(refs, 0) AS refs, rf.kind, rf.confidence, rf.target_title, rf.target_author, an.page, substr(text, greatest(m.at - 39, 1), least(m.at, 40)) AS bf, substr(text, m.at + length(m.found) + 1, 24) AS af FROM ph LEFT JOIN ct ON ct.doc = ph.doc AND ct.note = ph.note LEFT JOIN rf ON rf.doc = ph.doc AND rf.note = ph.note AND rf.place = ph.place LEFT JOIN an ON an.doc = ph.doc AND an.note = rf.target_note),
      x AS (SELECT *, regexp_matches(af, '^[,\\s]*\\*?,?\\s*pp?\\.') OR regexp_matches(af, '(?i)pp?\\.\\s*[0-9ixvlc]') AS beside, starts_with(lower(m.found), 'ibid') AS ibid, regexp_extract(regexp_replace(bf, '\\{{\\.underline\\}}', '', 'g'), '(?:^|[^\\p{{L}}])([A-Z][A-Za-z.\\-]{{1,6}})[\\]\\}}]?[,\\s*]*$', 1) IN (SELECT siglum FROM siglum_list) AS kept FROM j),
      c AS (SELECT *, CASE WHEN phrases <> refs THEN 'flag: counts differ' WHEN confidence = 'low' THEN 'flag: low confidence' WHEN ibid AND NOT beside AND page IS NULL THEN 'ibid. without page' WHEN ibid THEN 'ibid.' WHEN kind = 'named' THEN 'title' WHEN kept THEN 'flag: siglum kept' ELSE 'author and title' END AS choice,
        '*' || {_sql_short("coalesce(target_title, '')")} || '*' AS short, coalesce(target_author, '') AS au FROM x)
      SELECT doc, note, place, m.found AS phrase, choice, CASE WHEN starts_with(choice, 'flag') THEN '*' || m.found || '*' WHEN choice = 'title' THEN short WHEN choice = 'ibid.' AND NOT beside THEN concat_ws(', ', {_sql_author("au")}, short) || ', p. ' || page ELSE concat_ws(', ', {_sql_author("au")}, short) END AS written FROM c""",
    "article_titles": f"""SELECT doc, note, len(ts) AS titles, len(lf) AS "left" FROM (SELECT *, list_filter(sg, lambda s: len(list_filter(en, lambda e: abs(s.at - e) <= 2)) = 0 AND contains(substr(text, greatest(s.at - 119, 1), least(s.at, 120)), '''')) AS lf FROM (
      SELECT *, list_transform(ts, lambda t: t.at + length(regexp_extract(t.found, '^(.*'')', 1))) AS en FROM (SELECT *, {sql_spots("text", "(?:^|[^0-9A-Za-zÀ-ÿ])'[^']{6,110}'" + chr(92) + "s*,?" + chr(92) + "s*dans" + chr(92) + "s+" + chr(92) + "*")} AS ts, {sql_spots("text", ",?" + chr(92) + "s*dans" + chr(92) + "s+" + chr(92) + "*")} AS sg FROM ({_NOTES})))) WHERE len(ts) > 0 OR len(lf) > 0""",
    "entry_parts": f"""SELECT entry_id, {_sql_entry_title("text")} AS title, {_sql_match("text")} AS matched, regexp_replace(CASE WHEN regexp_matches({_CLEAN}, '^\\S( \\S){{2,}}$') THEN upper(substr(replace({_CLEAN}, ' ', ''), 1, 1)) || lower(substr(replace({_CLEAN}, ' ', ''), 2)) ELSE {_CLEAN} END, '^E(tude|dition)', 'É\\1') AS clean,
      length(title) > 2 AND length(title) < 70 AND NOT contains(title, ',') AND NOT regexp_matches(title, '[0-9]') AS heading, md5({sql_replaced(_ALLTEXT, QUOTES)}) AS quotes, array_to_string(list_transform({_sql_points(_ALLTEXT)}, lambda p: concat_ws(':', coalesce(p.vol, ''), p.lo, p.hi)), ' ') AS points, {_sql_opens("regexp_replace(text, '^- ', '')")} AS opens FROM bibliography_entry""",
    "author_initials": f"""SELECT author, {_sql_author("g")} AS short FROM (SELECT author, {sql_replaced("author", GLUED)} AS g FROM (SELECT author FROM bibliography_entry WHERE author IS NOT NULL UNION SELECT regexp_extract(definition, {quoted(f"^({AUTHOR})" + chr(92) + "s*,")}, 1) FROM citations WHERE definition IS NOT NULL) WHERE author <> '')""",
    "surnames": _NAMES,
    "names_in_notes": f"""WITH k AS ({_NAMES}), t AS (SELECT doc, regexp_split_to_array(unnest(regexp_extract_all({sql_replaced("text", GLUED)}, {quoted(SIGNALLED)})), ' +') AS p FROM ({_NOTES})), w AS (SELECT doc, p[-1] AS name, len(p) > 1 AS s FROM t WHERE NOT regexp_matches(p[-1], '^[IVXLCDM]+$') AND p[-1] NOT IN (SELECT siglum FROM siglum_list)),
      c AS (SELECT doc, name, count(*) AS times, count(*) FILTER (s) AS signalled, name IN (SELECT name FROM k) AS known FROM w GROUP BY 1, 2) SELECT * FROM c WHERE known OR signalled > 0""",
    "listed_works": f"""WITH l AS (SELECT doc_id, generate_subscripts(x, 1) - 1 AS no, unnest(x) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents WHERE source = 'bibliography')), b AS (SELECT *, trim(regexp_replace(line, '^- ', '')) AS body FROM l WHERE trim(line) <> '' AND NOT regexp_matches(line, '^-{{3,}}$|^[0-9]{{3}}\\.?$')),
      g AS (SELECT *, (starts_with(line, '- ') OR ({_sql_opens("body")})) AND NOT regexp_matches(body, '^[*''"]') AS begins FROM b), s AS (SELECT *, last_value(CASE WHEN begins THEN trim(regexp_extract(body, '^([^,]*)', 1)) END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS surname FROM g),
      w AS (SELECT *, CASE WHEN begins THEN trim(regexp_extract(body, '^[^,]*,[^,]*,(.*)$', 1)) ELSE body END AS work FROM s WHERE surname IS NOT NULL) SELECT doc_id, no, surname, {_sql_entry_title("work")} AS title, nullif(regexp_extract(work, '([12][0-9]{{3}})', 1), '') AS year FROM w""",
    "review_journals": """WITH r AS (SELECT entry_id, generate_subscripts(x, 1) - 1 AS k, unnest(x) AS text FROM (SELECT entry_id, list_transform(reviews, lambda r: r.text) AS x FROM bibliography_entry)),
      j AS (SELECT *, CASE WHEN regexp_matches(text, '(?i)(?:^|[^\\p{L}])ibid') THEN NULL ELSE nullif(trim(regexp_extract(text, '(?:[Dd]ans|ds\\.?|in)\\s+\\*([^*]+)\\*', 1)), '') END AS said FROM r)
      SELECT entry_id, k, last_value(said IGNORE NULLS) OVER (PARTITION BY entry_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS journal FROM j""",
    "siglum_cites": f"""WITH t AS (SELECT rec_id, definition, bibliography.author AS author, bibliography.title AS title, row_number() OVER (PARTITION BY rec_id ORDER BY loaded_at DESC, siglum DESC) AS n FROM citations WHERE siglum IS NOT NULL),
      p AS (SELECT *, regexp_extract(definition, '^(.+?),?\\s*\\*([^*]+)\\*', 1) AS of, regexp_extract(definition, '^(.+?),?\\s*\\*([^*]+)\\*', 2) AS ti, array_to_string(list_transform(string_split(lower(author), ' '), lambda w: upper(substr(w, 1, 1)) || substr(w, 2)), ' ') AS cased FROM t WHERE n = 1)
      SELECT rec_id, CASE WHEN author IS NOT NULL THEN concat_ws(', ', cased, nullif({_sql_short("title")}, '')) ELSE {_sql_short("definition").replace("38", "44")} END AS short, CASE WHEN of <> '' THEN trim(regexp_replace(of, '[,.]$', ''), ' ') || ', ' || {_sql_short("ti")} END AS page_short FROM p""",
    "harvested_sigla": f"""SELECT s AS siglum, count(*) AS uses, count(DISTINCT place) AS places FROM (SELECT place, CASE token WHEN 'LPD' THEN 'PDL' ELSE token END AS s FROM (SELECT place, unnest(regexp_extract_all(text, '\\[([^\\]]+)\\]\\{{\\.underline\\}}', 1)) AS token FROM (
      SELECT pageid AS place, body AS text FROM page_files UNION ALL SELECT CAST(rec_id AS VARCHAR), definition FROM citations UNION ALL SELECT CAST(rec_id AS VARCHAR), evidence FROM citations UNION ALL SELECT CAST(rec_id AS VARCHAR), siglum FROM citations))) WHERE {_SHAPE} AND s NOT IN ({", ".join(map(quoted, SIGLUM_STOP))}) GROUP BY 1""",
    "resolved_entries": f"""{_RESOLVED} SELECT f.rec_id, f.entry_id, score, CASE WHEN len(list_filter(points, lambda q: page BETWEEN q.lo AND q.hi)) > 0 THEN entry ELSE concat_ws(', ', regexp_replace(regexp_replace(regexp_replace(entry, '[\\s.]+$', ''), {quoted(EXTENT)}, ''), '[ ,;]+$', ''), 'vol. ' || volume, 'p. ' || page) END AS cite FROM f JOIN r ON f.rec_id = r.rec_id JOIN e ON f.entry_id = e.entry_id""",
    "entry_backlinks": f"{_RESOLVED} SELECT entry_id, count(*) AS records, min(rec_id) AS first FROM f GROUP BY 1",
    "edition_hits": """WITH c AS (SELECT DISTINCT rec_id, vol, upper(bibliography.author) AS want, substr(bibliography.title, 1, 10) AS begun FROM citations WHERE bibliography.author IS NOT NULL), cw AS (SELECT *, unnest(list_distinct(regexp_extract_all(want, '\\p{Lu}{4,}'))) AS word FROM c),
      e AS (SELECT vol, entry_id, section, text, unnest(list_distinct(regexp_extract_all(upper(author), '\\p{Lu}{4,}'))) AS word FROM bibliography_entry WHERE author IS NOT NULL)
      SELECT rec_id, entry_id FROM (SELECT rec_id, entry_id, row_number() OVER (PARTITION BY rec_id ORDER BY section <> 'litterature', entry_id) AS n FROM cw JOIN e ON cw.vol = e.vol AND cw.word = e.word WHERE contains(text, begun)) WHERE n = 1""",
}
