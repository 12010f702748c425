"""Queries on the layout of pages: kinds of pages and lines, reflowed blocks, paragraphs over pages, labels of notes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafwork.functions.edition import ASTERISMS, FEW_BLANKS, HEADERISH, INDEX_KINDS, KEYWORD_HEADING, LINE_KINDS, PAGE_KINDS, SINGLE_BLANKS, SOFT_END, TYPOGRAPHY, UNDERLINED, heading_letters, index_kind, is_heading_text, is_terminal, mergeable, page_kind, stripped, typography
from leafwork.functions.rules import first_of, quoted, replaced, sql_first_of, sql_replaced
from leafwork.operators.apparatus import note_marks, residual
from leafwork.operators.ordered import fenced, overflow_pairs
from leafwork.plans.pages import LINES, MARKS, _lines
from leafwork.sources.sinks import joined_text
from leafwork.sources.tables import table



def placed(df: DataFrame) -> DataFrame:
    """With vol and idx out of the file's name."""
    return df.withColumns({"vol": F.regexp_extract("file_name", r"v(\d+)p", 1), "idx": F.try_to_number(F.nullif(F.regexp_extract("file_name", r"p(\d+)\.md", 1), F.lit("")), F.lit("9999999")).cast("int")})


SQL_PLACE = "regexp_extract(file_name, 'v(\\d+)p', 1) AS vol, TRY_CAST(regexp_extract(file_name, 'p(\\d+)\\.md', 1) AS INTEGER) AS idx"


def page_kinds(spark: SparkSession, d: str) -> DataFrame:
    """What each page is: by its head, else by whether a number was read from it."""
    read = table(spark, d, "page_numbers").groupBy("pageid").agg(F.max_by("printed_number", F.struct("read_at", "loaded_at", "printed_number")).alias("printed"))
    pages = table(spark, d, "page_files").join(read, "pageid", "left")
    return pages.select("file_name", page_kind(F.col("body"), F.col("pageid"), F.coalesce("printed", F.lit(""))).alias("kind"))


def index_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Which index a word index announces in its head."""
    return table(spark, d, "documents").where("source = 'word_index'").select("doc_id", index_kind(F.col("text")).alias("kind"))


def line_types(spark: SparkSession, d: str) -> DataFrame:
    """Lines of each page by kind, in flow order: within fences verses and breaks."""
    rows = fenced(_lines(spark, d), ["file_name"], ["no"], "line")
    kind = F.when(F.col("inside") & (F.trim("line") == ""), "break").when(F.col("inside"), "verse").otherwise(first_of(F.col("line"), LINE_KINDS, "paragraph"))
    return rows.groupBy("file_name", kind.alias("kind")).agg(F.count(F.lit(1)).alias("lines"))


def blocks(spark: SparkSession, d: str) -> DataFrame:
    """file_name, pageid, provenance, island, kind, text: the blocks of every page.

    Lines of a paragraph are joined, without the hyphen where one ends in a
    soft one; blank lines, anchors, fences and asterisms part paragraphs, a
    note's definition begins one; verses stay lines of their own.
    """
    pages = table(spark, d, "page_files").withColumn("body", replaced(F.col("body"), (*ASTERISMS, *FEW_BLANKS)))
    rows = pages.select("file_name", "pageid", "provenance", F.posexplode(F.split("body", "\n")).alias("no", "line"))
    rows = fenced(rows, ["file_name"], ["no"], "line")
    bare = F.trim("line")
    part = (bare == "") | bare.startswith("<!-- page:") | bare.startswith(":::") | (bare == "⁂")
    note = bare.rlike(r"^\[\^[^\]]+\]:")
    up = Window.partitionBy("file_name").orderBy("no").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("island", F.sum((part | note | F.col("inside")).cast("long")).over(up)).where(~part)
    kind = F.when(F.col("inside"), "verse").when(note, "note").otherwise("")
    rows = rows.select("file_name", "pageid", "provenance", "island", "no", kind.alias("kind"), F.when(F.col("inside"), F.col("line")).otherwise(bare).alias("line"))
    kinds = rows.groupBy("file_name", "pageid", "provenance", "island").agg(F.max("kind").alias("kind"))
    text = joined_text(rows, ["file_name", "island"], "no", "line", "\n")
    joined = F.regexp_replace(F.regexp_replace("text", r"([0-9A-Za-zà-ÿÀ-ß])-\n", "$1"), "\n", " ")
    out = kinds.join(text, ["file_name", "island"])
    return out.select("file_name", "pageid", "provenance", "island", F.when(F.col("kind") == "", "paragraph").otherwise(F.col("kind")).alias("kind"), F.when(F.col("kind") == "verse", typography(F.col("text"), False)).otherwise(typography(joined)).alias("text"))


def reflow_blocks(spark: SparkSession, d: str) -> DataFrame:
    return blocks(spark, d).select("file_name", "island", "kind", "text")


def page_joins(spark: SparkSession, d: str) -> DataFrame:
    """Pages whose first paragraph goes on from the page before, and the chain of pages that one paragraph runs through."""
    rows = blocks(spark, d).where("provenance = 'base' AND kind <> 'note'").transform(placed)
    ends = rows.groupBy("vol", "idx", "pageid").agg(F.count(F.lit(1)).alias("parts"), F.min_by(F.struct("kind", "text"), "island").alias("head"), F.max_by(F.struct("kind", "text"), "island").alias("tail"))
    w = Window.partitionBy("vol").orderBy("idx")
    before = ends.withColumns({"last": F.lag("tail").over(w), "alone": F.lag("parts").over(w) == 1})
    goes_on = F.coalesce((F.col("last.kind") == "paragraph") & (F.col("head.kind") == "paragraph") & mergeable(F.col("last.text"), F.col("head.text")), F.lit(False))
    rows = before.withColumn("goes_on", goes_on)
    begins = ~F.col("goes_on") | ~F.coalesce("alone", F.lit(False))
    chain = F.sum(begins.cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("chain", chain).select("vol", "pageid", "parts", "goes_on", "chain", is_heading_text(F.col("head.text")).alias("begins_with_heading"), (~is_terminal(F.col("tail.text"))).alias("open"))


def note_split(spark: SparkSession, d: str) -> DataFrame:
    """Where a page's notes begin: the lines before the first definition and those from it on."""
    rows = _lines(spark, d)
    first = F.min(F.when(F.col("line").rlike(r"^\[\^[^\]]+\]:"), F.col("no")))
    return rows.groupBy("file_name").agg(first.alias("at"), F.max("no").alias("n")).select("file_name", "at", F.coalesce(F.col("at") - 1, F.col("n")).alias("body_lines"), F.coalesce(F.col("n") - F.col("at") + 1, F.lit(0)).alias("foot_lines"))


def page_heals(spark: SparkSession, d: str) -> DataFrame:
    """Words cut between pages of one transcription: the stub on the page and what the next one gives back."""
    rows = _lines(spark, d)
    first = rows.where(F.col("line").rlike(r"^\[\^[^\]]+\]:")).groupBy("file_name").agg(F.min("no").alias("at"))
    body = rows.join(first, "file_name", "left").where("(at IS NULL OR no < at) AND trim(line) <> ''").transform(placed)
    ends = body.groupBy("provenance", "vol", "idx", "pageid").agg(F.max_by("line", "no").alias("last"), F.min_by("line", "no").alias("first"))
    w = Window.partitionBy("provenance", "vol").orderBy("idx")
    rows = ends.withColumns({"next": F.lead("first").over(w), "next_idx": F.lead("idx").over(w), "last": F.rtrim("last")})
    rows = rows.where((F.col("next_idx") == F.col("idx") + 1) & F.col("last").rlike(SOFT_END) & ~F.trim("next").rlike(HEADERISH))
    stub = F.regexp_replace("last", "-$", "")
    return rows.select("provenance", "pageid", F.right(stub, F.lit(18)).alias("stub"), F.regexp_extract(F.trim("next"), "^([^ ]+)", 1).alias("rest"))


def final_labels(spark: SparkSession, d: str) -> DataFrame:
    """The label each note of a page gets in the whole book: the page's and its own, or, for a definition left over from the page before, that of its reference."""
    marks = note_marks(_lines(spark, d), ["file_name"])
    faults = residual(marks, ["file_name"]).transform(placed)
    pairs = overflow_pairs(faults.where("fault = 'dangling'"), faults.where("fault = 'orphan'"), ["vol"], "idx", "label")
    moved = pairs.select("vol", (F.col("idx") + 1).alias("idx"), F.col("next_label").alias("label"), F.format_string("v%sp%03d-%s", "vol", "idx", "label").alias("moved")).distinct()
    own = marks.select("file_name", "label").distinct().transform(placed)
    page = F.regexp_extract("file_name", r"(v\d+p\d+)", 1)
    return own.join(moved, ["vol", "idx", "label"], "left").select("file_name", "label", F.coalesce("moved", F.concat_ws("-", page, "label")).alias("final"))


PARTS = ("LA LANGUE", "LA VERSIFICATION", "LES MANUSCRITS", "REMARQUES SUR LE TEXTE")


def expected_parts(spark: SparkSession, d: str) -> DataFrame:
    """Where the parts of a volume begin: each part's heading counts only behind the one of the part before."""
    rows = _lines(spark, d).where("provenance = 'base'").transform(placed)
    heads = rows.select("vol", (F.col("idx") * 100000 + F.col("no")).alias("at"), heading_letters(F.regexp_replace("line", r"^[IVX]+\.\s*|[\s.]*[0-9]+\s*$|^[0-9]+\s*", "")).alias("head"))
    of = lambda k: heads.where(F.col("head") == PARTS[k].replace(" ", ""))
    out = found = of(0).groupBy("vol").agg(F.min("at").alias("at")).withColumn("part", F.lit(PARTS[0]))
    for k in range(1, len(PARTS)):
        found = of(k).join(found.select("vol", F.col("at").alias("after")), "vol").where("at > after").groupBy("vol").agg(F.min("at").alias("at")).withColumn("part", F.lit(PARTS[k]))
        out = out.unionByName(found)
    return out.select("vol", "part", "at")


PATCHES = (("front-matter", r"^PLANCHE\s+([IVXLC]+)", r"[PLANCHE \1]"), ("body", r"(?m)^([IVX]+)\. (LA [A-Z]+)$", r"## \1. \2"))


def patched_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages that a table of patches changes: for a kind of page a pattern and what is put for it, the patches in order."""
    kinds = table(spark, d, "manifest").groupBy("pageid").agg(F.min("kind").alias("page_kind"))
    pages = table(spark, d, "page_files").join(kinds, "pageid")
    body = F.col("body")
    for kind, pattern, put in PATCHES:
        body = F.when(F.col("page_kind") == kind, replaced(body, ((pattern, put),))).otherwise(body)
    return pages.select("file_name", body.alias("patched"), "body").where("patched <> body").select("file_name", F.length("patched").cast("long").alias("letters"), F.substring(F.md5("patched"), 1, 12).alias("digest"))


def printed_headings(spark: SparkSession, d: str) -> DataFrame:
    """The first of a page's first eight blocks that spells out a part's title in few words, and what follows its colon."""
    rows = blocks(spark, d).where("kind = 'paragraph'")
    place = F.row_number().over(Window.partitionBy("file_name").orderBy("island"))
    rows = rows.withColumn("place", place).where("place <= 8 AND length(text) <= 90")
    titles = "|".join(t.replace(" ", "") for t in PARTS)
    hit = rows.where(heading_letters(F.col("text")).rlike(rf"^(?:[IVX]+|[0-9]+)?(?:{titles})")).groupBy("file_name").agg(F.min_by(F.struct("place", "text"), "place").alias("h"))
    rest = F.nullif(F.regexp_replace(F.regexp_extract("h.text", ":\\s*(.*)$", 1), r"\s*\.\s*$", ""), F.lit(""))
    return hit.select("file_name", F.col("h.place").cast("long").alias("place"), stripped(F.col("h.text")).alias("heading"), rest.alias("subtitle"))


def text_pages(spark: SparkSession, d: str) -> DataFrame:
    """Songs with the pages of their text that bear text: plates and dividers are left out."""
    kinds = page_kinds(spark, d).where("kind <> 'plate-or-divider'").select("file_name", "kind")
    files = table(spark, d, "page_files").where("provenance = 'base'").select("file_name", "pageid").join(kinds, "file_name")
    songs = table(spark, d, "chansons").select("chanson_id", F.explode("texte.pages").alias("pageid"))
    return songs.join(files, "pageid").groupBy("chanson_id").agg(F.count(F.lit(1)).alias("pages"), F.min("pageid").alias("first"))


QUERIES = {f.__name__: f for f in (page_kinds, index_kinds, line_types, reflow_blocks, page_joins, note_split, page_heals, final_labels, expected_parts, patched_pages, printed_headings, text_pages)}

_FENCED = f"""SELECT *, coalesce(last_value(CASE WHEN regexp_matches(line, '^:::\\s*\\{{') THEN 1 WHEN regexp_matches(line, '^:::\\s*$') THEN 0 END IGNORE NULLS)
  OVER (PARTITION BY file_name ORDER BY no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) = 1 AND NOT starts_with(line, ':::') AS inside"""
_HEAD = f"substr(regexp_replace(regexp_replace(body, '(?m)^<!-- page:.*$', '', 'g'), '^\\s+|\\s+$', '', 'g'), 1, 80)"
_BLOCKS = f"""SELECT file_name, any_value(pageid) AS pageid, any_value(provenance) AS provenance, island, CASE WHEN max(k) = '' THEN 'paragraph' ELSE max(k) END AS kind,
  CASE WHEN max(k) = 'verse' THEN {sql_replaced("string_agg(t, chr(10) ORDER BY no)", TYPOGRAPHY)}
  ELSE {sql_replaced("regexp_replace(regexp_replace(string_agg(t, chr(10) ORDER BY no), '([0-9A-Za-zà-ÿÀ-ß])-\\n', '\\1', 'g'), '\\n', ' ', 'g')", (TYPOGRAPHY[0], *SINGLE_BLANKS, *TYPOGRAPHY[1:]))} END AS text
  FROM (SELECT *, CASE WHEN inside THEN 'verse' WHEN note THEN 'note' ELSE '' END AS k, CASE WHEN inside THEN line ELSE bare END AS t FROM (
    SELECT *, CAST(sum(CASE WHEN part OR note OR inside THEN 1 ELSE 0 END) OVER (PARTITION BY file_name ORDER BY no) AS BIGINT) AS island FROM (
      SELECT *, bare = '' OR starts_with(bare, '<!-- page:') OR starts_with(bare, ':::') OR bare = '⁂' AS part, regexp_matches(bare, '^\\[\\^[^\\]]+\\]:') AS note FROM (
        SELECT *, trim(line) AS bare FROM ({_FENCED} FROM (SELECT file_name, pageid, provenance, generate_subscripts(l, 1) AS no, unnest(l) AS line FROM (
          SELECT file_name, pageid, provenance, string_split({sql_replaced("body", (*ASTERISMS, *FEW_BLANKS))}, chr(10)) AS l FROM page_files)))))) WHERE NOT part) GROUP BY file_name, island"""


def _sql_heading(text: str) -> str:
    bare = sql_replaced(f"regexp_replace({text}, '^\\s+|\\s+$', '', 'g')", UNDERLINED)
    return f"(regexp_matches({bare}, {quoted(KEYWORD_HEADING)}) OR (regexp_matches({bare}, '[A-ZÀ-Þ]') AND NOT regexp_matches({bare}, '[a-zà-ÿ]') AND length({bare}) <= 64))"


def _sql_terminal(text: str) -> str:
    bare = f"regexp_replace(regexp_replace(regexp_replace({text}, '\\[\\^[^\\]]*\\]', '', 'g'), '[*_`]', '', 'g'), '[)\\]»”\"''’\\s]+$', '')"
    return f"({bare} = '' OR regexp_matches({bare}, '[.!?:…]$'))"


def sql_letters(text: str) -> str:
    plain = sql_replaced(text, (("<[^>]*>", ""), ("œ|Œ", "oe"), ("æ|Æ", "ae")))
    return f"upper(regexp_replace(translate({plain}, 'àâäáãåçéèêëíìîïñóòôöõúùûüýÿÀÂÄÁÃÅÇÉÈÊËÍÌÎÏÑÓÒÔÖÕÚÙÛÜÝ', 'aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY'), '[^A-Za-z0-9]', '', 'g'))"


_HEADS = f"SELECT vol, idx * 100000 + no AS seat, {sql_letters(chr(0))} AS head FROM (SELECT *, {SQL_PLACE} FROM ({LINES})) WHERE provenance = 'base'".replace(chr(0), "regexp_replace(line, '^[IVX]+\\.\\s*|[\\s.]*[0-9]+\\s*$|^[0-9]+\\s*', '', 'g')")
_PART = [f"p{k} AS (SELECT h.vol, min(seat) AS seat, {quoted(PARTS[k])} AS part FROM h {f'JOIN p{k - 1} ON h.vol = p{k - 1}.vol AND h.seat > p{k - 1}.seat' if k else ''} WHERE head = {quoted(PARTS[k].replace(' ', ''))} GROUP BY h.vol)".replace("min(seat)", "min(h.seat)") for k in range(len(PARTS))]
_PATCHED = "body"
for _kind, _pattern, _put in PATCHES:
    _PATCHED = f"CASE WHEN page_kind = '{_kind}' THEN {sql_replaced(_PATCHED, ((_pattern, _put),))} ELSE {_PATCHED} END"
_FAULTS = f"""SELECT file_name, label, 'dangling' AS fault FROM m a WHERE NOT def AND NOT EXISTS (SELECT 1 FROM m b WHERE b.def AND b.file_name = a.file_name AND b.label = a.label)
  UNION ALL SELECT file_name, label, 'orphan' FROM m a WHERE def AND NOT EXISTS (SELECT 1 FROM m b WHERE NOT b.def AND b.file_name = a.file_name AND b.label = a.label)"""
SQL = {
    "page_kinds": f"""WITH r AS (SELECT pageid, printed_number AS printed FROM (SELECT *, row_number() OVER (PARTITION BY pageid ORDER BY read_at DESC, loaded_at DESC, printed_number DESC) AS n FROM page_numbers) WHERE n = 1)
      SELECT file_name, {sql_first_of(_HEAD, PAGE_KINDS, "CASE WHEN coalesce(printed, '') <> '' THEN 'body' WHEN p.pageid < 'v1p010' OR starts_with(p.pageid, 'v2p000') THEN 'front-matter' ELSE 'plate-or-divider' END")} AS kind FROM page_files p LEFT JOIN r ON p.pageid = r.pageid""",
    "text_pages": None,
    "index_kinds": f"SELECT doc_id, {sql_first_of('upper(regexp_replace(substr(text, 1, 90), chr(92) || chr(115) || chr(43), chr(0), chr(103)))'.replace('chr(92) || chr(115) || chr(43), chr(0), chr(103)', quoted(chr(92) + 's+') + ', ' + quoted('') + ', ' + quoted('g')), INDEX_KINDS, quoted('index-noms'))} AS kind FROM documents WHERE source = 'word_index'",
    "line_types": f"SELECT file_name, CASE WHEN inside AND trim(line) = '' THEN 'break' WHEN inside THEN 'verse' ELSE {sql_first_of('line', LINE_KINDS, quoted('paragraph'))} END AS kind, count(*) AS lines FROM ({_FENCED} FROM ({LINES})) GROUP BY 1, 2",
    "reflow_blocks": f"SELECT file_name, island, kind, text FROM ({_BLOCKS})",
    "page_joins": f"""WITH b AS (SELECT *, {SQL_PLACE} FROM ({_BLOCKS}) WHERE provenance = 'base' AND kind <> 'note'), e AS (SELECT vol, idx, pageid, count(*) AS parts, arg_min({{'kind': kind, 'text': text}}, island) AS head, arg_max({{'kind': kind, 'text': text}}, island) AS tail FROM b GROUP BY 1, 2, 3),
      l AS (SELECT *, lag(tail) OVER w AS last, lag(parts) OVER w = 1 AS alone FROM e WINDOW w AS (PARTITION BY vol ORDER BY idx)),
      g AS (SELECT *, coalesce(last.kind = 'paragraph' AND head.kind = 'paragraph' AND NOT {_sql_heading('last.text')} AND NOT {_sql_heading('head.text')} AND NOT starts_with(last.text, '<') AND NOT starts_with(head.text, '<') AND NOT {_sql_terminal('last.text')}, false) AS goes_on FROM l)
      SELECT vol, pageid, parts, goes_on, CAST(sum(CASE WHEN NOT goes_on OR NOT coalesce(alone, false) THEN 1 ELSE 0 END) OVER (PARTITION BY vol ORDER BY idx) AS BIGINT) AS chain, {_sql_heading('head.text')} AS begins_with_heading, NOT {_sql_terminal('tail.text')} AS open FROM g""",
    "note_split": f"SELECT file_name, d AS \"at\", coalesce(d - 1, n) AS body_lines, coalesce(n - d + 1, 0) AS foot_lines FROM (SELECT file_name, min(no) FILTER (regexp_matches(line, '^\\[\\^[^\\]]+\\]:')) AS d, max(no) AS n FROM ({LINES}) GROUP BY 1)",
    "page_heals": f"""WITH l AS (SELECT *, min(no) FILTER (regexp_matches(line, '^\\[\\^[^\\]]+\\]:')) OVER (PARTITION BY file_name) AS d, {SQL_PLACE} FROM ({LINES})),
      e AS (SELECT provenance, vol, idx, pageid, rtrim(arg_max(line, no)) AS last, arg_min(line, no) AS first FROM l WHERE (d IS NULL OR no < d) AND trim(line) <> '' GROUP BY 1, 2, 3, 4),
      n AS (SELECT *, lead(first) OVER w AS nx, lead(idx) OVER w AS ni FROM e WINDOW w AS (PARTITION BY provenance, vol ORDER BY idx))
      SELECT provenance, pageid, right(regexp_replace(last, '-$', ''), 18) AS stub, regexp_extract(trim(nx), '^([^ ]+)', 1) AS rest FROM n WHERE ni = idx + 1 AND regexp_matches(last, {quoted(SOFT_END)}) AND NOT regexp_matches(trim(nx), {quoted(HEADERISH)})""",
    "final_labels": f"""WITH m AS (SELECT *, {SQL_PLACE} FROM ({MARKS})), f AS (SELECT *, {SQL_PLACE} FROM ({_FAULTS})),
      a AS (SELECT *, row_number() OVER (PARTITION BY vol, idx ORDER BY label) AS r FROM f WHERE fault = 'dangling'), o AS (SELECT *, row_number() OVER (PARTITION BY vol, idx ORDER BY label) AS r FROM f WHERE fault = 'orphan'),
      j AS (SELECT DISTINCT o.vol, o.idx, o.label, printf('v%sp%03d-%s', a.vol, a.idx, a.label) AS moved FROM a JOIN o ON a.vol = o.vol AND a.idx + 1 = o.idx AND a.r = o.r)
      SELECT DISTINCT m.file_name, m.label, coalesce(moved, regexp_extract(m.file_name, '(v\\d+p\\d+)', 1) || '-' || m.label) AS final FROM m LEFT JOIN j ON m.vol = j.vol AND m.idx = j.idx AND m.label = j.label""",
    "expected_parts": f"WITH h AS ({_HEADS}), {', '.join(_PART)} " + " UNION ALL ".join(f'SELECT vol, part, seat AS "at" FROM p{k}' for k in range(len(PARTS))),
    "patched_pages": f"""SELECT file_name, length(patched) AS letters, substr(md5(patched), 1, 12) AS digest FROM (SELECT file_name, body, {_PATCHED} AS patched FROM page_files JOIN (SELECT pageid, min(kind) AS page_kind FROM manifest GROUP BY 1) k ON page_files.pageid = k.pageid) WHERE patched <> body""",
    "printed_headings": f"""WITH b AS (SELECT *, row_number() OVER (PARTITION BY file_name ORDER BY island) AS place FROM ({_BLOCKS}) WHERE kind = 'paragraph'),
      h AS (SELECT file_name, min(place) AS place, arg_min(text, place) AS t FROM b WHERE place <= 8 AND length(text) <= 90 AND regexp_matches({sql_letters('text')}, '^(?:[IVX]+|[0-9]+)?(?:{"|".join(t.replace(" ", "") for t in PARTS)})') GROUP BY 1)
      SELECT file_name, place, regexp_replace(t, '^\\s+|\\s+$', '', 'g') AS heading, nullif(regexp_replace(regexp_extract(t, ':\\s*(.*)$', 1), '\\s*\\.\\s*$', ''), '') AS subtitle FROM h""",
}
SQL["text_pages"] = f"SELECT chanson_id, count(*) AS pages, min(c.pageid) AS first FROM (SELECT chanson_id, unnest(texte.pages) AS pageid FROM chansons) c JOIN page_files f ON f.pageid = c.pageid AND provenance = 'base' JOIN ({SQL['page_kinds']}) k ON k.file_name = f.file_name WHERE kind <> 'plate-or-divider' GROUP BY 1"
