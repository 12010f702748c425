"""Queries on citations, bibliography, sigla and songs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafwork.functions.edition import ACRONYM_STOP, is_siglum
from leafwork.functions.text import acronym, balanced_quotes, deaccent, fold_key, from_roman, replace_nth, short_title, split_top, squeeze, strip_marks, surname_key, to_roman, unique_locator, upper_share
from leafwork.operators.apparatus import flags, link_to_entries
from leafwork.operators.match import best, cascade_lookup, first_wins, prefixes_agree, shared_letters, upsert_curated
from leafwork.operators.ordered import headings_cursor, running_distinct, shared_rank, suffix_repeats
from leafwork.sources.tables import table


def title_keys(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "bibliography_entry")
    return t.select("entry_id", fold_key(F.col("title")).alias("key"), short_title(F.col("title")).alias("short"), upper_share(F.regexp_extract("text", r"^(?:- )?([^,]*)", 1)).alias("capitals"), balanced_quotes(F.col("text"), "*").alias("balanced"))


def title_acronyms(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "siglum_list").select("siglum", "title", acronym(deaccent(F.col("title")), ACRONYM_STOP).alias("acronym"))
    return t.select("siglum", "acronym", is_siglum(F.col("siglum")).alias("plausible"), prefixes_agree(F.upper(F.regexp_replace("siglum", "[^A-Za-z]", "")), F.col("acronym")).alias("agrees"))


def plain_entries(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "bibliography_entry")
    return t.select("entry_id", squeeze(strip_marks(F.regexp_replace("text", "^- ", ""))).alias("plain"), F.size(split_top(F.col("text"))).cast("long").alias("parts"), surname_key(F.coalesce("author", F.lit(""))).alias("surname"))


def song_numbers(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "chansons").select("chanson_id", "num", "roman", to_roman(F.col("num")).alias("written"), from_roman(F.col("roman")).cast("long").alias("value"))
    return t.where((F.col("written") == F.col("roman")) & (F.col("value") == F.col("num"))).select("chanson_id", "written", "value")


def siglum_usage_counts(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "citations").where("siglum IS NOT NULL")
    return t.groupBy("siglum").agg(F.count(F.lit(1)).alias("uses"), F.array_join(F.array_sort(F.collect_set("vol")), " ").alias("volumes"), F.min("rec_id").alias("first_seen"))


def siglum_top(spark: SparkSession, d: str) -> DataFrame:
    return siglum_usage_counts(spark, d).orderBy(F.desc("uses"), "first_seen").limit(12).select("siglum", "uses")


def confidence_counts(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("confidence")
    return table(spark, d, "citations").groupBy("source").agg(F.count_if(c == "high").alias("high"), F.count_if(c == "medium").alias("medium"), F.count_if(c == "low").alias("low"), F.count_if(c.isNull()).alias("ungraded"))


def titles_per_author(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "bibliography_entry").where("author IS NOT NULL")
    key = F.upper(F.regexp_extract("author", r"^([^,]+)", 1)).alias("surname")
    return t.groupBy(key).agg(F.countDistinct("title").alias("titles"), F.min_by("title", "entry_id").alias("first"), F.max("page").alias("last_page"))


def first_definition(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "citations").where("siglum IS NOT NULL AND definition IS NOT NULL")
    return first_wins(t, ["vol", "siglum"], [F.col("entered_at"), F.col("rec_id"), F.col("loaded_at")], ["rec_id", "definition"])


def undefined_sigla(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "citations").where("siglum IS NOT NULL")
    many = t.groupBy("siglum").agg(F.count(F.lit(1)).alias("uses"), F.count("definition").alias("definitions")).where("uses >= 3 AND definitions = 0")
    return many.join(table(spark, d, "siglum_list").select("siglum"), "siglum", "left_anti").join(table(spark, d, "sigla_overrides").where("definition IS NOT NULL").select("siglum").distinct(), "siglum", "left_anti").select("siglum", "uses")


def curated_definitions(spark: SparkSession, d: str) -> DataFrame:
    derived = table(spark, d, "citations").where("siglum IS NOT NULL AND definition IS NOT NULL").groupBy("siglum").agg(F.min("definition").alias("definition"))
    curated = table(spark, d, "sigla_overrides").where("siglum IS NOT NULL AND definition IS NOT NULL").groupBy("siglum").agg(F.min("definition").alias("definition"), F.min("grp").alias("grp"))
    used = table(spark, d, "siglum_usage").select("siglum")
    return upsert_curated(derived, curated, used, "siglum")


def siglum_cascade(spark: SparkSession, d: str) -> DataFrame:
    used = table(spark, d, "siglum_usage").select("vol", "siglum").distinct()
    own = table(spark, d, "citations").where("definition IS NOT NULL AND siglum IS NOT NULL").select("vol", "siglum", "definition")
    any_vol = table(spark, d, "sigla_overrides").where("definition IS NOT NULL AND siglum IS NOT NULL").select("siglum", "definition")
    listed = table(spark, d, "siglum_list").select("siglum", "title")
    return cascade_lookup(used, [("volume", own, ["vol", "siglum"], "definition"), ("curated", any_vol, ["siglum"], "definition"), ("list", listed, ["siglum"], "title")], "meaning", "unresolved")


def linked_definitions(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "citations").where("definition IS NOT NULL").groupBy("rec_id").agg(F.min("siglum").alias("siglum"), F.min("definition").alias("text"))
    c = c.select(F.col("rec_id").alias("key"), "siglum", F.regexp_extract("text", r"([A-Z]{5,})", 1).alias("surname"), "text")
    e = table(spark, d, "bibliography_entry").select("entry_id", "siglum", F.regexp_extract(F.coalesce("author", F.lit("")), r"([A-Z]{5,})", 1).alias("surname"), "title")
    return link_to_entries(c, e)


def best_entry(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "citations").where("definition IS NOT NULL AND bibliography.title IS NOT NULL").select("vol", "rec_id", F.lower("definition").alias("text")).distinct()
    e = table(spark, d, "bibliography_entry").select("vol", "entry_id", "title")
    split = lambda col: F.array_distinct(F.regexp_extract_all(F.lower(col), F.lit(r"(\p{L}{5,})"), F.lit(1)))
    a = c.select("vol", "rec_id", F.explode(split("text")).alias("word"))
    b = e.select("vol", "entry_id", F.explode(split("title")).alias("word"))
    shared = a.join(b, ["vol", "word"]).groupBy("rec_id", "entry_id").agg(F.count(F.lit(1)).alias("score"))
    return best(shared, ["rec_id"], [F.col("score")], [F.col("entry_id")], ["entry_id", "score"])


def nested_reviews(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "bibliography_entry")
    return t.where(F.size("reviews") > 0).select("entry_id", F.size("reviews").cast("long").alias("reviews"), F.array_join(F.transform("reviews", lambda r: r["text"]), " | ").alias("texts"), unique_locator(F.array_join(F.transform("reviews", lambda r: r["text"]), " ")).alias("locator"))


def tree_counts(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "bibliography_entry").rollup("category", "section").agg(F.count(F.lit(1)).alias("entries"), F.grouping_id().alias("level"))
    return t.select(F.coalesce("category", F.lit("*")).alias("category"), F.coalesce("section", F.lit("*")).alias("section"), "entries", F.col("level").cast("long").alias("level"))


def heading_cursor(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "bibliography_entry").select("vol", "entry_id", "section", "category", "author")
    rows = headings_cursor(t, ["vol"], ["entry_id"], [F.when(F.col("author").isNotNull(), F.col("section")), F.when(F.col("category") == "periodical", F.col("category"))])
    return rows.select("entry_id", "level1", "level2")


def works_so_far(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "bibliography_entry").where("author IS NOT NULL")
    return running_distinct(t, ["vol", "author"], ["entry_id"], "title", "earlier").select("entry_id", F.col("earlier").cast("long").alias("earlier"))


def title_anchors(spark: SparkSession, d: str) -> DataFrame:
    return suffix_repeats(table(spark, d, "bibliography_entry").select("entry_id", "title"), "title", ["entry_id"], "anchor").select("entry_id", "anchor")


def usage_ranks(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "siglum_usage").groupBy("vol", "siglum").agg(F.sum("uses").alias("uses"))
    return shared_rank(t, ["vol"], "uses", ["siglum"]).select("vol", "siglum", F.col("cote").cast("long").alias("cote"), F.col("spread").cast("double").alias("spread"))


def songs_shared(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "chansons").where("incipit IS NOT NULL").select("chanson_id", "vol", fold_key(F.col("incipit")).alias("key"))
    a, b = t.toDF("song_a", "vol_a", "key"), t.toDF("song_b", "vol_b", "key")
    return a.join(b, "key").where("vol_a < vol_b").select("song_a", "song_b")


def song_gaps_all(spark: SparkSession, d: str) -> DataFrame:
    """Every number up to a volume's highest that no song of the volume bears."""
    t = table(spark, d, "chansons").select("vol", "num").distinct()
    every = t.groupBy("vol").agg(F.max("num").alias("n")).where("n >= 1").select("vol", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("num"))
    return every.join(t, ["vol", "num"], "left_anti")


def song_catalogue(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "chansons")
    parts = t.select("vol", "num", "chanson_id", F.explode(F.array(F.struct(F.lit("remarques").alias("kind"), F.size("remarques.pages").alias("n")), F.struct(F.lit("texte").alias("kind"), F.size("texte.pages").alias("n")))).alias("p")).select("vol", "num", "chanson_id", "p.*")
    last = parts.groupBy("vol", "num", "kind").agg(F.max_by("n", "chanson_id").alias("n"))
    return last.groupBy("vol", "num").pivot("kind", ["remarques", "texte"]).agg(F.first("n")).select("vol", "num", F.col("remarques").cast("long").alias("remarques"), F.col("texte").cast("long").alias("texte"))


def song_pages(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "chansons").select("chanson_id", F.posexplode("texte.pages").alias("i", "pageid"))
    at = table(spark, d, "manifest").groupBy("pageid").agg(F.max("printed").alias("printed"))
    known = pages.join(at, "pageid").where("printed <> ''")
    return known.groupBy("chanson_id").agg(F.min_by("printed", "i").alias("first"), F.max_by("printed", "i").alias("last"), F.count(F.lit(1)).alias("pages"))


def usage_matrix_all(spark: SparkSession, d: str) -> DataFrame:
    """Uses of each siglum in each volume that has it, in long form."""
    return table(spark, d, "siglum_usage").groupBy("siglum", "vol").agg(F.sum("uses").alias("uses"))


def page_sets(spark: SparkSession, d: str) -> DataFrame:
    used = table(spark, d, "chansons").select(F.explode("texte.pages").alias("pageid"))
    have = table(spark, d, "manifest").select("pageid")
    return used.subtract(have).withColumn("side", F.lit("used only")).unionByName(have.subtract(used).withColumn("side", F.lit("never used")))


def numbered_quotes(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "bibliography_entry")
    new = F.array(F.lit("§1"), F.lit("§2"))
    return t.select("entry_id", replace_nth(F.col("text"), "\\*", new).alias("text"))


def quality_flags(spark: SparkSession, d: str) -> DataFrame:
    one = lambda df, stage, category, key, detail: df.select(F.lit(stage).alias("stage"), F.lit(category).alias("category"), key.cast("string").alias("key"), detail.cast("string").alias("detail"))
    a = one(table(spark, d, "bibliography_entry").where("NOT text LIKE concat('%', title, '%')"), "bibliography", "title differs", F.col("entry_id"), F.col("title"))
    b = one(table(spark, d, "citations").where("siglum IS NULL AND definition IS NULL").select("rec_id", "source").distinct(), "citations", "empty", F.col("rec_id"), F.col("source"))
    c = one(table(spark, d, "chansons").where("incipit IS NULL"), "songs", "no first line", F.col("chanson_id"), F.col("roman"))
    e = one(table(spark, d, "page_files").where("body = ''"), "pages", "empty", F.col("file_name"), F.col("pageid"))
    return flags(a, b, c, e)


def flag_stats(spark: SparkSession, d: str) -> DataFrame:
    return quality_flags(spark, d).groupBy("stage", "category").agg(F.count(F.lit(1)).alias("items"), F.min("key").alias("first"))


def similar_titles(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "siglum_list")
    a = t.select(F.col("siglum").alias("a"), F.col("title").alias("ta"), F.element_at(F.split("title", " "), -1).alias("place"))
    b = t.select(F.col("siglum").alias("b"), F.col("title").alias("tb"), F.element_at(F.split("title", " "), -1).alias("place"))
    pairs = a.join(b, F.substring(a["place"], 1, 3) == F.substring(b["place"], 1, 3)).where("a < b")
    return pairs.select("a", "b", shared_letters(F.lower("ta"), F.lower("tb")).cast("long").alias("letters"))


QUERIES = {f.__name__: f for f in (title_keys, title_acronyms, plain_entries, song_numbers, siglum_usage_counts, siglum_top, confidence_counts, titles_per_author, first_definition, undefined_sigla, curated_definitions, siglum_cascade, linked_definitions, best_entry, nested_reviews, tree_counts, heading_cursor, works_so_far, title_anchors, usage_ranks, songs_shared, song_gaps_all, song_catalogue, song_pages, usage_matrix_all, page_sets, numbered_quotes, quality_flags, flag_stats, similar_titles)}

_FOLD = "regexp_replace(lower(translate({}, 'àâäáãåçéèêëíìîïñóòôöõúùûüýÿÀÂÄÁÃÅÇÉÈÊËÍÌÎÏÑÓÒÔÖÕÚÙÛÜÝ', 'aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY')), '[^a-z0-9]+', '', 'g')"
_ROMAN = "(['','M','MM','MMM'])[n // 1000 + 1] || (['','C','CC','CCC','CD','D','DC','DCC','DCCC','CM'])[n // 100 % 10 + 1] || (['','X','XX','XXX','XL','L','LX','LXX','LXXX','XC'])[n // 10 % 10 + 1] || (['','I','II','III','IV','V','VI','VII','VIII','IX'])[n % 10 + 1]"
_USES = "SELECT siglum, count(*) AS uses, array_to_string(list_sort(list(DISTINCT vol)), ' ') AS volumes, min(rec_id) AS first_seen FROM citations WHERE siglum IS NOT NULL GROUP BY 1"
_FLAGS = """SELECT 'bibliography' AS stage, 'title differs' AS category, CAST(entry_id AS VARCHAR) AS key, title AS detail FROM bibliography_entry WHERE NOT contains(text, title)
  UNION ALL SELECT DISTINCT 'citations', 'empty', CAST(rec_id AS VARCHAR), source FROM citations WHERE siglum IS NULL AND definition IS NULL
  UNION ALL SELECT 'songs', 'no first line', CAST(chanson_id AS VARCHAR), roman FROM chansons WHERE incipit IS NULL UNION ALL SELECT 'pages', 'empty', file_name, pageid FROM page_files WHERE body = ''"""
SQL = {
    "title_keys": f"""WITH h AS (SELECT *, trim(regexp_extract(regexp_replace(title, '[*_«»]', '', 'g'), '^([^,(]*)', 1)) AS head FROM bibliography_entry), c AS (SELECT *, regexp_extract(substr(head, 1, 38), '^(.*) [^ ]*$', 1) AS cut FROM h)
      SELECT entry_id, {_FOLD.format("title")} AS key, CASE WHEN length(head) <= 38 THEN head WHEN cut = '' THEN substr(head, 1, 38) || '…' ELSE cut || '…' END AS short,
      CASE WHEN len(regexp_extract_all(regexp_extract(text, '^(?:- )?([^,]*)', 1), '\\p{{L}}')) > 0 THEN round(len(regexp_extract_all(regexp_extract(text, '^(?:- )?([^,]*)', 1), '\\p{{Lu}}')) / len(regexp_extract_all(regexp_extract(text, '^(?:- )?([^,]*)', 1), '\\p{{L}}')), 4) END AS capitals, (length(text) - length(replace(text, '*', ''))) % 2 = 0 AS balanced FROM c""",
    "title_acronyms": """WITH a AS (SELECT siglum, upper(array_to_string(list_transform(list_filter(string_split(regexp_replace(translate(title, 'àâäáãåçéèêëíìîïñóòôöõúùûüýÿÀÂÄÁÃÅÇÉÈÊËÍÌÎÏÑÓÒÔÖÕÚÙÛÜÝ', 'aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY'), '[^\\p{L}]+', ' ', 'g'), ' '), lambda w: w <> '' AND lower(w) NOT IN ('fur','de','des','du','della','and','the','et','zur','im','in','a','la','le','les','of','dei','del')), lambda w: substr(w, 1, 1)), '')) AS acronym, upper(regexp_replace(siglum, '[^A-Za-z]', '', 'g')) AS k FROM siglum_list)
      SELECT siglum, acronym, length(siglum) <= 9 AND NOT contains(siglum, ' ') AND regexp_matches(siglum, '^\\p{Lu}') AND (upper(siglum) = siglum OR contains(siglum, '.') OR regexp_matches(siglum, '^[A-Z][A-Za-z]{0,3}\\.?(-[A-Z]\\.?)?$')) AND siglum NOT IN ('C.R.', 'N.B.', 'P.S.', 'N.D.', 'N.D.L.R.') AS plausible, least(length(k), length(acronym)) >= 2 AND substr(k, 1, least(length(k), length(acronym))) = substr(acronym, 1, least(length(k), length(acronym))) AS agrees FROM a""",
    "plain_entries": f"""SELECT entry_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '^- ', ''), '\\[\\^[^\\]]*\\]:?|\\{{[^}}]*\\}}', '', 'g'), '[*_\\[\\]]', '', 'g'), '\\s+', ' ', 'g')) AS plain,
      len(string_split(regexp_replace(text, '\\([^)]*\\)', '', 'g'), ',')) AS parts, {_FOLD.format("coalesce(nullif(regexp_extract(coalesce(author, ''), '(\\p{Lu}{3,})', 1), ''), regexp_extract(coalesce(author, ''), '([^ ,]+)[^ ]*$', 1))")} AS surname FROM bibliography_entry""",
    "song_numbers": f"SELECT chanson_id, {_ROMAN} AS written, CAST(n AS BIGINT) AS value FROM (SELECT chanson_id, num AS n, roman FROM chansons) WHERE roman = {_ROMAN}",
    "siglum_usage_counts": _USES,
    "siglum_top": f"SELECT siglum, uses FROM ({_USES}) ORDER BY uses DESC, first_seen LIMIT 12",
    "confidence_counts": "SELECT source, count(*) FILTER (confidence = 'high') AS high, count(*) FILTER (confidence = 'medium') AS medium, count(*) FILTER (confidence = 'low') AS low, count(*) FILTER (confidence IS NULL) AS ungraded FROM citations GROUP BY 1",
    "titles_per_author": "SELECT upper(regexp_extract(author, '^([^,]+)', 1)) AS surname, count(DISTINCT title) AS titles, arg_min(title, entry_id) AS first, max(page) AS last_page FROM bibliography_entry WHERE author IS NOT NULL GROUP BY 1",
    "first_definition": "SELECT vol, siglum, rec_id, definition FROM (SELECT *, row_number() OVER (PARTITION BY vol, siglum ORDER BY entered_at, rec_id, loaded_at) AS n FROM citations WHERE siglum IS NOT NULL AND definition IS NOT NULL) WHERE n = 1",
    "undefined_sigla": "SELECT siglum, count(*) AS uses FROM citations WHERE siglum IS NOT NULL AND siglum NOT IN (SELECT siglum FROM siglum_list) AND siglum NOT IN (SELECT siglum FROM sigla_overrides WHERE siglum IS NOT NULL AND definition IS NOT NULL) GROUP BY 1 HAVING count(*) >= 3 AND count(definition) = 0",
    "curated_definitions": """WITH c AS (SELECT siglum, min(definition) AS definition FROM citations WHERE siglum IS NOT NULL AND definition IS NOT NULL GROUP BY 1), o AS (SELECT siglum, min(definition) AS definition, min(grp) AS grp FROM sigla_overrides WHERE siglum IS NOT NULL AND definition IS NOT NULL GROUP BY 1)
      SELECT siglum, definition, NULL AS grp FROM c UNION ALL SELECT * FROM o WHERE siglum IN (SELECT siglum FROM siglum_usage) AND siglum NOT IN (SELECT siglum FROM c)""",
    "siglum_cascade": """SELECT u.vol, u.siglum, coalesce(a.m, b.m, c.m) AS meaning, CASE WHEN a.m IS NOT NULL THEN 'volume' WHEN b.m IS NOT NULL THEN 'curated' WHEN c.m IS NOT NULL THEN 'list' ELSE 'unresolved' END AS tier FROM (SELECT DISTINCT vol, siglum FROM siglum_usage) u
      LEFT JOIN (SELECT vol, siglum, min(definition) AS m FROM citations WHERE siglum IS NOT NULL GROUP BY 1, 2) a ON a.vol = u.vol AND a.siglum = u.siglum LEFT JOIN (SELECT siglum, min(definition) AS m FROM sigla_overrides GROUP BY 1) b ON b.siglum = u.siglum LEFT JOIN (SELECT siglum, min(title) AS m FROM siglum_list GROUP BY 1) c ON c.siglum = u.siglum""",
    "linked_definitions": """WITH c AS (SELECT rec_id AS key, min(siglum) AS siglum, min(definition) AS text FROM citations WHERE definition IS NOT NULL GROUP BY 1), d AS (SELECT *, regexp_extract(text, '([A-Z]{5,})', 1) AS surname FROM c),
      e AS (SELECT entry_id, siglum, regexp_extract(coalesce(author, ''), '([A-Z]{5,})', 1) AS surname, title FROM bibliography_entry), g AS (SELECT siglum, min(entry_id) AS entry_id FROM e WHERE siglum IS NOT NULL GROUP BY 1), t AS (SELECT key, g.entry_id FROM d JOIN g ON d.siglum = g.siglum),
      s AS (SELECT key, entry_id, row_number() OVER (PARTITION BY key ORDER BY len(list_intersect(list_distinct(string_split(lower(text), '')), list_distinct(string_split(lower(title), '')))) DESC, entry_id) AS n FROM d JOIN e ON d.surname = e.surname WHERE d.surname <> '' AND key NOT IN (SELECT key FROM t))
      SELECT key, entry_id, 'siglum' AS way FROM t UNION ALL SELECT key, entry_id, 'surname' FROM s WHERE n = 1""",
    "best_entry": """WITH a AS (SELECT DISTINCT vol, rec_id, unnest(list_distinct(regexp_extract_all(lower(definition), '\\p{L}{5,}'))) AS word FROM citations WHERE definition IS NOT NULL AND bibliography.title IS NOT NULL), b AS (SELECT vol, entry_id, unnest(list_distinct(regexp_extract_all(lower(title), '\\p{L}{5,}'))) AS word FROM bibliography_entry),
      s AS (SELECT rec_id, entry_id, count(*) AS score FROM a JOIN b ON a.vol = b.vol AND a.word = b.word GROUP BY 1, 2) SELECT rec_id, entry_id, score FROM (SELECT *, row_number() OVER (PARTITION BY rec_id ORDER BY score DESC, entry_id) AS n FROM s) WHERE n = 1""",
    "nested_reviews": """WITH r AS (SELECT entry_id, reviews, array_to_string(list_transform(reviews, lambda r: r.text), ' | ') AS texts, list_distinct(regexp_extract_all(array_to_string(list_transform(reviews, lambda r: r.text), ' '), 'pp?\\. ?([0-9]+)', 1)) AS l FROM bibliography_entry WHERE len(reviews) > 0)
      SELECT entry_id, len(reviews) AS reviews, texts, CASE WHEN len(l) = 1 THEN l[1] END AS locator FROM r""",
    "tree_counts": "SELECT coalesce(category, '*') AS category, coalesce(section, '*') AS section, count(*) AS entries, grouping_id(category, section) AS level FROM bibliography_entry GROUP BY ROLLUP (category, section)",
    "heading_cursor": """WITH a AS (SELECT *, CASE WHEN author IS NOT NULL THEN section END AS h1, CASE WHEN category = 'periodical' THEN category END AS h2 FROM bibliography_entry), b AS (SELECT *, last_value(h1 IGNORE NULLS) OVER w AS level1, sum(CASE WHEN h1 IS NOT NULL THEN 1 ELSE 0 END) OVER w AS run FROM a WINDOW w AS (PARTITION BY vol ORDER BY entry_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
      SELECT entry_id, level1, last_value(h2 IGNORE NULLS) OVER (PARTITION BY vol, run ORDER BY entry_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS level2 FROM b""",
    "works_so_far": "SELECT entry_id, count(DISTINCT title) OVER (PARTITION BY vol, author ORDER BY entry_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS earlier FROM bibliography_entry WHERE author IS NOT NULL",
    "title_anchors": "SELECT entry_id, CASE WHEN n > 1 THEN title || '-' || n ELSE title END AS anchor FROM (SELECT entry_id, title, row_number() OVER (PARTITION BY title ORDER BY entry_id) AS n FROM bibliography_entry)",
    "usage_ranks": """WITH u AS (SELECT vol, siglum, sum(uses) AS uses FROM siglum_usage GROUP BY 1, 2)
      SELECT vol, siglum, dense_rank() OVER (PARTITION BY vol ORDER BY uses) AS cote, CAST((row_number() OVER (PARTITION BY vol, uses ORDER BY siglum) - 1 - (count(*) OVER (PARTITION BY vol, uses) - 1) / 2) * 15.0 AS DOUBLE) AS spread FROM u""",
    "songs_shared": f"WITH t AS (SELECT chanson_id, vol, {_FOLD.format('incipit')} AS k FROM chansons WHERE incipit IS NOT NULL) SELECT a.chanson_id AS song_a, b.chanson_id AS song_b FROM t a JOIN t b ON a.k = b.k AND a.vol < b.vol",
    "song_gaps_all": "WITH t AS (SELECT DISTINCT vol, num FROM chansons), e AS (SELECT vol, unnest(range(1, max(num) + 1)) AS num FROM t GROUP BY vol) SELECT vol, CAST(num AS INTEGER) AS num FROM e WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.vol = e.vol AND t.num = e.num)",
    "song_catalogue": "SELECT vol, num, arg_max(len(remarques.pages), chanson_id) AS remarques, arg_max(len(texte.pages), chanson_id) AS texte FROM chansons GROUP BY 1, 2",
    "song_pages": """WITH p AS (SELECT chanson_id, generate_subscripts(l, 1) AS i, unnest(l) AS pageid FROM (SELECT chanson_id, texte.pages AS l FROM chansons)), m AS (SELECT pageid, max(printed) AS printed FROM manifest GROUP BY 1)
      SELECT chanson_id, arg_min(printed, i) AS first, arg_max(printed, i) AS last, count(*) AS pages FROM p JOIN m ON p.pageid = m.pageid WHERE printed <> '' GROUP BY 1""",
    "usage_matrix_all": "SELECT siglum, vol, CAST(sum(uses) AS BIGINT) AS uses FROM siglum_usage GROUP BY 1, 2",
    "page_sets": "WITH u AS (SELECT DISTINCT unnest(texte.pages) AS pageid FROM chansons) SELECT pageid, 'used only' AS side FROM u WHERE pageid NOT IN (SELECT pageid FROM manifest) UNION ALL SELECT DISTINCT pageid, 'never used' FROM manifest WHERE pageid NOT IN (SELECT pageid FROM u)",
    "numbered_quotes": "SELECT entry_id, regexp_replace(regexp_replace(text, '\\*', '§1'), '\\*', '§2') AS text FROM bibliography_entry",
    "quality_flags": _FLAGS,
    "flag_stats": f"SELECT stage, category, count(*) AS items, min(key) AS first FROM ({_FLAGS}) GROUP BY 1, 2",
    "similar_titles": """WITH t AS (SELECT siglum, title, substr(string_split(title, ' ')[-1], 1, 3) AS p FROM siglum_list)
      SELECT a.siglum AS a, b.siglum AS b, len(list_intersect(list_distinct(string_split(lower(a.title), '')), list_distinct(string_split(lower(b.title), '')))) AS letters FROM t a JOIN t b ON a.p = b.p AND a.siglum < b.siglum""",
}
