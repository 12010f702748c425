"""Scalar rules of the edition's texts: typography, headings, names, citations. Columns that stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leafwork.functions.rules import Rules, first_of, replaced
from leafwork.functions.text import deaccent, short_title

NNBSP = " "
# Fixed values, here and below: the patterns of the texts' format, letters of names, particles, words that make no acronym, abbreviations that are no sigla, aliases.
CAP, LOW = "[A-ZÀ-ÖØ-Þ]", "[a-zà-öø-ÿ]"
GIVEN = rf"(?:{CAP}(?:{LOW}+|\.)\s+|{CAP}\.-?{CAP}?\.?\s+)*"
SURNAME = rf"{CAP}{CAP}[A-ZÀ-ÖØ-Þ'’.\-]+"
AUTHOR = rf"{GIVEN}{SURNAME}(?:(?:\s+(?:et|E\.|and)\s+|\s*,\s*)?{GIVEN}{SURNAME})*"
CITATION = rf"""(?:{AUTHOR}|ID\.|Id\.)\s*,\s*(?:\*[^*]+\*|"[^"]{{4,}}"|'[^']{{4,}}')"""
BACK = r"(?i)(?:op\.?\s*cit|ouv\.?\s*cit|art\.?\s*cit|loc\.?\s*cit|ibid)\.?"
BACK_TITLE = r"(?i)^\s*(?:(?:op|ouv|art|loc)\.?\s*cit|ibid)"
LEAD = r"(?i)^(?:voir\s+aussi\s+|voir\s+|cfr\.?\s+|cf\.\s+|e\.a\.\s+|dans\s+|chez\s+|see\s+|aussi\s+|selon\s+|d'après\s+)+"
ACRONYM_STOP = ("fur", "de", "des", "du", "della", "and", "the", "et", "zur", "im", "in", "a", "la", "le", "les", "of", "dei", "del")
SIGLUM_STOP = ("C.R.", "N.B.", "P.S.", "N.D.", "N.D.L.R.")
ALIASES = {"LPD": "PDL"}

TYPOGRAPHY: Rules = (
    (r"\[\^(\d+)\^\]", r"[^\1]"), (r"([^\s\p{Lu}]) - (\S)", r"\1 — \2"), (r"(\p{Lu}) - ([^\s\p{Lu}])", r"\1 — \2"),
    (r" ([;:!?])", NNBSP + r"\1"), ("« ", "«" + NNBSP), (" »", NNBSP + "»"),
)
SINGLE_BLANKS: Rules = ((r" {2,}", " "),)
#: Runs of lines that are ``+`` or blank and begin with ``+`` become one mark.
ASTERISMS: Rules = ((r"(?m)^[ \t]*\+[ \t]*$(?:\n[ \t]*\+?[ \t]*$)*", "\n⁂\n"),)
FEW_BLANKS: Rules = ((r"\n{3,}", "\n\n"),)
HEADING_LETTERS: Rules = ((r"<[^>]*>", ""), ("œ|Œ", "oe"), ("æ|Æ", "ae"))
#: A quoted title of an article before its journal or at the end, in double quotes.
QUOTES: Rules = ((r"(^|[\s(])'(.+?)'(\s*,?\s*(?:dans|ds\.?|in)[ *]|\s*[.,]?\s*$)", r'\1"\2"\3'),)
HEAD_MARKS: Rules = ((r"^#{1,6}\s*", ""), (r"\[|\]|\*", ""), (r"\{[^}]*\}", ""), (r"\s+", " "))
GLUED: Rules = ((r"(\p{Lu}(?:\.\p{Lu})*\.)(\p{Lu}[\p{Lu}'’-]{2,})", r"\1 \2"), (r"(\p{Lu}(?:\.\p{Lu})*\.)(\p{Lu}\p{Ll})", r"\1 \2"))
HANDS: Rules = ((r"\[\[hand:\s*(.+?)\]\]", r'<span class="hand">\1</span>'),)
CAESURA: Rules = ((r"(\S) {2,}(\S)", r'\1<span class="caesura"> </span>\2'),)
FENCE: Rules = ((r"^\s*```[^\n]*\n", ""), (r"\n?```\s*$", ""), (r"(?m)^\s*<!-- page:[^\n]*\n?", ""), (r"^\s+|\s+$", ""))
UNDERLINED: Rules = ((r"\[([^\]]*)\]\{\.underline\}", r"\1"),)

_BARE = r"\s*\]?\s*(?:\{\.underline\})?\s*:?\s*"
#: What the first 80 letters of a page say it is, in this order.
PAGE_KINDS: Rules = (
    ("chanson-remarques", rf"(?i)CHANSON\s+[IVXL]+{_BARE}REMARQUES"), ("chanson-texte", rf"(?i)CHANSON\s+[IVXL]+{_BARE}TEXTE"),
    ("introduction", r"(?i)^I\s*N\s*T\s*R\s*O\s*D\s*U\s*C\s*T\s*I\s*O\s*N"), ("bibliographie", r"(?i)^B\s*I\s*B\s*L\s*I\s*O\s*G\s*R\s*A\s*P\s*H\s*I\s*E"),
    ("index", r"(?i)^I\s*N\s*D\s*E\s*X(?:[^\p{L}]|$)"), ("table-matieres", r"(?i)TABLE\s+DES\s+MATI"),
)
INDEX_KINDS: Rules = (("index-mots", "MOTS"), ("index-nw", r"N\.W"), ("index-oeuvres", "OEUVRES|ŒUVRES|AUTEURS"))
#: What a line of a song's page is, in this order, outside fences.
LINE_KINDS: Rules = (
    ("anchor", r"^\s*<!--\s*page:"), ("definition", r"^\[\^[^\]]+\]:"), ("open", r"^\s*:{3,}\s*\{[^}]*\}\s*$"), ("close", r"^\s*:{3,}\s*$"), ("blank", r"^\s*$"), ("rule", r"^\s*-{3,}\s*$"),
    ("hand", r"^\s*\[\[hand:"), ("heading", r"^\s*CHANSON(?:[^\p{L}]|$)"), ("star", r"^\s*\\\*"), ("source", r"(?i)^\s*(?:\d+\.\s*)?D['’]apr[eè]s l['’][eé]d"),
)
HEADERISH = r"(?i)^(?:CHANSON(?:[^\p{L}]|$)|:::|#|[IVX]+\.|[A-Z]\.\s|⁂|B\s?I\s?B|I\s?N\s?D)"
SOFT_END = r"[0-9A-Za-zà-ÿÀ-ß]-$"
KEYWORD_HEADING = r"^(?:#{1,6}\s|CHANSON(?:[^\p{L}]|$)|CONCLUSION(?:[^\p{L}]|$)|VERS\s+UNE\s+PO|INDEX(?:[^\p{L}]|$)|BIBLIOGRAPHIE(?:[^\p{L}]|$)|AVANT[\s-]*PROPOS|TABLE\s+DES(?:[^\p{L}]|$))"


def stripped(text: Column) -> Column:
    """Without white space at the ends, line ends included."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def typography(text: Column, single_blanks: bool = True) -> Column:
    return replaced(text, (TYPOGRAPHY[0], *SINGLE_BLANKS, *TYPOGRAPHY[1:]) if single_blanks else TYPOGRAPHY)


def page_kind(body: Column, pageid: Column, printed: Column) -> Column:
    """What the page's head says, else front matter or plate for a page without number, else body."""
    head = F.substring(stripped(F.regexp_replace(body, r"(?m)^<!-- page:.*$", "")), 1, 80)
    front = (pageid < "v1p010") | pageid.startswith("v2p000")
    return first_of(head, PAGE_KINDS, F.when(printed != "", "body").when(front, "front-matter").otherwise("plate-or-divider"))


def index_kind(head: Column) -> Column:
    """Which index its head announces; that of names by default."""
    return first_of(F.upper(F.regexp_replace(F.substring(head, 1, 90), r"\s+", "")), INDEX_KINDS, F.lit("index-noms"))


def is_heading_text(text: Column) -> Column:
    """A marked heading, a keyword in capitals, or a line of capitals of at most 64 letters."""
    bare = replaced(stripped(text), UNDERLINED)
    return bare.rlike(KEYWORD_HEADING) | (bare.rlike("[A-ZÀ-Þ]") & ~bare.rlike("[a-zà-ÿ]") & (F.length(bare) <= 64))


def is_terminal(text: Column) -> Column:
    """Whether a text ends a sentence, notes, emphasis and closing marks left aside; an empty one does."""
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"\[\^[^\]]*\]", ""), r"[*_`]", ""), r"[)\]»”\"'’\s]+$", "")
    return (bare == "") | bare.rlike(r"[.!?:…]$")


def mergeable(before: Column, after: Column) -> Column:
    """Whether two paragraphs parted by a page are one."""
    return ~is_heading_text(before) & ~is_heading_text(after) & ~before.startswith("<") & ~after.startswith("<") & ~is_terminal(before)


def plausible_heading(title: Column) -> Column:
    return (F.length(title) > 2) & (F.length(title) < 70) & ~title.contains(",") & ~title.rlike("[0-9]")


def is_siglum(token: Column) -> Column:
    """Short, without blank, a capital first: all capitals, with a dot, or up to four letters with a hyphened one."""
    shape = (F.upper(token) == token) & token.rlike(r"\p{L}")
    return (F.length(token) <= 9) & ~token.contains(" ") & token.rlike(r"^\p{Lu}") & (shape | token.contains(".") | token.rlike(r"^[A-Z][A-Za-z]{0,3}\.?(-[A-Z]\.?)?$")) & ~token.isin(*SIGLUM_STOP)


def opens_author(line: Column) -> Column:
    """Whether a line without bullet begins with a surname: a first field of at most 30 letters, seven tenths capitals, before a comma."""
    head = F.trim(F.regexp_extract(replaced(line, UNDERLINED), r"^([^,]*)", 1))
    letters = F.regexp_count(head, F.lit(r"\p{L}"))
    return line.contains(",") & (F.length(head) <= 30) & (letters >= 2) & head.rlike(r"^[A-ZÀ-Þ]{2}") & (F.regexp_count(head, F.lit(r"\p{Lu}")) >= 0.7 * letters)


def heading_letters(text: Column) -> Column:
    """Capital letters and digits of a heading, ligatures and accents undone."""
    return F.upper(F.regexp_replace(deaccent(replaced(text, HEADING_LETTERS)), r"[^A-Za-z0-9]", ""))


def clean_title(title: Column) -> Column:
    """A heading without stars; letters set apart are put together, and a capital E gets the accent it lacks."""
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(title, r"^[\s*]+|[\s*]+$", ""), r"\s+", " "), r"\s+$", "")
    joined = F.lower(F.replace(bare, F.lit(" "), F.lit("")))
    joined = F.concat(F.upper(F.substring(joined, 1, 1)), F.substr(joined, F.lit(2)))
    return F.regexp_replace(F.when(bare.rlike(r"^\S( \S){2,}$"), joined).otherwise(bare), "^E(tude|dition)", "É$1")


def head_words(text: Column) -> Column:
    return F.lower(F.trim(replaced(text, HEAD_MARKS)))


def short_author(author: Column) -> Column:
    """Initials and surname of one author, of two with ``et``, of the first of more with ``et al.``."""
    groups = F.split(F.trim(author), r"\s+et\s+|\s*&\s*")
    first, second = _one_author(F.get(groups, F.lit(0))), _one_author(F.get(groups, F.lit(1)))
    return F.when(F.size(groups) > 2, F.concat(first, F.lit(" et al."))).when(F.size(groups) == 2, F.concat_ws(" et ", first, second)).otherwise(first)


TAIL = r"((?:\s?[A-ZÀ-Þ][A-ZÀ-Þ'’\-]+)+)$"
INITIALS = r"^(?:[A-Za-zÀ-ÿ]\.){1,3}(?:-[A-Za-zÀ-ÿ]\.?)?$"


def _one_author(name: Column) -> Column:
    surname = F.trim(F.regexp_extract(name, TAIL, 1))
    given = F.filter(F.split(F.regexp_replace(name, TAIL, ""), " "), lambda g: g.rlike("^[A-Za-zÀ-ÿ]"))
    short = F.transform(given, lambda g: F.when(g.rlike(INITIALS), g).otherwise(F.concat(F.upper(F.substring(g, 1, 1)), F.lit("."))))
    return F.when((surname == "") | ~name.contains(" "), name).otherwise(F.array_join(F.concat(short, F.array(surname)), " "))


def entry_title(text: Column) -> Column:
    """The quoted title of an article, else the italic one of a book; empty if neither."""
    quoted = F.nullif(F.regexp_extract(text, r"'([^']{4,})'", 1), F.lit(""))
    return F.trim(F.coalesce(quoted, F.regexp_extract(text, r"\*([^*]+)\*", 1)))


def match_title(text: Column) -> Column:
    """The title that references are held against: italic, else quoted, without accents, in small letters."""
    italic = F.nullif(F.regexp_extract(text, r"\*([^*]+)\*", 1), F.lit(""))
    found = F.coalesce(italic, F.regexp_extract(text, "[\"“']([^\"”']{5,})[\"”']", 1))
    return F.regexp_replace(F.lower(deaccent(found)), r"^[ .]+|[ .]+$", "")


def journal(text: Column) -> Column:
    """The journal a citation stands in, or null."""
    return F.nullif(F.trim(F.regexp_extract(text, r"(?:[Dd]ans|ds\.?|in)\s+\*([^*]+)\*", 1)), F.lit(""))


POINT = r"(?:^|[^\p{L}])([IVXLCDM]+)\s*,\s*(?:\(?\d{4}\)?\s*[,;]?\s*)?pp?\.?\s*(\d+)(?:\s*[—–\-]\s*(\d+))?"
SPAN = r"pp\.\s*(\d+)\s*[—–\-]\s*(\d+)"


def cited_points(text: Column) -> Column:
    """vol, lo, hi of every place a citation gives; spans of pages without volume count once."""
    part = lambda p, k: F.regexp_extract_all(text, F.lit(p), F.lit(k))
    number = lambda c: F.try_to_number(c, F.lit("9999999")).cast("int")
    full = F.transform(F.arrays_zip(part(POINT, 1).alias("v"), part(POINT, 2).alias("a"), part(POINT, 3).alias("b")), lambda x: F.struct(x["v"].alias("vol"), number(x["a"]).alias("lo"), number(F.coalesce(F.nullif(x["b"], F.lit("")), x["a"])).alias("hi")))
    bare = F.transform(F.arrays_zip(part(SPAN, 1).alias("a"), part(SPAN, 2).alias("b")), lambda x: F.struct(F.lit(None).cast("string").alias("vol"), number(x["a"]).alias("lo"), number(x["b"]).alias("hi")))
    return F.concat(full, F.filter(bare, lambda b: ~F.exists(full, lambda p: (p["lo"] == b["lo"]) & (p["hi"] == b["hi"]))))


def title_score(ref: Column, title: Column) -> Column:
    """How well a reference's title fits an entry's: 6 its beginning, 5 but for two letters, 4 by words, else 0."""
    tight = lambda c: F.replace(c, F.lit(" "), F.lit(""))
    words, theirs = F.regexp_extract_all(ref, F.lit("[a-zà-ÿ]{4,}"), F.lit(0)), F.regexp_extract_all(title, F.lit("[a-zà-ÿ]{3,}"), F.lit(0))
    hits = F.size(F.filter(words, lambda w: F.exists(theirs, lambda e: e.startswith(w) | w.startswith(e))))
    need = F.when(F.size(words) <= 2, F.size(words)).otherwise(F.size(words) - 1)
    near = F.substr(ref, F.lit(1), F.greatest(F.lit(6), F.length(ref) - 2))
    score = F.when(title.startswith(ref) | tight(title).startswith(tight(ref)), 6).when(title.startswith(near), 5).when((F.size(words) > 0) & (hits >= need), 4).otherwise(0)
    return F.when((F.length(ref) < 4) | (title == "") | ref.isNull() | title.isNull(), 0).otherwise(score)


EXTENT = r"(?i)[,;]?\s*\(?(?:(?:[IVXLCDM]+\s*\+\s*)?\d+\s*(?:vols?|pp|p|pages?|coll?|col)\.?|pp?\.\s*\d+)\)?\.?\s*$"


def with_locus(cite: Column, vol: Column, page: Column) -> Column:
    """A citation with the volume and page meant, in place of the extent at its end."""
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(cite, r"[\s.]+$", ""), EXTENT, ""), r"[ ,;]+$", "")
    return F.concat_ws(", ", bare, F.concat(F.lit("vol. "), vol), F.concat(F.lit("p. "), page.cast("string")))


def printed_label(first: Column, last: Column) -> Column:
    """``p. 3`` or ``pp. 3–5``; empty without a number."""
    return F.when(first.isNull(), "").when(first == last, F.concat(F.lit("p. "), first)).otherwise(F.concat(F.lit("pp. "), first, F.lit("–"), last))


def hanging_indent(line: Column) -> Column:
    """Width of ``Name : `` with markup left aside, under which an entry's further lines hang; 0 without a colon."""
    head = F.regexp_extract(line, "^([^:]*:[   ]?)", 1)
    return F.length(F.regexp_replace(F.regexp_replace(head, r"\{[^}]*\}", ""), r"[*_`\[\]]", ""))


REF_START = r"^((?:[^()]|\([^()]*\))*?)(?:^|[^A-Za-z])([IVXLC]{1,8}\s*,.*)$"


def lemma_and_reference(entry: Column) -> Column:
    """lemma and ref: the reference begins at the first numeral with a comma outside parentheses."""
    part = lambda k: F.trim(F.regexp_extract(entry, REF_START, k))
    return F.struct(F.when(entry.rlike(REF_START), part(1)).otherwise(F.trim(entry)).alias("lemma"), part(2).alias("ref"))


def siglum_short(author: Column, title: Column, definition: Column) -> Column:
    """What a siglum stands for in few words: surname and short title, else the start of its definition."""
    of_work = F.concat_ws(", ", F.initcap(F.lower(author)), F.nullif(short_title(title), F.lit("")))
    return F.when(author.isNotNull(), of_work).otherwise(short_title(definition, 44))


def rebuilt_table(text: Column) -> Column:
    """A table whose lines were put on one, in lines again, empty cells kept; null if it is none.

    The rule line tells how many cells a line has; between lines the bars meet, and three lines make a table.
    """
    rule = F.regexp_extract(text, r"\|(?:\s*:?-{3,}:?\s*\|)+", 0)
    width = F.regexp_count(rule, F.lit("-{3,}"))
    parts = F.split(text, r"\|")
    cells = F.slice(parts, F.lit(2), F.size(parts) - F.when(F.trim(F.element_at(parts, -1)) == "", 2).otherwise(1))
    n = F.floor((F.size(cells) + 1) / (width + 1)).cast("int")
    numbers = F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)))
    row = lambda i: F.concat(F.lit("| "), F.array_join(F.transform(F.slice(cells, i * (width + 1) + 1, width), lambda c: F.trim(c)), " | "), F.lit(" |"))
    met = F.forall(numbers, lambda i: F.trim(F.coalesce(F.get(cells, i * (width + 1) + width), F.lit(""))) == "")
    whole = (width >= 2) & (F.trim(F.get(parts, F.lit(0))) == "") & ((F.size(cells) + 1) % (width + 1) == 0) & (n >= 3) & met
    return F.when(whole, F.array_join(F.transform(numbers, row), "\n"))


def witness_key(token: Column, known: Column) -> Column:
    """The witness of the array ``known`` that a printed token means: its letter with 2 if it bears one and there is such, else the letter; null if neither. Case counts."""
    bare = F.trim(F.replace(replaced(token, UNDERLINED), F.lit("*"), F.lit("")))
    letter = F.substring(bare, 1, 1)
    second = F.when(bare.rlike(r"\^?[2²]\^?'?$"), F.concat(letter, F.lit("2")))
    return F.when(F.array_contains(known, second), second).when(F.array_contains(known, letter), letter)
