"""Scalar functions on text, as Columns that stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Latin letters with accents and what they are without, for texts of this closed alphabet.
ACCENTED = "àâäáãåçéèêëíìîïñóòôöõúùûüýÿÀÂÄÁÃÅÇÉÈÊËÍÌÎÏÑÓÒÔÖÕÚÙÛÜÝ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY"


def deaccent(text: Column) -> Column:
    """Letters of the closed alphabet without accents; others unchanged."""
    return F.translate(text, ACCENTED, PLAIN)


def fold_key(text: Column) -> Column:
    """Lower-case ASCII letters and digits only: a key for comparing."""
    return F.regexp_replace(F.lower(deaccent(text)), "[^a-z0-9]+", "")


def squeeze(text: Column) -> Column:
    """White space collapsed to one blank, none at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def short_title(text: Column, most: int = 38) -> Column:
    """Emphasis dropped, cut at the first comma or parenthesis, then at a word so that ``most`` letters suffice, with an ellipsis."""
    head = F.regexp_replace(F.regexp_extract(F.regexp_replace(text, r"[*_«»]", ""), r"^([^,(]*)", 1), r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")
    cut = F.regexp_extract(F.substring(head, 1, most), r"^(.*) [^ ]*$", 1)
    return F.when(F.length(head) <= most, head).otherwise(F.concat(F.when(cut == "", F.substring(head, 1, most)).otherwise(cut), F.lit("…")))


def acronym(text: Column, stop: tuple[str, ...] = ("de", "des", "du", "la", "le", "les", "et", "d", "l")) -> Column:
    """First letters of the words that are not in ``stop``, in upper case."""
    words = F.filter(F.split(F.regexp_replace(text, r"[^\p{L}]+", " "), " "), lambda w: (w != "") & ~F.lower(w).isin(*stop))
    return F.upper(F.array_join(F.transform(words, lambda w: F.substring(w, 1, 1)), ""))


def upper_share(text: Column) -> Column:
    """Share of the letters that are capitals; null without letters."""
    letters = F.regexp_count(text, F.lit(r"\p{L}"))
    return F.when(letters > 0, F.round(F.regexp_count(text, F.lit(r"\p{Lu}")) / letters, 4))


def balanced_quotes(text: Column, mark: str = '"') -> Column:
    """Whether ``mark`` occurs an even number of times."""
    return (F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit("")))) % 2 == 0


def strip_tags(text: Column) -> Column:
    return F.regexp_replace(text, r"<[^>]*>", "")


def strip_marks(text: Column) -> Column:
    """Markdown emphasis, notes and attributes dropped."""
    return F.regexp_replace(F.regexp_replace(text, r"\[\^[^\]]*\]:?|\{[^}]*\}", ""), r"[*_\[\]]", "")


def surname_key(author: Column) -> Column:
    """The first run of capitals, else the last word, folded."""
    capitals = F.nullif(F.regexp_extract(author, r"(\p{Lu}{3,})", 1), F.lit(""))
    return fold_key(F.coalesce(capitals, F.regexp_extract(author, r"([^ ,]+)[^ ]*$", 1)))


def last_capitals(author: Column) -> Column:
    """The last word written in capitals, or null."""
    found = F.filter(F.split(author, r"[ ,]+"), lambda w: w.rlike(r"^\p{Lu}{2,}$"))
    return F.try_element_at(found, F.lit(-1))


def title_case(text: Column, small: tuple[str, ...] = ("de", "du", "des", "la", "le", "von", "van", "di")) -> Column:
    """Every word with a capital first letter but particles."""
    return F.array_join(F.transform(F.split(F.lower(text), " "), lambda w: F.when(w.isin(*small), w).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2))))), " ")


def superscript(text: Column) -> Column:
    return F.regexp_replace(text, r"\^([^^ ]+)\^", "<sup>$1</sup>")


def unique_locator(text: Column) -> Column:
    """The page a text refers to if it refers to one only, else null."""
    pages = F.array_distinct(F.regexp_extract_all(text, F.lit(r"pp?\. ?([0-9]+)"), F.lit(1)))
    return F.when(F.size(pages) == 1, pages[0])


def places(text: Column, tiles: str, opening: str) -> Column:
    """at (from 1) and found of every part of a text that ``tiles``, whose alternatives cover all of it, cuts out and that is more than its opening."""
    parts = F.regexp_extract_all(text, F.lit(f"({tiles})"), F.lit(1))
    before = lambda i: F.aggregate(F.slice(parts, F.lit(1), i), F.lit(0), lambda n, x: n + F.length(x))
    return F.filter(F.transform(parts, lambda x, i: F.struct((before(i) + 1).alias("at"), x.alias("found"))), lambda p: p["found"].startswith(opening) & (F.length(p["found"]) > 1))


def locator_type(text: Column) -> Column:
    """``pp. 3`` and ``p.3`` as ``p.`` with a narrow no-break space."""
    return F.regexp_replace(text, r"\bpp?\. ?(?=[0-9])", "p. ")


def split_references(text: Column) -> Column:
    """A run of references split after a full stop that follows a digit or bracket."""
    return F.split(text, r"(?<=[0-9\])])\.\s+")


def split_witnesses(text: Column) -> Column:
    """A run of manuscript references split before each siglum."""
    return F.split(text, r"[;,]\s+(?=\p{Lu}[0-9²]?\b)")


def label_tail(text: Column) -> Column:
    return F.substring_index(text, "-", -1)


def url_quote(text: Column) -> Column:
    return F.replace(F.url_encode(text), F.lit("+"), F.lit("%20"))


def split_top(text: Column, mark: str = ",") -> Column:
    """Split at ``mark`` outside parentheses of one level."""
    return F.transform(F.split(text, rf"{mark}(?![^(]*\))"), lambda x: F.trim(x))


def expand_optional(text: Column) -> Column:
    """Every reading of a form with optional letters in parentheses: ``am(o)r`` gives amr and amor."""
    parts = F.split(text, r"[()]")
    indexed = F.transform(parts, lambda p, i: F.struct(p.alias("p"), (i % 2).alias("optional")))
    start = F.array(F.lit(""))
    grown = F.aggregate(
        indexed,
        start,
        lambda done, x: F.when(x["optional"] == 1, F.concat(done, F.transform(done, lambda d: F.concat(d, x["p"])))).otherwise(F.transform(done, lambda d: F.concat(d, x["p"]))),
    )
    return F.array_sort(F.array_distinct(grown))


def common_prefix(a: Column, b: Column) -> Column:
    """Length of the longest common beginning."""
    steps = F.sequence(F.lit(1), F.greatest(F.least(F.length(a), F.length(b)), F.lit(1)))
    return F.coalesce(F.array_max(F.filter(steps, lambda n: (F.substr(a, F.lit(1), n) == F.substr(b, F.lit(1), n)) & (F.length(a) >= n) & (F.length(b) >= n))), F.lit(0))


def to_roman(number: Column) -> Column:
    """Roman numeral of 1 to 3999; null for other numbers."""
    digits = (("", "I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX"), ("", "X", "XX", "XXX", "XL", "L", "LX", "LXX", "LXXX", "XC"), ("", "C", "CC", "CCC", "CD", "D", "DC", "DCC", "DCCC", "CM"), ("", "M", "MM", "MMM"))
    parts = [F.element_at(F.array(*map(F.lit, row)), (F.floor(number / 10**k) % (10 if k < 3 else 4)).cast("int") + 1) for k, row in enumerate(digits)]
    return F.when(number.between(1, 3999), F.concat(*reversed(parts)))


def from_roman(text: Column) -> Column:
    """Value of a roman numeral in capitals; null for other text."""
    pairs = F.split(F.regexp_replace(text, "(?<=.)(?=.)", " "), " ")
    value = F.create_map(*[F.lit(x) for p in (("I", 1), ("V", 5), ("X", 10), ("L", 50), ("C", 100), ("D", 500), ("M", 1000)) for x in p])
    total = F.aggregate(
        F.transform(pairs, lambda c: F.try_element_at(value, c)),
        F.struct(F.lit(0).alias("sum"), F.lit(0).alias("last")),
        lambda a, v: F.struct((a["sum"] + v - F.when(a["last"] < v, 2 * a["last"]).otherwise(0)).alias("sum"), v.alias("last")),
        lambda a: a["sum"],
    )
    return F.when(text.rlike("^[IVXLCDM]+$"), total)


def attributes(text: Column) -> Column:
    """``{.a .b k=v}`` as a struct of classes and a map of keys."""
    items = F.filter(F.split(F.regexp_extract(text, r"\{([^}]*)\}", 1), r"\s+"), lambda x: x != "")
    classes = F.transform(F.filter(items, lambda x: x.startswith(".")), lambda x: F.substr(x, F.lit(2)))
    pairs = F.filter(items, lambda x: x.contains("="))
    return F.struct(classes.alias("classes"), F.map_from_entries(F.transform(pairs, lambda x: F.struct(F.substring_index(x, "=", 1), F.regexp_replace(F.substring_index(x, "=", -1), '"', "")))).alias("keys"))


def outside_tags(text: Column, change) -> Column:
    """``change`` applied to the text between tags only."""
    pieces = F.regexp_extract_all(text, F.lit(r"(<[^>]*>|[^<]+)"), F.lit(1))
    return F.array_join(F.transform(pieces, lambda p: F.when(p.startswith("<"), p).otherwise(change(p))), "")


def replace_nth(text: Column, pattern: str, with_: Column) -> Column:
    """The i-th match of ``pattern`` replaced by the i-th element of ``with_``, where it has one."""
    pieces = F.split(text, pattern)
    found = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))
    put = F.transform(found, lambda m, i: F.coalesce(F.get(with_, i), m))
    return F.array_join(F.zip_with(pieces, put, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")


def is_heading(text: Column) -> Column:
    """A marked heading, or a short line of capitals."""
    return text.rlike(r"^#{1,6} ") | ((F.length(text) <= 64) & text.rlike(r"^[^\p{Ll}]*\p{Lu}{2}[^\p{Ll}]*$"))


def ends_sentence(text: Column) -> Column:
    """Whether a text ends in terminal punctuation, notes and closing marks left aside."""
    return F.regexp_replace(F.regexp_replace(text, r"(\[\^[^\]]*\])+\s*$", ""), r"[»\")\]*\s]+$", "").rlike(r"[.!?…:]$")


def line_kind(line: Column) -> Column:
    """First rule that fits: anchor, definition, fence, rule, heading, star, blank, text."""
    return (
        F.when(line.startswith("<!-- page:"), "anchor")
        .when(line.rlike(r"^\[\^[^\]]+\]:"), "definition")
        .when(line.startswith(":::"), "fence")
        .when(line.rlike(r"^\s*(-{3,}|\*{3,})\s*$"), "rule")
        .when(line.rlike(r"^\s*[+*]\s*$"), "star")
        .when(line.rlike(r"^\s*$"), "blank")
        .when(is_heading(line), "heading")
        .otherwise("text")
    )
