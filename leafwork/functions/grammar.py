"""Small grammars of the apparatus: lemma heads, reference lists, tables, markup. Columns unless stated."""

from __future__ import annotations

import html
import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def squeeze_blank_lines(text: Column) -> Column:
    return F.regexp_replace(text, r"\n{3,}", "\n\n")


def lemma_head(line: Column) -> Column:
    """``12-14. le mot`` as first 12, last 14, open false, label; ``12 ss.`` is open; null fields where it is no head."""
    at = lambda k: F.try_to_number(F.nullif(F.regexp_extract(line, r"^\s*v?v?\.?\s*(\d+)(?:\s*[-–]\s*(\d+))?(\s*ss\.?)?\.?\s*(.*)$", k), F.lit("")), F.lit("999999")).cast("int")
    label = F.regexp_extract(line, r"^\s*v?v?\.?\s*\d+(?:\s*[-–]\s*\d+)?(?:\s*ss\.?)?\.?\s*(.*)$", 1)
    return F.struct(at(1).alias("first"), at(2).alias("last"), line.rlike(r"^\s*v?v?\.?\s*\d+\s*ss").alias("open"), F.nullif(label, F.lit("")).alias("label"))


def reference_list(text: Column) -> Column:
    """``XX, 43; XIX, 5, 7`` as rows of song and verse; ``passim`` and what is no numeral is dropped."""
    groups = F.filter(F.transform(F.split(text, ";"), lambda x: F.trim(x)), lambda g: g.rlike(r"^[IVXLC]+\s*,"))
    rows = F.transform(
        groups,
        lambda g: F.transform(
            F.regexp_extract_all(F.regexp_replace(g, r"\d+\s*×", ""), F.lit(r"(\d+)"), F.lit(1)),
            lambda v: F.struct(F.regexp_extract(g, r"^([IVXLC]+)", 1).alias("song"), v.cast("int").alias("verse")),
        ),
    )
    return F.flatten(rows)


def preceding(text: Column, mark: Column, window: int = 600) -> Column:
    """The last quoted or emphasized title within ``window`` letters before ``mark``, or null."""
    at = F.instr(text, mark)
    left = F.substr(text, F.greatest(at - window, F.lit(1)), F.least(at - 1, F.lit(window)))
    return F.when(at > 0, F.try_element_at(F.regexp_extract_all(left, F.lit(r"(\*[^*]+\*|«[^»]+»)"), F.lit(1)), F.lit(-1)))


def around(text: Column, pattern: str, before: int = 40, after: int = 24) -> Column:
    """Each match of ``pattern`` with the letters beside it."""
    return F.regexp_extract_all(text, F.lit(rf"((?s).{{0,{before}}}(?:{pattern}).{{0,{after}}})"), F.lit(1))


def parallels(text: Column) -> Column:
    """Lines ``a / b (v. 3)`` as rows of left, right and verse."""
    part = lambda x, k: F.trim(F.regexp_extract(x, r"^(.*?) / (.*?)(?: \(v\. ?(\d+)\))?$", k))
    lines = F.filter(F.split(text, "\n"), lambda x: x.contains(" / "))
    return F.transform(lines, lambda x: F.struct(part(x, 1).alias("left"), part(x, 2).alias("right"), F.nullif(part(x, 3), F.lit("")).alias("verse")))


def dedent(block: Column) -> Column:
    """A block without the indentation that all its filled lines share."""
    lines = F.split(block, "\n")
    widths = F.transform(F.filter(lines, lambda x: F.trim(x) != ""), lambda x: F.length(x) - F.length(F.ltrim(x)))
    n = F.coalesce(F.array_min(widths), F.lit(0))
    return F.array_join(F.transform(lines, lambda x: F.substr(x, n + 1)), "\n")


def notes_once(text: Column) -> Column:
    """Labels of a text's notes, each once, in order of first mention."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"\[\^([^\]]+)\]"), F.lit(1)))


_INLINE = ((re.compile(r"\*\*([^*]+)\*\*"), r"<strong>\1</strong>"), (re.compile(r"\*([^*]+)\*"), r"<em>\1</em>"), (re.compile(r"\[([^\]]+)\]\{\.(\w+)\}"), r'<span class="\2">\1</span>'), (re.compile(r"\[([^\]^]+)\]\(([^)\s]+)\)"), r'<a href="\2">\1</a>'), (re.compile(r"\^([^^\s]+)\^"), r"<sup>\1</sup>"))


def inline_html(text: str) -> str:
    """Emphasis, spans, links and superscripts of one paragraph as HTML; all else escaped."""
    out = html.escape(text, quote=False)
    for pattern, put in _INLINE:
        out = pattern.sub(put, out)
    return out


def block_html(text: str) -> str:
    """Paragraphs, headings, fenced verse and stars as HTML."""
    out = []
    for block in re.split(r"\n\s*\n", text.strip()):
        if block.startswith(":::"):
            lines = [x for x in block.split("\n") if not x.startswith(":::")]
            out.append("<blockquote>" + "<br>".join(map(inline_html, lines)) + "</blockquote>")
        elif m := re.match(r"(#{1,6}) (.*)", block):
            out.append(f"<h{len(m[1])}>{inline_html(m[2])}</h{len(m[1])}>")
        elif re.fullmatch(r"[*+ ]{1,5}", block):
            out.append("<hr>")
        elif block:
            out.append("<p>" + inline_html(" ".join(block.split("\n"))) + "</p>")
    return "\n".join(out)


def render(text: Column) -> Column:
    """:func:`block_html` in Arrow batches: markup has no built-in parser."""
    return F.pandas_udf(lambda texts: texts.map(lambda t: None if t is None else block_html(t)), StringType())(text)


def linked_tokens(text: Column, known: Column) -> Column:
    """The tokens of a text that are in the array ``known``, longest first: references to wrap."""
    tokens = F.array_distinct(F.regexp_extract_all(text, F.lit(r"([\p{L}0-9.²]+)"), F.lit(1)))
    return F.array_sort(F.array_intersect(F.transform(tokens, lambda t: F.regexp_replace(t, r"\.$", "")), known), lambda a, b: F.length(b) - F.length(a))

