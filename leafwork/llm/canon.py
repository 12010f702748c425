"""One form for text that prints alike.

A text is cut at its unstable segments: runs of characters that normalization
or the alike rules may change, found by quick-check properties, together with
the starter before them and the combining marks after them. Only these segments
are normalized; the rest of the text is copied unchanged.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from leafwork.operators.match import salted_join

# Letters of other scripts that print like a Latin letter.
_GREEK = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧνοϲϳ"
_GREEK_LATIN = "ABEZHIKMNOPTYXvocj"
_CYRILLIC = "АВЕЅІЈКМНОРСТХѴԀԌԚԜҮасеорѕухѵіјһԁԛԝү"
_CYRILLIC_LATIN = "ABESIJKMHOPCTXVDGQWYaceopsyxvijhdqwy"
# Hyphens that print like the keyboard's.
_HYPHENS = "‐‑﹣"
# Format characters that do print.
_SEEN_FORMAT = {*range(0x600, 0x606), 0x6DD, 0x70F, 0x8E2, 0x110BD, 0x110CD}
_JOINED = {*range(0xFB00, 0xFB07), 0x132, 0x133, *range(0x1C7, 0x1CD), 0x1F1, 0x1F2, 0x1F3}

#: Texts without such a character are in canonical form already.
SUSPECT = "[^\\t\\n\\r\\x20-\\x7e\\u00a1-\\u00ac\\u00ae-\\u00ff]"
_LOOK = re.compile(r"[^\t\n\r\x20-\x7e¡-¬®-ÿ]+")


def _alike() -> dict[int, str]:
    out = {ord(a): b for a, b in zip(_GREEK + _CYRILLIC, _GREEK_LATIN + _CYRILLIC_LATIN, strict=True)}
    return out | {ord(c): "-" for c in _HYPHENS}


_ALIKE = _alike()


@lru_cache(maxsize=100_000)
def _printed(c: str) -> str:
    """What one decomposed character prints as; empty if it does not show."""
    cp = ord(c)
    if cp in _ALIKE:
        return _ALIKE[cp]
    kind = unicodedata.category(c)
    if kind == "Zs":
        return " "
    if (kind == "Cf" and cp not in _SEEN_FORMAT) or cp == 0x34F or 0x180B <= cp <= 0x180D or 0xFE00 <= cp <= 0xFE0F or 0xE0100 <= cp <= 0xE01EF:
        return ""
    if cp in _JOINED:
        return unicodedata.normalize("NFKC", c)
    how = unicodedata.decomposition(c)
    if how.startswith(("<wide>", "<narrow>")):
        return "".join(map(_printed, unicodedata.normalize("NFKD", c)))
    return c


def _normal(segment: str) -> str:
    parts = unicodedata.normalize("NFD", segment)
    return unicodedata.normalize("NFC", unicodedata.normalize("NFD", "".join(map(_printed, parts))))


@lru_cache(maxsize=1)
def _may_join() -> frozenset[str]:
    """Starters that may compose with the character before them (quick check: maybe)."""
    second = {int(d.split()[1], 16) for cp in range(0xA0, 0x11A00) if (d := unicodedata.decomposition(chr(cp))) and d[0] != "<" and " " in d}
    return frozenset(map(chr, second | {*range(0x1161, 0x1176), *range(0x11A8, 0x11C3)}))


@lru_cache(maxsize=100_000)
def _unstable(c: str) -> bool:
    return unicodedata.combining(c) != 0 or c in _may_join() or _normal(c) != c


def canonical(text: str) -> str:
    """``text`` in the form shared by all texts that print like it."""
    out, done, n = [], 0, len(text)
    for run in _LOOK.finditer(text):
        i, end = max(run.start(), done), run.end()
        while i < end:
            if not _unstable(text[i]):
                i += 1
                continue
            j = i
            while j < n and _unstable(text[j]):
                j += 1
            start = i - 1 if i > done else i  # the starter before: a mark may compose with it
            out += [text[done:start], _normal(text[start:j])]
            done = i = j
    out.append(text[done:])
    return "".join(out) if len(out) > 1 else text


def _canonical_all(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else canonical(t))


def canonical_text(col: Column) -> Column:
    """Column form of :func:`canonical`; only texts with a suspect character leave the JVM.

    Null stays null, the empty text stays empty, texts of any length are taken whole.
    """
    form = F.pandas_udf(_canonical_all, StringType())
    return F.coalesce(form(F.when(col.rlike(SUSPECT), col)), col)


def fingerprints(df: DataFrame, tab: str, key: Column, text: Column) -> DataFrame:
    """tab, key, raw, canon: the texts and their canonical forms as 128-bit digests. Null texts and keys are left out."""
    rows = df.select(F.lit(tab).alias("tab"), key.cast("string").alias("key"), text.alias("text")).where("key IS NOT NULL AND text IS NOT NULL")
    return rows.select("tab", "key", F.unhex(F.md5("text")).alias("raw"), F.unhex(F.md5(canonical_text(F.col("text")))).alias("canon")).distinct()


def alike_pairs(prints: DataFrame) -> DataFrame:
    """tab, key_a, key_b: keys of one table whose texts print alike but differ, smaller key first.

    ``prints`` comes from :func:`fingerprints`, best written before, as it is
    read three times. Rows are first folded to distinct spellings; only pairs
    of different spellings are joined to their rows, so the rows of one
    spelling, however many, are never paired with each other and what is
    joined is what is returned. Repeated rows give a pair once; a key never
    pairs with itself; empty input gives no rows.
    """
    spellings = prints.select("tab", "canon", "raw").distinct()
    a, b = spellings.withColumnRenamed("raw", "raw_a"), spellings.withColumnRenamed("raw", "raw_b")
    pairs = a.join(b, ["tab", "canon"]).where("raw_a < raw_b").select("tab", "raw_a", "raw_b")
    rows = prints.select("tab", "key", "raw")
    left = pairs.join(rows.toDF("tab", "ka", "raw_a"), ["tab", "raw_a"])
    # What a spelling of many rows puts out is salted: each part of its rows meets all rows of the other spelling.
    out = salted_join(rows.toDF("tab", "kb", "raw_b"), left, ["tab", "raw_b"]).where("ka <> kb")
    return out.select("tab", F.least("ka", "kb").alias("key_a"), F.greatest("ka", "kb").alias("key_b")).distinct()


def alike_classes(prints: DataFrame) -> DataFrame:
    """tab, key, class_id, spellings: the rows of texts that print like a differently spelled one, by class; a class is its canonical form's digest."""
    several = prints.groupBy("tab", "canon").agg(F.countDistinct("raw").alias("spellings")).where("spellings > 1")
    return prints.join(several, ["tab", "canon"]).select("tab", "key", F.hex("canon").alias("class_id"), "spellings").distinct()
