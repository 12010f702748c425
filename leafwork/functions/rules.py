"""Rewriting and classing by ordered rules, as Columns and as the same SQL.

A rule is a pattern and what is put for it, ``\\1`` for its groups. Patterns use
no lookaround and no word boundaries, so that Java's and RE2's engines agree.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

Rules = tuple[tuple[str, str], ...]


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def replaced(text: Column, rules: Rules) -> Column:
    for pattern, put in rules:
        text = F.regexp_replace(text, pattern, re.sub(r"\\(\d)", r"$\1", put.replace("$", r"\$")))
    return text


def sql_replaced(text: str, rules: Rules) -> str:
    for pattern, put in rules:
        text = f"regexp_replace({text}, {quoted(pattern)}, {quoted(put)}, 'g')"
    return text


def first_of(text: Column, cases: Rules, default: str | Column) -> Column:
    """The name of the first (name, pattern) that is found in the text."""
    out = None
    for name, pattern in cases:
        out = F.when(text.rlike(pattern), name) if out is None else out.when(text.rlike(pattern), name)
    return out.otherwise(default)


def sql_first_of(text: str, cases: Rules, default: str) -> str:
    whens = " ".join(f"WHEN regexp_matches({text}, {quoted(pattern)}) THEN {quoted(name)}" for name, pattern in cases)
    return f"CASE {whens} ELSE {default} END"


def spots(text: Column, pattern: str) -> Column:
    """at (from 0) and found of every match, in order. The pattern has no capturing groups."""
    found, pieces = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern)
    before = lambda i: F.length(F.array_join(F.slice(pieces, F.lit(1), i + 1), "")) + F.length(F.array_join(F.slice(found, F.lit(1), i), ""))
    return F.transform(found, lambda m, i: F.struct(before(i).alias("at"), m.alias("found")))


def sql_spots(text: str, pattern: str) -> str:
    found, pieces = f"regexp_extract_all({text}, {quoted(pattern)})", f"string_split_regex({text}, {quoted(pattern)})"
    return f"list_transform(range(1, len({found}) + 1), lambda i: {{'at': length(array_to_string(({pieces})[1:i], '')) + length(array_to_string(({found})[1:i-1], '')), 'found': ({found})[i]}})"
