"""Notes, references back to earlier notes, linkage of abbreviations, flags."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafwork.functions.text import deaccent, fold_key
from leafwork.operators.match import best, shared_letters
from leafwork.operators.ordered import carry_forward


def lines(df: DataFrame, keep: list[str], text: str) -> DataFrame:
    """keep, no, line: the lines of a text, numbered from 1; carriage returns dropped."""
    return df.select(*keep, F.posexplode(F.split(F.regexp_replace(text, "\r\n?", "\n"), "\n")).alias("no", "line")).withColumn("no", F.col("no") + 1)


def note_marks(numbered: DataFrame, keep: list[str]) -> DataFrame:
    """keep, label, is_definition, no, at: every note mark of every line; a mark that begins a line with a colon defines."""
    marks = F.regexp_extract_all("line", F.lit(r"(\[\^[^\]]+\]:?)"), F.lit(1))
    rows = numbered.select(*keep, "no", "line", F.posexplode(marks).alias("at", "mark"))
    defines = (F.col("at") == 0) & F.col("line").rlike(r"^\[\^[^\]]+\]:")
    return rows.select(*keep, F.regexp_extract("mark", r"\[\^([^\]]+)\]", 1).alias("label"), defines.alias("is_definition"), "no", "at")


def residual(marks: DataFrame, page: list[str]) -> DataFrame:
    """page, label, fault: references without definition, repeats kept, and definitions without reference."""
    refs, defs = marks.where(~F.col("is_definition")).select(*page, "label"), marks.where("is_definition").select(*page, "label")
    on = [*page, "label"]
    return refs.join(defs.distinct(), on, "left_anti").withColumn("fault", F.lit("dangling")).unionByName(defs.join(refs.distinct(), on, "left_anti").withColumn("fault", F.lit("orphan")))


def link_to_entries(definitions: DataFrame, entries: DataFrame) -> DataFrame:
    """key, entry_id, way: the bibliography entry a definition means.

    ``definitions`` has key, siglum, surname, text; ``entries`` entry_id,
    siglum, surname, title. An entry with the siglum as its tag comes first;
    else, of those with the surname, the one that shares most letters with the
    text, the lowest id on a tie.
    """
    by_tag = definitions.join(entries.where("siglum IS NOT NULL").groupBy("siglum").agg(F.min("entry_id").alias("entry_id")), "siglum")
    tagged = by_tag.select("key", "entry_id", F.lit("siglum").alias("way"))
    left = definitions.where("surname <> ''").join(tagged.select("key"), "key", "left_anti")
    pairs = left.join(entries.select("entry_id", "surname", "title"), "surname")
    named = best(pairs, ["key"], [shared_letters(F.lower("text"), F.lower("title"))], [F.col("entry_id")], ["entry_id"])
    return tagged.unionByName(named.select("key", "entry_id", F.lit("surname").alias("way")))


def back_references(events: DataFrame, doc: str) -> DataFrame:
    """Every reference back with the earlier citation it means.

    ``events`` has doc, seq (an order within it), kind (``full``, ``named`` or
    ``bare``), author and title. A named event means the author's last full
    citation before it; a bare one the last citation of anybody. Confidence is
    high for the only work of an author so far, medium for one of several, low
    for a bare event; what has no antecedent is unresolved.
    """
    rows = events.withColumn("key", fold_key(F.coalesce("author", F.lit(""))))
    full = F.when(F.col("kind") == "full", F.struct("seq", "author", "title"))
    rows = carry_forward(rows, [doc, "key"], ["seq"], full, "by_author", exclusive=True)
    rows = carry_forward(rows, [doc], ["seq"], full, "any_author", exclusive=True)
    seen = Window.partitionBy(doc, "key").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("works", F.size(F.collect_set(F.when(F.col("kind") == "full", F.col("title"))).over(seen)))
    target = F.when(F.col("kind") == "named", F.col("by_author")).otherwise(F.col("any_author"))
    confidence = F.when(target.isNull(), "unresolved").when(F.col("kind") == "bare", "low").when(F.col("works") > 1, "medium").otherwise("high")
    return rows.where("kind <> 'full'").select(doc, "seq", "kind", "author", target["seq"].alias("target_seq"), target["title"].alias("target_title"), confidence.alias("confidence"))


_FOLDED = "doc string, seq long, kind string, author string, target_seq long, target_title string, confidence string"


def back_references_exact(events: DataFrame) -> DataFrame:
    """As :func:`back_references`, with ``id`` events, whose author is that of the last citation resolved, and ``id full`` ones, which cite another work of that author.

    The author of an ``id.`` event depends on how the events before were
    resolved, so each document's events, which are few, are folded in order.
    """
    return events.select("doc", "seq", "kind", "author", "title").groupBy("doc").applyInPandas(_fold, _FOLDED)


def _fold(group: pd.DataFrame) -> pd.DataFrame:
    last_full, by_author, works, rows = None, {}, {}, []
    for doc, seq, kind, author, title in group.sort_values("seq")[["doc", "seq", "kind", "author", "title"]].itertuples(index=False):
        if kind in ("id", "id full"):
            author = last_full[1] if last_full else None
        key = (author or "").lower()
        if kind in ("full", "id full"):
            last_full = by_author[key] = (seq, author, title)
            works.setdefault(key, set()).add(title)
            continue
        target = last_full if kind == "bare" else by_author.get(key)
        sure = "unresolved" if target is None else "low" if kind == "bare" else "medium" if len(works.get(key, ())) > 1 else "high"
        if target and kind != "bare":
            last_full = target
        rows.append((doc, seq, kind, author, target and target[0], target and target[2], sure))
    return pd.DataFrame(rows, columns=[c.split()[0] for c in _FOLDED.split(", ")]).astype({"target_seq": "Int64"})


def flags(*parts: DataFrame) -> DataFrame:
    """stage, category, key, detail of several reports in one."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def ascii_key(text: Column) -> Column:
    return F.upper(F.regexp_replace(F.replace(deaccent(text), F.lit("0"), F.lit("O")), "[^A-Za-z]", ""))
