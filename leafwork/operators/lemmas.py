"""Remarks on verses: segments that lemma lines open, their anchors, and the verses they mean."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafwork.functions.rules import replaced

# ``v.4``, ``vv.43-45``, ``v. 19 sv.`` with the stops and marks that transcriptions add.
LEMMA = r"(?i)^vv?\.\s*(\d{1,6})(?:\s*[-–—‑]\s*(\d{1,6}))?(\s*\^?\s*svv?\.?\s*\^?)?\s*[:.]?\s*$"
_BARE = ((r"\*", ""), (r"\[([^\]]*)\]\{\.underline\}", r"\1"), (r"^#{1,6}\s*", ""), (r"(?i)^v\.\s*v\.", "vv."), (r"(?i)^v\^v\^\.", "vv."))


def lemma_segments(lines: DataFrame, part: list[str], order: str, line: str) -> DataFrame:
    """``lines`` with segment, first, last and open.

    A lemma line between blank lines or page anchors, or at an end, opens a
    segment and is not part of it; what stands before the first is segment 0. A
    heading in capitals there is left out, unless it bears a note's mark.
    """
    w = Window.partitionBy(*part).orderBy(order)
    up = w.rowsBetween(Window.unboundedPreceding, 0)
    text = F.trim(replaced(F.trim(line), _BARE))
    free = lambda c: c.isNull() | (F.trim(c) == "") | F.trim(c).rlike(r"^<!--\s*page:")
    opens = text.rlike(LEMMA) & free(F.lag(line).over(w)) & free(F.lead(line).over(w))
    number = lambda k: F.try_to_number(F.nullif(F.regexp_extract(text, LEMMA, k), F.lit("")), F.lit("999999")).cast("int")
    head = F.when(opens, F.struct(number(1).alias("first"), number(2).alias("last"), (F.regexp_extract(text, LEMMA, 3) != "").alias("open")))
    rows = lines.withColumns({"_opens": opens, "_head": head})
    rows = rows.withColumns({"segment": F.sum(F.col("_opens").cast("int")).over(up), "_head": F.last_value("_head", True).over(up)})
    heading = (F.col("segment") == 0) & (F.upper(text) == text) & text.rlike("^CHANSON|REMARQUE") & ~F.col(line).contains("[^")
    rows = rows.where(~F.col("_opens") & ~heading)
    return rows.select(*lines.columns, "segment", "_head.first", "_head.last", "_head.open")


def lemma_anchors(lemmas: DataFrame, part: list[str], order: str) -> DataFrame:
    """``lemmas`` (first, last, open) with anchor and label; the second of one anchor gets ``-2`` behind it."""
    base = F.concat_ws("-", F.concat(F.lit("rem-v"), F.col("first")), "last")
    label = F.when(F.col("last").isNotNull(), F.concat(F.lit("vv. "), F.col("first"), F.lit("–"), F.col("last"))).when(F.col("open"), F.concat(F.lit("v. "), F.col("first"), F.lit(" sv."))).otherwise(F.concat(F.lit("v. "), F.col("first")))
    rows = lemmas.withColumns({"anchor": base, "label": label})
    n = F.row_number().over(Window.partitionBy(*part, "anchor").orderBy(order))
    return rows.withColumn("_n", n).withColumn("anchor", F.when(F.col("_n") > 1, F.concat_ws("-", "anchor", "_n")).otherwise(F.col("anchor"))).drop("_n")


def lemma_quotes(lemmas: DataFrame, verses: DataFrame, part: list[str], key: str) -> DataFrame:
    """key, quote, present: the verses each lemma means, two at most, with an ellipsis if there are more or it is open.

    ``verses`` has part, verse and text. A lemma of many verses is joined by
    equality for the two that are quoted.
    """
    until = F.least(F.coalesce("last", "first"), F.col("first") + 1)
    asked = lemmas.select(*part, key, "first", "last", "open", F.explode(F.sequence(F.col("first"), F.greatest(until, F.col("first")))).alias("verse"))
    found = asked.join(verses.select(*part, "verse", "text"), [*part, "verse"], "left")
    rows = found.groupBy(*part, key, "first", "last", "open").agg(F.array_sort(F.collect_list(F.when(F.col("text").isNotNull(), F.struct("verse", "text")))).alias("v"), F.max(F.when((F.col("verse") == F.col("first")) & F.col("text").isNotNull(), 1)).alias("there"))
    more = F.when(F.coalesce("open", F.lit(False)) | (F.coalesce("last", "first") > F.col("first") + 1), "  …").otherwise("")
    return rows.select(*part, key, F.concat(F.array_join(F.transform("v", lambda x: x["text"]), "  /  "), more).alias("quote"), (F.col("there") == 1).alias("present")).na.fill({"present": False})


def verse_marks(lemmas: DataFrame, verses: DataFrame, part: list[str]) -> DataFrame:
    """``verses`` with the anchors of the remarks that begin at each, in order."""
    marks = lemmas.groupBy(*part, F.col("first").alias("verse")).agg(F.array_sort(F.collect_list("anchor")).alias("marks"))
    return verses.join(marks, [*part, "verse"], "left").withColumn("marks", F.coalesce("marks", F.array().cast("array<string>")))
