"""Queries that match citations to the cards of another library."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafwork.llm.canon import canonical
from leafwork.llm.cites import Work, parse_card, parse_definition, parse_entry, parse_name
from leafwork.llm.listing import plain
from leafwork.llm.matching import Rule, cascade_with_ties, rule_precision, same_works, title_words
from leafwork.llm.people import NAMES_SENT, formal, learned_forms, settled, surname_clusters, turned_names
from leafwork.operators.match import salted_join
from leafwork.session import cut, forget, scratch, small
from leafwork.sources.tables import table

_SCHEMA = "id long, surname string, given string, other_surname string, other_given string, title string, words array<string>, year int, pages string, place string, publisher string, clean boolean"


def _row(key: str, work: Work, title: str | None, clean: bool) -> tuple | None:
    if work.author is None or not title:
        return None
    title = canonical(title)
    words = title_words(title)
    low = [plain(x) if x else None for x in (work.place, work.publisher)]
    other = work.author.other
    return (key, work.author.surname, work.author.given, other and other.surname, other and other.given, title, words, int(work.year) if work.year else None, work.pages, *low, clean)


def _frame(rows: list) -> pd.DataFrame:
    names = [c.split()[0] for c in _SCHEMA.split(", ")]
    out = pd.DataFrame([r for r in rows if r], columns=names)
    out["year"] = out["year"].astype("Int32")
    return out


def _cited(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for x in batches:
        rows = []
        for key, definition, author, title in zip(x["id"], x["definition"], x["author"], x["title"], strict=True):
            work, name = parse_definition(definition), parse_name(author)
            if work and work.author and name and not work.author.given:
                work = Work(name, work.title, work.year, work.place, work.publisher, work.pages)
            work = work or Work(name, None, None, None, None, None)
            rows.append(_row(key, work, title or work.title, bool(title)))
        yield _frame(rows)


def _entered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for x in batches:
        yield _frame([_row(k, parse_entry(a, t, s), t, True) for k, a, t, s in zip(x["id"], x["author"], x["title"], x["text"], strict=True)])


def _carded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for x in batches:
        rows = []
        for k, h, t, i, e in zip(x["id"], x["heading"], x["title_line"], x["imprint"], x["extent"], strict=True):
            work = parse_card(h, t or "", i, e)
            rows.append(_row(k, work, work.title, False))
        yield _frame(rows)


#: Letters of a title, made of its words when they are asked for, not written beside them.
_LETTERS = "array_join(words, '')"


def _rules() -> list[Rule]:
    col = F.col
    letters, author = F.array("letters"), F.array("author")
    start = F.array(F.substring("letters", 1, 14))
    end = F.array(F.right("letters", F.lit(14)))
    begun = F.array(F.array_join(F.transform(F.slice("words", 1, 3), lambda w: F.substring(w, 1, 3)), " "))
    # One side stands for three years, so that years one apart meet and no others: the records, of which fewer are left for the weak rules.
    year = F.when(col("year").isNotNull(), F.array("year"))
    years = F.when(col("year").isNotNull(), F.array(col("year") - 1, col("year"), col("year") + 1))
    place = F.when(col("place").isNotNull(), F.array("place"))
    checks = ("pages", "place", "publisher")
    rule = lambda name, *parts, use=checks: Rule(name, parts, use, tuple(year if p is years else p for p in parts))
    return [
        rule("title author year", letters, author, years),
        rule("title author", letters, author),
        rule("title year", letters, years),
        rule("start author year", start, author, years),
        rule("end author year", end, author, years),
        rule("words author year", begun, author, years),
        rule("author year", author, years),
        rule("start author", start, author),
        rule("words author", begun, author),
        rule("end author", end, author),
        rule("start year place", start, years, place, use=("pages", "publisher")),
    ]


def _works(rows: DataFrame) -> DataFrame:
    """One row for each title and author, with what most of its rows say."""
    said = [F.mode(c, True).alias(c) for c in ("surname", "year", "pages", "place", "publisher")]
    given = F.max_by("given", F.struct(~F.coalesce("given", F.lit("")).endswith("."), F.length("given"), "given")).alias("given")
    return rows.groupBy("letters", "author").agg(F.min("title").alias("title"), F.min("words").alias("words"), given, *said).drop("letters")


def _named(works: DataFrame) -> DataFrame:
    return works.withColumn("letters", F.expr(_LETTERS)).withColumn("id", F.concat_ws("|", "letters", "author"))


def _matched(spark: SparkSession, sf_dir: str, wanted: str = "pairs") -> DataFrame:
    """rec_id, lib_id; with ``wanted`` "confidence" that too; with "ties" side and id of the rows that every rule ties."""
    with scratch() as keep:
        return _answered(spark, sf_dir, wanted, keep)


def _answered(spark: SparkSession, sf_dir: str, wanted: str, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """:func:`_matched`. What is returned reads nothing that ``keep`` wrote."""
    t = lambda n: table(spark, sf_dir, n)
    key = lambda c: F.col(c).cast("long").alias("id")
    cited = t("citations").select(key("rec_id"), "definition", F.col("bibliography.author").alias("author"), F.col("bibliography.title").alias("title"), "confidence")
    cited = cited.where("definition IS NOT NULL OR author IS NOT NULL")
    grades = cited.groupBy("id").agg(F.min("confidence").alias("grade"))
    cited = cited.select("id", "definition", "author", "title").distinct()
    entries = t("bibliography_entry").where("author IS NOT NULL AND title IS NOT NULL").select(key("entry_id"), "author", "title", "text").distinct()
    cards = t("library_records").select(key("lib_id"), "heading", "title_line", "imprint", "extent").distinct()
    parts = [("c", cited.mapInPandas(_cited, _SCHEMA)), ("e", entries.mapInPandas(_entered, _SCHEMA)), ("l", cards.mapInPandas(_carded, _SCHEMA))]
    every = parts[0][1].withColumn("side", F.lit("c"))
    for side, part in parts[1:]:
        every = every.unionByName(part.withColumn("side", F.lit(side)))
    every = keep(every)
    # What is learned of names is learned from narrow rows; the wide ones are passed once, with what was learned sent to them.
    first = keep(every.select(F.concat("side", "id").alias("rec"), "surname", "given", "other_surname", "other_given", F.expr(_LETTERS).alias("work")))
    turned = cut(turned_names(first))
    mentions = keep(settled(first, turned))
    forget(first)
    clusters = small(surname_clusters(mentions), NAMES_SENT)
    learned = cut(learned_forms(mentions.join(clusters, "surname")))
    forget(mentions)
    raw, every = every, keep(formal(settled(every, turned).join(clusters, "surname"), learned).withColumnRenamed("cluster", "author"))
    forget(raw)
    every = every.withColumn("letters", F.expr(_LETTERS))
    ours, theirs = every.where("side = 'c'"), every.where("side = 'l'")

    rules = _rules()
    to = F.unhex(F.md5("id")).alias("id")
    known = _named(keep(_works(every.where("clean"))))
    ours_found, ours_tied = cascade_with_ties(ours, known.withColumn("id", to), rules, keep=keep)
    rest = keep(ours.join(small(ours_found.select("id"), NAMES_SENT), "id", "left_anti"))
    own = _named(keep(_works(rest)))
    same = keep(same_works(own))
    new = rest.select("id", F.concat_ws("|", "letters", "author").alias("spelling")).join(same.select(F.col("id").alias("spelling"), F.col("work").alias("to")), "spelling")
    new = new.select("id", F.unhex(F.md5("to")).alias("to")).distinct().withColumns({"rule": F.lit("own title"), "step": F.lit(0)})
    own = keep(own.join(same, "id").withColumn("id", F.col("work")).drop("work"))
    ours_found = ours_found.unionByName(new)
    theirs_found, theirs_tied = cascade_with_ties(theirs, known.unionByName(own).withColumn("id", to), rules, keep=keep)
    if wanted == "ties":
        return cut(ours_tied.withColumn("side", F.lit("record")).unionByName(theirs_tied.withColumn("side", F.lit("card"))))
    ids = [F.col("rec").alias("rec_id"), F.col("lib").alias("lib_id")]
    if wanted == "pairs":
        a, b = cut(ours_found.select(F.col("id").alias("rec"), "to")), cut(theirs_found.select(F.col("id").alias("lib"), "to"))
        return salted_join(a, b, ["to"]).select(*ids).distinct()
    said = [F.mode(c, True).alias(c) for c in ("pages", "place", "publisher")]
    works = known.select("id", "pages", "place", "publisher").unionByName(own.groupBy("id").agg(*said)).withColumn("id", to)
    graded = ours.join(grades, "id", "left")
    plus = [*rules, Rule("own title", (), ("pages", "place", "publisher"))]
    ours_right = rule_precision(ours_found, graded, works, plus, "grade")
    theirs_right = rule_precision(theirs_found, theirs.withColumn("grade", F.lit("")), works, rules, "grade")
    a = ours_found.join(grades.select("id", F.coalesce("grade", F.lit("")).alias("grade")), "id").join(ours_right, ["rule", "grade"]).select(F.col("id").alias("rec"), "to", F.col("precision").alias("p"))
    b = theirs_found.join(theirs_right.drop("grade"), "rule").select(F.col("id").alias("lib"), "to", F.col("precision").alias("q"))
    pairs = salted_join(keep(a), b, ["to"]).groupBy(*ids)
    return cut(pairs.agg(F.round(F.max(F.col("p") * F.col("q")), 4).alias("confidence")))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matched(spark, sf_dir).select("rec_id", "lib_id")


def p5_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matched(spark, sf_dir, "confidence")


def p5_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records and cards for which every rule that finds anything finds several: by side, how many. Records among them get a work of their own."""
    return _matched(spark, sf_dir, "ties").groupBy("side").agg(F.count(F.lit(1)).alias("tied"))


QUERIES = {"p5_found": p5_found, "p5_confidence": p5_confidence, "p5_ties": p5_ties}
SQL: dict[str, str] = {}
