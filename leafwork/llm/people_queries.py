"""Queries on authors of cited works."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafwork.llm.cites import Name, parse_definition, parse_entry, parse_name
from leafwork.llm.listing import words
from leafwork.llm.people import people, same_person_pairs, settled
from leafwork.session import cut
from leafwork.sources.tables import table

_MENTIONS = "rec string, surname string, given string, other_surname string, other_given string, work string"
_NAMES = [c.split()[0] for c in _MENTIONS.split(", ")]


def work_key(title: str | None) -> str | None:
    return "".join(words(title)) or None if title else None


def _row(rec: str, name: Name, work: str | None) -> tuple:
    other = name.other
    return (rec, name.surname, name.given, other and other.surname, other and other.given, work)


def _of_records(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for x in batches:
        out = []
        for rec, definition, author, title in zip(x["rec"], x["definition"], x["author"], x["title"], strict=True):
            work, named = parse_definition(definition), parse_name(author)
            key = work_key(title) or (work_key(work.title) if work else None)
            for n in {work.author if work else None, named} - {None}:
                out.append(_row(rec, n, key))
        yield pd.DataFrame(out, columns=_NAMES)


def _of_entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for x in batches:
        out = []
        for rec, author, title, text in zip(x["rec"], x["author"], x["title"], x["text"], strict=True):
            for n in {parse_entry(author, title, text).author, parse_name(author)} - {None}:
                out.append(_row(rec, n, work_key(title)))
        yield pd.DataFrame(out, columns=_NAMES)


def author_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every way a record or a bibliography entry names the author of its work."""
    nothing = F.lit(None).cast("string")
    cited = table(spark, sf_dir, "citations").select(F.col("rec_id").cast("string").alias("rec"), "definition", F.col("bibliography.author").alias("author"), F.col("bibliography.title").alias("title"))
    curated = table(spark, sf_dir, "sigla_overrides").select(F.col("rec_id").cast("string").alias("rec"), "definition", nothing.alias("author"), nothing.alias("title"))
    records = cited.unionByName(curated).where("definition IS NOT NULL OR author IS NOT NULL").distinct().mapInPandas(_of_records, _MENTIONS)
    entries = table(spark, sf_dir, "bibliography_entry").where("author IS NOT NULL").select(F.concat(F.lit("e"), F.col("entry_id")).alias("rec"), "author", "title", "text")
    return settled(cut(records.unionByName(entries.distinct().mapInPandas(_of_entries, _MENTIONS))))


def _persons(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = people(cut(author_mentions(spark, sf_dir)))
    return cut(found.where("NOT rec LIKE 'e%'").select(F.col("rec").cast("long").alias("rec"), "person"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return same_person_pairs(_persons(spark, sf_dir))


def p4_persons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each record's person and the number of records of that person."""
    persons = _persons(spark, sf_dir)
    return persons.join(persons.groupBy("person").agg(F.count(F.lit(1)).alias("records")), "person").select(F.col("rec").alias("rec_id"), "person", "records")


QUERIES = {"p4_found": p4_found, "p4_persons": p4_persons}
SQL: dict[str, str] = {}
