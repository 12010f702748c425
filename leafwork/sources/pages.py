"""Readers of page directories and side files, with explicit schemas."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.utils import AnalysisException


def page_files(spark: SparkSession, folder: str, only: list[str] | None = None, vol: int | None = None) -> DataFrame:
    """pageid, vol, idx, file, modified, anchor, body: one row for each ``v<vol>p<idx>.md`` below ``folder``, the anchor line apart."""
    raw = spark.read.text(folder, wholetext=True, pathGlobFilter="v*p*.md", recursiveFileLookup=True).select("value", F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_modification_time").alias("modified"))
    part = lambda k: F.regexp_extract("file", r"^v(\d+)p(\d+)\.md$", k)
    text = F.regexp_replace("value", "\r\n?", "\n")
    rows = raw.where(F.col("file").rlike(r"^v\d+p\d+\.md$")).select(F.regexp_replace("file", r"\.md$", "").alias("pageid"), part(1).cast("int").alias("vol"), part(2).cast("int").alias("idx"), "file", "modified", text.alias("text"))
    body = F.array_join(F.filter(F.split("text", "\n"), lambda x: ~x.startswith("<!-- page:")), "\n")
    rows = rows.select("pageid", "vol", "idx", "file", "modified", F.regexp_extract("text", r"(?m)^(<!-- page:.*-->)$", 1).alias("anchor"), body.alias("body"))
    rows = rows.where(F.col("pageid").isin(only)) if only is not None else rows
    return rows.where(F.col("vol") == vol) if vol is not None else rows


def expected_pages(spark: SparkSession, leaves: dict[int, int]) -> DataFrame:
    """pageid, vol, idx for so many leaves of each volume."""
    rows = spark.createDataFrame(list(leaves.items()), "vol int, n int").where("n > 0")
    return rows.select("vol", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("idx")).select(F.format_string("v%dp%03d", "vol", "idx").alias("pageid"), "vol", "idx")


def not_done(wanted: DataFrame, done: DataFrame, key: str = "pageid") -> DataFrame:
    """Rows still to do: a run can be taken up again."""
    return wanted.join(done.select(key), key, "left_anti")


def csv_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=schema)


def json_document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A file that is one array or object."""
    return spark.read.json(path, schema=schema, multiLine=True)


def word_set(spark: SparkSession, path: str) -> DataFrame:
    """word: the different words of a file of words between white space."""
    return spark.read.text(path).select(F.explode(F.split("value", r"\s+")).alias("word")).where("word <> ''").distinct()


def optional(spark: SparkSession, read, schema: str) -> DataFrame:
    """What ``read()`` gives, or an empty table of the schema where its file is absent."""
    try:
        return read()
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], StructType.fromDDL(schema))


def image_names(spark: SparkSession, folder: str) -> DataFrame:
    """path, roman, siglum, folio, source out of names like ``XII_C_45r_bnf.jpg``; contents are not read."""
    rows = spark.read.format("binaryFile").load(folder).select("path", F.regexp_extract("path", r"([^/]+)\.\w+$", 1).alias("name"))
    part = lambda k: F.nullif(F.regexp_extract("name", r"^([IVXLC]+)_([^_]+)_([^_]+)(?:_(.+))?$", k), F.lit(""))
    return rows.select("path", *[part(k).alias(n) for k, n in enumerate(("roman", "siglum", "folio", "source"), 1)])


def isolated(df: DataFrame, key: str, value: str, work: Callable[[str], str]) -> DataFrame:
    """key, value, error: ``work`` done for each row on its own: a row that fails has its error in place of a value, and the others go on."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            rows = []
            for k, v in zip(x[key], x[value], strict=True):
                try:
                    rows.append((k, work(v), None))
                except Exception as e:  # whatever it is, it is this row's
                    rows.append((k, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["key", "value", "error"])

    return df.select(key, value).mapInPandas(run, f"key {dict(df.dtypes)[key]}, value string, error string")
