"""Extension: pages that arrive as a stream of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_PAGES = "file_name string, pageid string, provenance string, anchor string, body string, transcribed_at timestamp_ntz"


def page_stream(spark: SparkSession, folder: str, files_at_once: int = 16) -> DataFrame:
    """Pages of Parquet files as they come into ``folder``; event time is transcribed_at."""
    rows = spark.readStream.schema(_PAGES).option("maxFilesPerTrigger", files_at_once).parquet(folder)
    return rows.withColumn("at", F.col("transcribed_at").cast("timestamp"))


def words_per_day(pages: DataFrame, late: str = "7 days") -> DataFrame:
    """day, pages, words; days closed once the watermark has passed, later pages are not counted."""
    words = F.size(F.regexp_extract_all("body", F.lit(r"(\p{L}+)"), F.lit(1)))
    return pages.withWatermark("at", late).groupBy(F.window("at", "1 day").alias("day")).agg(F.count(F.lit(1)).alias("pages"), F.sum(words).alias("words")).select(F.col("day.start").alias("day"), "pages", "words")


def drain(df: DataFrame, out: str, checkpoint: str) -> None:
    """Write all that is there now and stop; a later call goes on from the checkpoint."""
    df.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
