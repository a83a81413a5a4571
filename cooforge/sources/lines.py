"""Text lines with their numbers, read in parallel."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def numbered_lines(spark: SparkSession, path) -> DataFrame:
    """(file, n, value): lines counted from 0 in each file.

    Lines are numbered inside each block of a file; a table of one row per block
    carries the counts before it.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_id"))
    blocks = lines.groupBy("file", "_block").agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
    starts = blocks.select("file", "_block", "_first", F.coalesce(before, F.lit(0)).alias("_before"))
    return lines.join(F.broadcast(starts), ["file", "_block"]).select("file", (F.col("_id") - F.col("_first") + F.col("_before")).alias("n"), "value")


def words(lines: DataFrame) -> DataFrame:
    """(file, n, words): white-space separated parts of lines that have any."""
    return lines.where(F.trim("value") != "").select("file", "n", F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " ").alias("words"))
