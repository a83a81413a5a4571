"""A matrix that keeps growing while pieces of it arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

SCHEMA = "i long, j long, v double, seq long"


def read_pieces(spark: SparkSession, folder: str, files_per_trigger: int | None = None) -> DataFrame:
    """Parquet files of (i, j, v, seq) as they come."""
    reader = spark.readStream.schema(SCHEMA)
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).parquet(folder)


def assemble(pieces: DataFrame, rule: str = "ADD") -> DataFrame:
    """Combined entries as a streaming aggregate; its state is one row for each position."""
    from ..functions.combine import combine_all

    return pieces.groupBy("i", "j").agg(combine_all(rule).alias("v"))


def windowed_norms(pieces: DataFrame, time: str, width: str, late: str) -> DataFrame:
    """The sum of magnitudes by column and tumbling window; rows later than ``late`` are left out."""
    return pieces.withWatermark(time, late).groupBy(F.window(time, width).alias("window"), "j").agg(F.sum(F.abs("v")).alias("norm"))


def write_matrix(assembled: DataFrame, checkpoint: str, path: str) -> StreamingQuery:
    """Each trigger replaces the stored matrix by its newest state, then ends when input is used up."""
    def store(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    return assembled.writeStream.outputMode("complete").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(store).start()
