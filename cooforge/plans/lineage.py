"""Cutting the lineage in loops over DataFrames."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which all executors share.

    A temporary folder stands in where none is set on one machine; a cluster without one is refused.
    """
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="ckpt-"))
    return sc._jsc.sc().getCheckpointDir().get()


def checkpoint(df: DataFrame) -> DataFrame:
    """The rows written as Parquet in the shared folder and read again.

    Unlike a checkpointed RDD the table has true sizes: estimates do not multiply
    from one step of a loop to the next, and small sides are broadcast.
    """
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, column: str) -> dict[int, DataFrame]:
    """The rows written down by the values of a whole-number column: for each value a table of its own, without it."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.partitionBy(column).parquet(path)
    read, rest = df.sparkSession.read, df.drop(column).schema
    values = {int(part.removeprefix(f"{column}=")) for name in read.schema(rest).parquet(path).inputFiles() for part in name.split("/") if part.startswith(f"{column}=")}
    return {v: df.sparkSession.read.schema(rest).parquet(f"{path}/{column}={v}") for v in sorted(values)}


def clear_checkpoints(spark: SparkSession) -> None:
    """Delete every table of this session; DataFrames over them cannot be read afterwards."""
    sc = spark.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(shared_folder(spark))
    files = path.getFileSystem(sc._jsc.hadoopConfiguration())
    for status in files.listStatus(path):
        if status.getPath().getName().startswith(("table-", "scratch-", "pipeline-")):
            files.delete(status.getPath(), True)
