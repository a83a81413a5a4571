"""Pieces that the operators share: tables, checkpoints, hashing, labelled samples."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from cooforge.plans.lineage import checkpoint, shared_folder  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows that a Python worker gets at once. Texts can be long, and a worker holds a batch several times over.
BATCH_ROWS = 512


#: Integers keep their nulls and all their digits in pandas.
NULLABLE = {pa.int64(): pd.Int64Dtype(), pa.int32(): pd.Int32Dtype(), pa.int16(): pd.Int16Dtype(), pa.int8(): pd.Int8Dtype()}


def map_texts(df: DataFrame, run, schema: str) -> DataFrame:
    """``run`` over batches of BATCH_ROWS rows as pandas frames, so that workers stay small whatever the texts.

    Batches travel as Arrow, so integer columns with nulls come back as they were.
    The batch size is a setting of the session, read when the plan runs.
    """
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def mapped(batches):
        for out in run(batch.to_pandas(types_mapper=NULLABLE.get) for batch in batches):
            yield pa.RecordBatch.from_pandas(out, schema=arrow, preserve_index=False)

    return df.mapInArrow(mapped, schema)


def schema_of(df: DataFrame, *more: str) -> str:
    return ", ".join([*(f"`{c}` {t}" for c, t in df.dtypes), *more])


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or with underscores in front where a column has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


class WordHash(dict):
    """64-bit hash of each word (bytes or str); remembers at most ``most`` words."""

    def __init__(self, most: int = 150_000, seed: int = 0):
        super().__init__()
        self.most, self.seed = most, seed

    def __missing__(self, word):
        if len(self) >= self.most:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word, self.seed)
        return value

    def of(self, words: list) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """Bijective 64-bit finaliser; wraps around on purpose."""
    with np.errstate(over="ignore"):
        x = x + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % 2**64)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> np.uint64(33))


def release() -> None:
    """Give memory that a fit has freed back to the system; a driver stays small between jobs."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # not glibc


def lower_ascii(column):
    """A-Z to a-z and nothing else."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def crc_of_id(column):
    return F.crc32(column.cast("string").cast("binary"))


def least_hashed(rows: DataFrame, key: str, most: int) -> DataFrame:
    """At most ``most`` rows, those whose key hashes lowest.

    A threshold taken from a count lets through only slightly more than that, so
    that no task sorts more however many partitions there are.
    """
    total, scale = rows.count(), 1 << 40
    share = min(1.0, (most + 6 * most**0.5 + 50) / max(total, 1))
    place = F.pmod(F.xxhash64(key), F.lit(scale))
    return rows.where(place < int(share * scale)).orderBy(place, key).limit(most)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, learn, max_rows: int, max_chars: int):
    """A bounded sample of labelled documents on the driver: texts, 0/1 labels, languages.

    ``learn`` is the condition on ``doc_id`` under which a label may be seen.
    At most ``max_rows`` label rows in the order of a hash of doc_id are drawn,
    so the broadcast side is bounded; texts longer than ``max_chars`` are left
    out of the fit (never shortened), which bounds the bytes sent to the driver.
    A doc_id with several labels counts as 1 if any is 1; null labels are skipped.
    """
    picked = (
        labels.select(F.col("doc_id").alias("_id"), F.col(label).cast("int").alias("_y"))
        .where(F.col("_y").isNotNull() & F.col("_id").isNotNull() & learn(F.col("_id")))
        .groupBy("_id").agg(F.max("_y").alias("_y"))
    )
    picked = least_hashed(picked, "_id", max_rows)
    rows = (
        docs.select(F.col("doc_id").alias("_id"), F.col("text").alias("_text"), F.col("lang").alias("_lang"))
        .where(F.col("_text").isNotNull() & (F.length("_text") <= max_chars))
        .join(F.broadcast(picked), "_id")
        .select("_id", "_text", "_lang", "_y").toPandas().sort_values(["_id", "_text"])
    )
    return rows["_text"].tolist(), rows["_y"].to_numpy(np.int64), rows["_lang"].tolist()


def numbered(df: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """Gapless numbers from 0 within each key, in the given order, without one task per key.

    Rows are range-partitioned by key and order (``order`` must tell rows apart
    for a lasting result) and numbered inside their partition; a table of at
    most one row per partition and key carries the offsets, and only that is
    broadcast. A key that holds most rows is spread like any other.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = checkpoint(
        df.repartitionByRange(n, *keys, *order).sortWithinPartitions(*keys, *order)
        .withColumn("_at", F.monotonically_increasing_id())
        .withColumn("_part", F.shiftright("_at", 33))
    )
    each = placed.groupBy("_part", *keys).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    running = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = each.withColumn("_before", F.coalesce(F.sum("_n").over(running), F.lit(0))).drop("_n")
    offsets = offsets.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_part").alias("_p"), "_first", "_before")
    same = F.col("_part") == F.col("_p")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return (
        placed.join(F.broadcast(offsets), same)
        .withColumn(name, F.col("_at") - F.col("_first") + F.col("_before"))
        .drop("_at", "_part", "_p", "_first", "_before", *[f"_k{i}" for i in range(len(keys))])
    )
