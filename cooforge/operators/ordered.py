"""Sorts, prefix sums, ranks, queues, sets of neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.numbering import neighbour, running_sum


def sort_within_columns(a: DataFrame) -> DataFrame:
    """Column after column, rows ascending: a range partitioning by column and a sort inside partitions."""
    return a.repartitionByRange("j", "i").sortWithinPartitions("j", "i")


def sorted_by(df: DataFrame, *keys: str) -> DataFrame:
    """Ascending, or descending for keys with a leading minus."""
    return df.orderBy(*[F.desc(k[1:]) if k.startswith("-") else F.asc(k) for k in keys])


def column_pointers(a: DataFrame, n: int, base: int = 1) -> DataFrame:
    """(j, ptr) for j = 1..n+1: where each column starts. Sums run over chunks of the n column counts."""
    ids = a.sparkSession.range(1, n + 2).select(F.col("id").alias("j"))
    counts = ids.join(a.groupBy("j").agg(F.count("*").alias("c")), "j", "left")
    return running_sum(counts, F.coalesce("c", F.lit(0)), "before", "j").select("j", (F.col("before") + base).alias("ptr"))


def least(df: DataFrame, *keys: str, k: int = 1) -> DataFrame:
    """The k first rows in the order of keys, as a queue would give them."""
    return df.orderBy(*keys).limit(k)


def adjacency(graph: DataFrame) -> DataFrame:
    """(i, neighbours) with neighbours sorted."""
    return graph.groupBy("i").agg(F.array_sort(F.collect_set("j")).alias("neighbours"))


def merged_sets(a: DataFrame, b: DataFrame) -> DataFrame:
    """(i, neighbours) of either, united and sorted."""
    other = b.select("i", F.col("neighbours").alias("_b"))
    empty = F.array().cast("array<bigint>")
    return a.join(other, "i", "full_outer").select("i", F.array_sort(F.array_union(F.coalesce("neighbours", empty), F.coalesce("_b", empty))).alias("neighbours"))


def equal_sets(a: DataFrame) -> DataFrame:
    """(first, members): indices with the same closed neighbourhood, as the vertices of a compressed graph.

    Grouped by a checksum-sized key, the sorted neighbourhood itself.
    """
    closed = F.array_sort(F.array_union("neighbours", F.array("i")))
    return a.groupBy(closed.alias("key")).agg(F.min("i").alias("first"), F.count("*").alias("members")).select("first", "members")


def union_cost(pairs: DataFrame) -> DataFrame:
    """Fill of merging the columns of (a, b, rows_a, rows_b): how many rows each lacks of the other's."""
    return pairs.withColumn("fill", F.size(F.array_except("rows_a", "rows_b")) + F.size(F.array_except("rows_b", "rows_a")))


def interval_sweep(intervals: DataFrame) -> DataFrame:
    """(start, stop) of the pieces into which the ends of closed intervals cut the line."""
    ends = intervals.select(F.explode(F.array("first", F.col("last") + 1)).alias("start")).distinct()
    return neighbour(ends, "start", "next", "start", 1).select("start", (F.col("next") - 1).alias("stop")).where("stop IS NOT NULL")


def split_ranges(ranges: DataFrame, block: int) -> DataFrame:
    """(cblk, part, first, last): ranges cut into parts of at most ``block`` columns."""
    starts = F.posexplode(F.sequence("first", "last", F.lit(block).cast("long")))
    return ranges.select("cblk", F.col("last").alias("_last"), starts.alias("part", "first")).select("cblk", "part", "first", F.least(F.col("first") + block - 1, F.col("_last")).alias("last"))
