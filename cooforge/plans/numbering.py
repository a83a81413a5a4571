"""Numbers and running sums in the order of a whole-number key, without a task that sees all rows.

Rows are cut into chunks of CHUNK consecutive keys. Sums of chunks, one row each, give what lies before a chunk;
a window over each chunk gives the rest. Keys such as indices, columns and elements are dense, so a chunk has about
CHUNK rows and 10^9 keys make 15,000 chunks. Keys are not null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK = 1 << 16


def chunk_of(key: str) -> Column:
    return F.floor(F.col(key) / CHUNK)


def running_sum(df: DataFrame, value: Column, name: str, key: str, first: tuple[str, ...] = (), within: tuple[str, ...] = (), then: tuple[str, ...] = ()) -> DataFrame:
    """``name``: the sum of ``value`` over the rows before, in the order of ``first`` and ``key``, anew for each ``within``.

    ``first`` are columns of few values, ``then`` tell rows of one key apart.
    """
    marked = df.withColumn("_chunk", chunk_of(key)).withColumn("_value", value)
    by = [*within, *first, "_chunk"]
    sums = marked.groupBy(*by).agg(F.sum("_value").alias("_sum"))
    chunks = Window.partitionBy(*within).orderBy(*first, "_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*by, F.coalesce(F.sum("_sum").over(chunks), F.lit(0)).alias("_before"))
    rows = Window.partitionBy(*by).orderBy(key, *then).rowsBetween(Window.unboundedPreceding, -1)
    inside = marked.withColumn("_inside", F.coalesce(F.sum("_value").over(rows), F.lit(0)))
    return inside.join(offsets, by).withColumn(name, F.col("_before") + F.col("_inside")).select(*[c for c in df.columns if c != name], name)


def row_numbers(df: DataFrame, name: str, key: str, first: tuple[str, ...] = (), within: tuple[str, ...] = (), then: tuple[str, ...] = ()) -> DataFrame:
    """``name``: 1, 2, ... in the order of ``first`` and ``key``, anew for each ``within``."""
    return running_sum(df, F.lit(1), name, key, first, within, then).withColumn(name, (F.col(name) + 1).cast("long"))


def neighbour(df: DataFrame, value: str, name: str, key: str, step: int) -> DataFrame:
    """``name``: ``value`` of the row before (step -1) or after (step 1) in the order of ``key``, or null."""
    marked = df.withColumn("_chunk", chunk_of(key))
    near = F.max_by(value, key) if step < 0 else F.min_by(value, key)
    chunks = Window.partitionBy().orderBy("_chunk")
    edges = marked.groupBy("_chunk").agg(near.alias("_edge")).select("_chunk", F.lag("_edge", -step).over(chunks).alias("_other"))
    rows = Window.partitionBy("_chunk").orderBy(key)
    place = F.row_number().over(rows if step < 0 else Window.partitionBy("_chunk").orderBy(F.desc(key)))
    inside = marked.withColumn("_own", F.lag(value, -step).over(rows)).withColumn("_end", place)
    return inside.join(edges, "_chunk").withColumn(name, F.when(F.col("_end") == 1, F.col("_other")).otherwise(F.col("_own"))).select(*[c for c in df.columns if c != name], name)
