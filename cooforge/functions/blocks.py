"""Several degrees of freedom per node: dense blocks in column-major order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.numbering import running_sum


def explode_blocks(blocks: DataFrame, dof: int, keep: tuple[str, ...] = ()) -> DataFrame:
    """(i, j, values array of dof * dof) to scalar entries, nodes and entries from 1."""
    flat = blocks.select("i", "j", *keep, F.posexplode("values").alias("k", "v"))
    row, col = F.col("k") % dof, F.floor(F.col("k") / dof)
    return flat.select(((F.col("i") - 1) * dof + row + 1).alias("i"), ((F.col("j") - 1) * dof + col + 1).alias("j"), "v", *keep)


def collect_blocks(entries: DataFrame, dof: int) -> DataFrame:
    """Scalar entries to node blocks; missing values are 0. A block has dof * dof values, so groups are bounded."""
    node = lambda c: F.floor((F.col(c) - 1) / dof) + 1
    place = ((F.col("i") - 1) % dof + ((F.col("j") - 1) % dof) * dof).cast("int")
    placed = entries.select(node("i").alias("i"), node("j").alias("j"), place.alias("k"), "v")
    values = F.array(*[F.coalesce(F.sum(F.when(F.col("k") == k, F.col("v"))), F.lit(0.0)) for k in range(dof * dof)])
    return placed.groupBy("i", "j").agg(values.alias("values"))


def node_unknowns(nodes: DataFrame, dof: int) -> DataFrame:
    """The unknowns of a list of nodes."""
    return nodes.select(F.explode(F.sequence((F.col("node") - 1) * dof + 1, F.col("node") * dof)).alias("i"))


def offsets(dofs: DataFrame) -> DataFrame:
    """(node, dof) with the first unknown of each node, for a varying dof."""
    return running_sum(dofs, F.col("dof"), "first", "node").withColumn("first", F.col("first") + 1)
