"""A sparse matrix: its entries, its dimensions and its symmetry.

``entries`` is (i LONG, j LONG, v DOUBLE), from 1. Rows and columns without
entries exist too, so the dimensions are kept apart. A symmetric matrix stores
its lower triangle and is mirrored only where a product needs it.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SYMMETRIES = ("general", "symmetric", "hermitian")


@dataclass(frozen=True)
class SparseMatrix:
    entries: DataFrame
    rows: int
    cols: int
    symmetry: str = "general"
    dof: int = 1

    @property
    def spark(self) -> SparkSession:
        return self.entries.sparkSession

    def with_entries(self, entries: DataFrame, **changes) -> SparseMatrix:
        return replace(self, entries=entries, **changes)

    def row_ids(self) -> DataFrame:
        return self.spark.range(1, self.rows + 1).select(F.col("id").alias("i"))

    def col_ids(self) -> DataFrame:
        return self.spark.range(1, self.cols + 1).select(F.col("id").alias("j"))

    def full(self) -> SparseMatrix:
        """Both triangles, stored out."""
        from ..operators.structure import expand_symmetric

        return self if self.symmetry == "general" else self.with_entries(expand_symmetric(self.entries, conjugate=self.symmetry == "hermitian"), symmetry="general")


def from_table(df: DataFrame, row: str, col: str, value: str, base: int = 0) -> DataFrame:
    """Entries out of any table; keys that count from ``base`` are moved to count from 1. Duplicates stay."""
    shift = 1 - base
    return df.select((F.col(row).cast("long") + shift).alias("i"), (F.col(col).cast("long") + shift).alias("j"), F.col(value).cast("double").alias("v"))
