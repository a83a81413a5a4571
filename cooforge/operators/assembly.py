"""Incremental assembly: pieces of a matrix or right-hand side are added, then combined once.

A session collects DataFrames of (i, j, v) pieces; nothing runs until
``matrix()``. ``seq`` numbers the pieces (and rows of a piece that carry a
``seq`` of their own) so that KEEP and OVW mean the same at every partitioning.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.blocks import explode_blocks, node_unknowns
from ..functions.combine import combine_all, combine_two
from .norms import side_norm
from .products import multiply_vector
from .structure import drop_columns, drop_nodes, drop_rows, expand_pointers, union_all, unscale_columns, unscale_rows


class Assembly:
    def __init__(self, spark: SparkSession, n: int, rule: str = "ADD", dof: int = 1, symmetric: bool = False):
        self.spark, self.n, self.rule, self.dof, self.symmetric = spark, n, rule, dof, symmetric
        self.pieces: list[DataFrame] = []
        self.graph_pieces: list[DataFrame] = []
        self.graph: DataFrame | None = None
        self.rhs: DataFrame | None = None
        self.sequences: dict[int, DataFrame] = {}
        self.masks: list = []

    # the pattern

    def add_edges(self, edges: DataFrame) -> Assembly:
        """(i, j) positions of nodes."""
        self.graph_pieces.append(edges.select("i", "j"))
        return self

    def add_block_edges(self, blocks: DataFrame) -> Assembly:
        """(rows array, cols array): every row with every column."""
        rows = blocks.select(F.explode("rows").alias("i"), "cols")
        return self.add_edges(rows.select("i", F.explode("cols").alias("j")))

    def add_graph_pointers(self, pointers: DataFrame, indices: DataFrame, by_row: bool = False) -> Assembly:
        """Compressed columns, or rows with ``by_row``; see ``expand_pointers``."""
        edges = expand_pointers(pointers, indices)
        return self.add_edges(edges.select(F.col("j").alias("i"), F.col("i").alias("j")) if by_row else edges)

    def close_graph(self) -> DataFrame:
        """Distinct positions; entries outside them are an error from now on."""
        self.graph = union_all(self.graph_pieces).distinct()
        return self.graph

    # values

    def _add(self, piece: DataFrame) -> Assembly:
        own = F.col("seq") if "seq" in piece.columns else F.lit(0).cast("long")
        self.pieces.append(piece.select("i", "j", F.col("v").cast("double").alias("v"), F.struct(F.lit(len(self.pieces)).alias("piece"), own.alias("row")).alias("seq")))
        return self

    def add_values(self, entries: DataFrame) -> Assembly:
        """(i, j, v) scalar entries, and seq if their order matters."""
        return self._add(entries)

    def add_node_values(self, blocks: DataFrame) -> Assembly:
        """(i, j, values): dof * dof values of a pair of nodes, column-major."""
        return self._add(explode_blocks(blocks, self.dof, tuple(c for c in blocks.columns if c == "seq")))

    def add_block_values(self, blocks: DataFrame) -> Assembly:
        """(rows array, cols array, values array): dense sub-matrices, column-major, of unknowns."""
        keep = [c for c in blocks.columns if c == "seq"]
        flat = blocks.select("rows", "cols", *keep, F.posexplode("values").alias("k", "v"))
        at = lambda array, k: F.element_at(array, (k + 1).cast("int"))
        size = F.size("rows")
        return self._add(flat.select(at(F.col("rows"), F.col("k") % size).alias("i"), at(F.col("cols"), F.floor(F.col("k") / size)).alias("j"), "v", *keep))

    def add_pointers(self, pointers: DataFrame, indices: DataFrame, values: DataFrame, by_row: bool = False) -> Assembly:
        entries = expand_pointers(pointers, indices, values)
        return self._add(entries.select(F.col("j").alias("i"), F.col("i").alias("j"), "v") if by_row else entries)

    def set_sequence(self, name: int, positions: DataFrame) -> Assembly:
        """(seq, i, j): positions to which lists of values are added again and again."""
        self.sequences[name] = positions.select("seq", "i", "j").persist()
        return self

    def use_sequence(self, name: int, values: DataFrame) -> Assembly:
        """(seq, v) at the positions of a stored sequence."""
        return self._add(self.sequences[name].join(values, "seq").select("i", "j", "v", "seq"))

    def delete_sequence(self, name: int) -> None:
        self.sequences.pop(name).unpersist()

    def mask_nodes(self, nodes: DataFrame) -> Assembly:
        """Drop entries between masked unknowns (i), the diagonal apart."""
        self.masks.append(lambda a: drop_nodes(a, nodes))
        return self

    def mask_rows(self, rows: DataFrame) -> Assembly:
        self.masks.append(lambda a: drop_rows(a, rows))
        return self

    def mask_columns(self, cols: DataFrame) -> Assembly:
        self.masks.append(lambda a: drop_columns(a, cols))
        return self

    def reset_values(self) -> Assembly:
        self.pieces = []
        return self

    def matrix(self, expected: int | None = None) -> DataFrame:
        """Combined entries: one shuffle with partial combination. Raises if the number of entries given is not
        ``expected``, or if some lie outside a closed graph (both run a count)."""
        given = union_all(self.pieces)
        if expected is not None and (found := given.count()) != expected:
            raise ValueError(f"{found} entries were given, {expected} announced")
        for mask in self.masks:
            given = mask(given)
        out = given.groupBy("i", "j").agg(combine_all(self.rule).alias("v"))
        if self.graph is not None:
            node = lambda c: (F.floor((F.col(c) - 1) / self.dof) + 1).alias(c)
            if out.select(node("i"), node("j")).join(self.graph, ["i", "j"], "left_anti").limit(1).count():
                raise ValueError("entries outside the graph")
        return out

    # right-hand side and results

    def set_rhs(self, values: DataFrame, rule: str = "ADD", cross: str | None = None) -> Assembly:
        """(i, x), and rank where parts come from several: values of one rank combine by ``rule``, ranks by
        ``cross``, and the result with what is there (at first 0) by ``rule``."""
        order = F.col("seq") if "seq" in values.columns else F.lit(0)
        rows = values.withColumn("seq", order)
        if "rank" in values.columns:
            rows = rows.groupBy("i", "rank").agg(combine_all(rule, "x").alias("x")).withColumn("seq", F.col("rank"))
        each = rows.groupBy("i").agg(combine_all(cross or rule, "x").alias("_new"))
        now = self.current_rhs()
        self.rhs = now.join(each, "i", "left").select("i", F.when(F.col("_new").isNull(), F.col("x")).otherwise(combine_two(rule, F.col("x"), F.col("_new"))).alias("x"))
        return self

    def set_global_rhs(self, b: DataFrame) -> Assembly:
        self.rhs = b.select("i", "x")
        return self

    def current_rhs(self) -> DataFrame:
        if self.rhs is not None:
            return self.rhs
        return self.spark.range(1, self.n * self.dof + 1).select(F.col("id").alias("i"), F.lit(0.0).alias("x"))

    def reset_rhs(self) -> Assembly:
        self.rhs = None
        return self

    def product(self, x: DataFrame, indices: DataFrame | None = None) -> DataFrame:
        """A x at all unknowns, or at those of ``indices`` (i)."""
        ids = self.spark.range(1, self.n * self.dof + 1).select(F.col("id").alias("i"))
        out = multiply_vector(self.matrix(), x, ids=ids)
        return out.join(indices.select("i").distinct(), "i", "left_semi") if indices is not None else out

    def norm(self, side: str, kind: str, squared: bool = False) -> DataFrame:
        return side_norm(self.matrix(), side, kind, squared)

    def scaled(self, scale: DataFrame, side: str) -> DataFrame:
        """Entries divided by scale (i, x) of their row (side i) or column (side j); 1 where it has none."""
        return (unscale_rows if side == "i" else unscale_columns)(self.matrix(), scale)

    def unknowns(self, nodes: DataFrame) -> DataFrame:
        return node_unknowns(nodes, self.dof)


def subset(x: DataFrame, indices: DataFrame) -> DataFrame:
    """A solution at a list of indices (i)."""
    return x.join(indices.select("i").distinct(), "i", "left_semi")
