"""Norms, errors, counts and block statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def norm_one(a: DataFrame) -> DataFrame:
    """The largest column sum of magnitudes."""
    return a.groupBy("j").agg(F.sum(F.abs("v")).alias("s")).agg(F.coalesce(F.max("s"), F.lit(0.0)).alias("norm1"))


def norm_two(x: DataFrame) -> DataFrame:
    """Of a vector, over all right-hand sides."""
    return x.agg(F.sqrt(F.coalesce(F.sum(F.col("x") * F.col("x")), F.lit(0.0))).alias("norm2"))


def side_norm(a: DataFrame, side: str, kind: str, squared: bool = False) -> DataFrame:
    """(side, norm) by row (i) or column (j): the largest magnitude, or the 2-norm (its square if asked)."""
    if side not in ("i", "j") or kind not in ("max", "two"):
        raise ValueError("side is i or j, kind is max or two")
    norm = F.max(F.abs("v")) if kind == "max" else F.sum(F.col("v") * F.col("v"))
    if kind == "two" and not squared:
        norm = F.sqrt(norm)
    return a.groupBy(side).agg(norm.alias("norm"))


def relative_error(r: DataFrame, b: DataFrame) -> DataFrame:
    """|r| / |b|, the worst over right-hand sides; 0 / 0 is 0."""
    rhs = ["rhs"] if "rhs" in b.columns else []
    squares = lambda v, n: v.groupBy(*rhs).agg(F.sum(F.col("x") * F.col("x")).alias(n))
    both = squares(r, "rr").join(squares(b, "bb"), rhs) if rhs else squares(r, "rr").crossJoin(squares(b, "bb"))
    ratio = F.when((F.col("rr") == 0) & (F.col("bb") == 0), F.lit(0.0)).otherwise(F.sqrt(F.col("rr") / F.col("bb")))
    return both.agg(F.max(ratio).alias("error"))


def backward_error(r: DataFrame, s: DataFrame) -> DataFrame:
    """max |r_i| / |s_i|; 0 / 0 is 0."""
    ratio = F.when((F.col("x") == 0) & (F.col("_s") == 0), F.lit(0.0)).otherwise(F.abs(F.col("x")) / F.abs(F.col("_s")))
    return r.join(s.select("i", F.col("x").alias("_s")), "i").agg(F.max(ratio).alias("berr"))


def diagonal_counts(a: DataFrame) -> DataFrame:
    """One row: entries under, on and above the diagonal."""
    count = lambda c, n: F.count(F.when(c, 1)).alias(n)
    i, j = F.col("i"), F.col("j")
    return a.agg(count(i > j, "lower"), count(i == j, "diagonal"), count(i < j, "upper"))


def summary(a: DataFrame) -> DataFrame:
    """One row of what a matrix holds."""
    return a.agg(
        F.count("*").alias("entries"), F.countDistinct("i").alias("rows_used"), F.countDistinct("j").alias("cols_used"),
        F.max(F.abs("v")).alias("largest"), F.sum(F.abs("v")).alias("magnitude"),
    )


def level_histogram(blocks: DataFrame) -> DataFrame:
    """(level, blocks)."""
    return blocks.groupBy("level").agg(F.count("*").alias("blocks"))


def metric_curve(blocks: DataFrame, metric: str, area: str) -> DataFrame:
    """(metric value, area of blocks up to it). The window runs over distinct values only."""
    each = blocks.groupBy(F.col(metric).alias("value")).agg(F.sum(area).alias("own"))
    return each.select("value", F.sum("own").over(Window.orderBy("value")).alias("area"))


def tree_shape(heights: DataFrame) -> DataFrame:
    """One row from (node, parent, height): leaves; least, largest, mean height of leaves and its deviation."""
    inner = heights.where("parent IS NOT NULL").select(F.col("parent").alias("node")).distinct()
    leaves = heights.join(inner, "node", "left_anti")
    return leaves.agg(F.count("*").alias("leaves"), F.min("height").alias("least"), F.max("height").alias("largest"), F.avg("height").alias("mean"), F.stddev_pop("height").alias("deviation"))
