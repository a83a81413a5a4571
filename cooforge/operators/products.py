"""Products, residuals, sums and merges of matrices; vector algebra.

A product joins on the inner index and sums by the outer one, with partial sums
before the shuffle. A vector is shuffled, not broadcast: it grows with the matrix,
and Spark sees only its compressed size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.combine import combine_all, combine_two


def multiply_vector(a: DataFrame, x: DataFrame, transposed: bool = False, magnitude: bool = False, ids: DataFrame | None = None) -> DataFrame:
    """A x, or At x, or |A| |x|. ``x`` may have a column rhs, for several right-hand sides.

    With ``ids`` (i), indices that the product does not reach have 0.
    """
    inner, outer = ("i", "j") if transposed else ("j", "i")
    rhs = ["rhs"] if "rhs" in x.columns else []
    y = x.select(F.col("i").alias("_k"), *rhs, F.col("x").alias("_x"))
    term = F.abs(F.col("v") * F.col("_x")) if magnitude else F.col("v") * F.col("_x")
    product = a.join(y.hint("shuffle_merge"), a[inner] == y["_k"]).groupBy(F.col(outer).alias("i"), *rhs).agg(F.sum(term).alias("x"))
    if ids is None:
        return product
    if rhs:
        ids = ids.crossJoin(F.broadcast(x.select("rhs").distinct()))  # few right-hand sides
    return ids.join(product, ["i", *rhs], "left").select("i", *rhs, F.coalesce("x", F.lit(0.0)).alias("x"))


def product_plus(a: DataFrame, x: DataFrame, y: DataFrame) -> DataFrame:
    """y + A x."""
    return y.unionByName(multiply_vector(a, x)).groupBy("i").agg(F.sum("x").alias("x"))


def residual(a: DataFrame, x: DataFrame, b: DataFrame, transposed: bool = False) -> DataFrame:
    """b - A x over the indices of b."""
    rhs = [c for c in ("rhs",) if c in b.columns]
    product = multiply_vector(a, x, transposed).withColumnRenamed("x", "_p")
    return b.join(product.hint("shuffle_merge"), ["i", *rhs], "left").select("i", *rhs, (F.col("x") - F.coalesce("_p", F.lit(0.0))).alias("x"))


def magnitude_bound(a: DataFrame, x: DataFrame, b: DataFrame) -> DataFrame:
    """|A| |x| + |b| over the indices of b."""
    product = multiply_vector(a, x, magnitude=True).withColumnRenamed("x", "_p")
    return b.join(product, "i", "left").select("i", (F.abs("x") + F.coalesce("_p", F.lit(0.0))).alias("x"))


def multiply(a: DataFrame, b: DataFrame) -> DataFrame:
    """A B."""
    right = b.select(F.col("i").alias("_k"), F.col("j").alias("_j"), F.col("v").alias("_v"))
    return a.join(right, a["j"] == right["_k"]).groupBy("i", F.col("_j").alias("j")).agg(F.sum(F.col("v") * F.col("_v")).alias("v"))


def add(a: DataFrame, b: DataFrame, alpha: float = 1.0, beta: float = 1.0) -> DataFrame:
    """alpha A + beta B; positions of either stay even where values cancel."""
    scaled = lambda m, s: m.select("i", "j", (F.col("v") * s).alias("v"))
    return scaled(a, alpha).unionByName(scaled(b, beta)).groupBy("i", "j").agg(F.sum("v").alias("v"))


def merge_duplicates(a: DataFrame, rule: str = "ADD") -> DataFrame:
    """One entry for each position."""
    return a.groupBy("i", "j").agg(combine_all(rule).alias("v"))


def duplicates(a: DataFrame) -> DataFrame:
    """Positions that hold more than one entry, and how many."""
    return a.groupBy("i", "j").agg(F.count("*").alias("entries")).where("entries > 1")


def merge_local(a: DataFrame, b: DataFrame, rule: str, owned: DataFrame | None = None) -> DataFrame:
    """B merged into A by a combiner, for the columns that A owns (by default those in which A has entries).

    A missing value (null) of a stored entry counts as 0.
    """
    owned = (owned if owned is not None else a).select("j").distinct()
    old = a.select("i", "j", F.coalesce("v", F.lit(0.0)).alias("old"))
    new = b.join(owned, "j", "left_semi").select("i", "j", F.coalesce("v", F.lit(0.0)).alias("new"))
    return old.join(new, ["i", "j"], "full_outer").select("i", "j", combine_two(rule, F.col("old"), F.col("new")).alias("v"))


def generated_vector(spark, n: int, kind: str) -> DataFrame:
    """(i, x) over 1..n: zeros, ones, or the index."""
    value: dict[str, Column] = {"0": F.lit(0.0), "1": F.lit(1.0), "i": F.col("id").cast("double")}
    return spark.range(1, n + 1).select(F.col("id").alias("i"), value[kind].alias("x"))


def generated_rhs(a: DataFrame, n: int, kind: str, rhs: int = 1) -> DataFrame:
    """The right-hand side whose solution is all ones (times the number of the side) or the index."""
    product = multiply_vector(a, generated_vector(a.sparkSession, n, kind), ids=a.sparkSession.range(1, n + 1).select(F.col("id").alias("i")))
    if rhs == 1:
        return product
    times = F.col("rhs").cast("double") if kind == "1" else F.lit(1.0)
    return product.select("i", F.explode(F.sequence(F.lit(1), F.lit(rhs))).alias("rhs"), "x").select("i", "rhs", (F.col("x") * times).alias("x"))


def scaled_vector(x: DataFrame, alpha: float) -> DataFrame:
    return x.withColumn("x", F.col("x") * alpha)


def axpy(alpha: float, x: DataFrame, y: DataFrame) -> DataFrame:
    """y + alpha x over all indices of either; a missing one counts as 0."""
    return y.select("i", "x").unionByName(x.select("i", (F.col("x") * alpha).alias("x"))).groupBy("i").agg(F.sum("x").alias("x"))


def dot(x: DataFrame, y: DataFrame) -> DataFrame:
    """One row: the sum of x_i y_i."""
    return x.join(y.withColumnRenamed("x", "_y"), "i").agg(F.coalesce(F.sum(F.col("x") * F.col("_y")), F.lit(0.0)).alias("dot"))
