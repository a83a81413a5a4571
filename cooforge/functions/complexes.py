"""Complex numbers as struct<re: double, im: double> columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def make(re: Column, im: Column) -> Column:
    return F.struct(re.cast("double").alias("re"), im.cast("double").alias("im"))


def add(a: Column, b: Column) -> Column:
    return make(a["re"] + b["re"], a["im"] + b["im"])


def subtract(a: Column, b: Column) -> Column:
    return make(a["re"] - b["re"], a["im"] - b["im"])


def multiply(a: Column, b: Column) -> Column:
    return make(a["re"] * b["re"] - a["im"] * b["im"], a["re"] * b["im"] + a["im"] * b["re"])


def divide(a: Column, b: Column) -> Column:
    size = b["re"] * b["re"] + b["im"] * b["im"]
    product = multiply(a, conjugate(b))
    return make(product["re"] / size, product["im"] / size)


def conjugate(a: Column) -> Column:
    return make(a["re"], -a["im"])


def modulus(a: Column) -> Column:
    return F.hypot(a["re"], a["im"])


def total(a: Column) -> Column:
    """Aggregate: the sum."""
    return make(F.sum(a["re"]), F.sum(a["im"]))


def real_form(a: DataFrame) -> DataFrame:
    """Entries of the real matrix of twice the order that acts on (re, im) pairs as the complex one does on numbers.

    Unknown k becomes 2 k - 1 (real part) and 2 k (imaginary part). A Hermitian
    matrix becomes a symmetric one, definite if it was.
    """
    i, j, re, im = 2 * F.col("i") - 1, 2 * F.col("j") - 1, F.col("v")["re"], F.col("v")["im"]
    cell = lambda i, j, v: F.struct(i.alias("i"), j.alias("j"), v.alias("v"))
    return a.select(F.explode(F.array(cell(i, j, re), cell(i + 1, j + 1, re), cell(i, j + 1, -im), cell(i + 1, j, im))).alias("e")).select("e.*")


def real_vector(x: DataFrame) -> DataFrame:
    """A complex vector as the real one that goes with ``real_form``."""
    parts = F.posexplode(F.array(F.col("x")["re"], F.col("x")["im"]))
    others = [c for c in x.columns if c not in ("i", "x")]
    return x.select((2 * F.col("i") - 1).alias("_i"), *others, parts.alias("_k", "x")).select((F.col("_i") + F.col("_k")).alias("i"), *others, "x")


def complex_vector(x: DataFrame) -> DataFrame:
    """Back from ``real_vector``."""
    k, others = F.floor((F.col("i") + 1) / 2).cast("long"), [c for c in x.columns if c not in ("i", "x")]
    part = lambda rest: F.sum(F.when(F.col("i") % 2 == rest, F.col("x")).otherwise(0.0))
    return x.groupBy(k.alias("_i"), *others).agg(make(part(1), part(0)).alias("x")).select(F.col("_i").alias("i"), *others, "x")


def dot(x: DataFrame, y: DataFrame) -> DataFrame:
    """One row: the sum of conj(x_i) y_i."""
    both = x.join(y.withColumnRenamed("x", "_y"), "i").select(multiply(conjugate(F.col("x")), F.col("_y")).alias("p"))
    return both.agg(total(F.col("p")).alias("dot"))
