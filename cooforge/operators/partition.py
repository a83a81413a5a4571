"""Distribution of columns and validation of matrices."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.numbering import row_numbers
from .norms import diagonal_counts
from .products import merge_duplicates
from .structure import lower_triangle, missing_mirrors, rebase, symmetrize_pattern


def cyclic_owner(j: Column | str, parts: int) -> Column:
    """Columns dealt in turn, from 1: part (j - 1) mod parts."""
    return F.pmod((F.col(j) if isinstance(j, str) else j) - 1, F.lit(parts)).cast("int")


def contiguous_owner(j: Column | str, parts: int, n: int) -> Column:
    """Columns in runs: part floor((j - 1) parts / n)."""
    return F.floor(((F.col(j) if isinstance(j, str) else j) - 1) * parts / F.lit(n)).cast("int")


def distribute(a: DataFrame, parts: int, n: int, cyclic: bool = True) -> DataFrame:
    """The entries with their owner, physically partitioned by it."""
    owner = cyclic_owner("j", parts) if cyclic else contiguous_owner("j", parts, n)
    return a.withColumn("owner", owner).repartition(parts, "owner")


def redistribute(a: DataFrame, owners: DataFrame, parts: int) -> DataFrame:
    """To a layout given as (j, owner)."""
    return a.join(owners, "j").repartition(parts, "owner")


def restrict(x: DataFrame, owned: DataFrame) -> DataFrame:
    """The part of a vector, permutation or matrix at the owned indices (j)."""
    key = "i" if "i" in x.columns and "j" not in x.columns else "old" if "old" in x.columns else "j"
    return x.join(owned.select(F.col("j").alias(key)), key, "left_semi").select(*x.columns)


def gather(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def majority_owner(entries: DataFrame) -> DataFrame:
    """(j, owner): the rank with the most entries of each column in (rank, i, j), the highest of equals."""
    counts = entries.groupBy("j", "rank").agg(F.count("*").alias("c"))
    return counts.groupBy("j").agg(F.max_by("rank", F.struct("c", "rank")).alias("owner"))


def element_owner(elements: DataFrame, owners: DataFrame) -> DataFrame:
    """(element, owner): the rank that owns most vertices of each element in (element, node); the lowest of equals."""
    counts = elements.join(owners, "node").groupBy("element", "owner").agg(F.count("*").alias("c"))
    return counts.groupBy("element").agg(F.min_by("owner", F.struct(-F.col("c"), "owner")).alias("owner"))


def balance_elements(assigned: DataFrame, parts: int) -> DataFrame:
    """(element, owner) moved from crowded owners to others until counts differ by one at most.

    Elements keep their owner up to its quota; the surplus fills the free places in order.
    """
    total = assigned.count()
    quota = F.floor(F.lit(total) / parts) + (F.col("owner") < total % parts).cast("int")
    ranked = row_numbers(assigned, "_k", "element", within=("owner",))
    kept = ranked.where(F.col("_k") <= quota).select("element", "owner")
    surplus = row_numbers(ranked.where(F.col("_k") > quota).select("owner", "element"), "_place", "element", first=("owner",)).select("element", "_place")
    owners = assigned.sparkSession.range(parts).select(F.col("id").cast("int").alias("owner"))
    have = kept.groupBy("owner").agg(F.count("*").alias("c"))
    free = owners.join(have, "owner", "left").withColumn("free", (quota - F.coalesce("c", F.lit(0))).cast("int")).where("free > 0")
    places = row_numbers(free.select("owner", F.explode(F.sequence(F.lit(1), "free")).alias("f")), "_place", "f", first=("owner",)).select("owner", "_place")
    return kept.unionByName(surplus.join(places, "_place").select("element", "owner"))


@dataclass(frozen=True)
class Checked:
    """A matrix fit for factorisation, and what was repaired."""

    entries: DataFrame
    base: int
    duplicates: int
    added: int
    dropped: int


def check_matrix(a: DataFrame, symmetric: bool, correct: bool = True) -> Checked:
    """Base, duplicates, triangles and pattern, in that order; repairs if ``correct``, else raises ValueError.

    Two aggregates over the entries decide everything.
    """
    first = a.agg(F.least(F.min("i"), F.min("j")).alias("base"), F.count("*").alias("n")).first()
    if not first["n"]:
        return Checked(a, 1, 0, 0, 0)
    out = rebase(a, first["base"], 1) if first["base"] == 0 else a
    if first["base"] not in (0, 1):
        raise ValueError(f"indices start at {first['base']}")
    merged = merge_duplicates(out)
    counts = diagonal_counts(merged).first()
    distinct = counts["lower"] + counts["diagonal"] + counts["upper"]
    extra = first["n"] - distinct
    if extra and not correct:
        raise ValueError(f"{extra} duplicate entries")
    out = merged if extra else out
    if symmetric:
        if counts["lower"] and counts["upper"]:
            if not correct or counts["lower"] != counts["upper"]:
                raise ValueError("both triangles are given for a symmetric matrix")
            return Checked(lower_triangle(out), first["base"], extra, 0, counts["upper"])
        stored = out if counts["lower"] or not counts["upper"] else out.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")
        return Checked(stored, first["base"], extra, 0, 0)
    missing = missing_mirrors(out).count()
    if missing and not correct:
        raise ValueError(f"{missing} entries lack their mirror")
    return Checked(symmetrize_pattern(out) if missing else out, first["base"], extra, missing, 0)
