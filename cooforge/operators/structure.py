"""Restructuring: filters, triangles, permutations, scalings, symmetric patterns, splits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.numbering import row_numbers


def _also(df: DataFrame, *known: str) -> list[str]:
    return [c for c in df.columns if c not in known]


def no_diagonal(a: DataFrame) -> DataFrame:
    return a.where("i <> j")


def keep_where(a: DataFrame, condition: Column | str) -> DataFrame:
    """Entries that a predicate on (i, j, v) keeps."""
    return a.where(condition)


def drop_small(a: DataFrame, tolerance: float) -> DataFrame:
    return a.where(F.abs("v") > tolerance)


def drop_zeros(a: DataFrame) -> DataFrame:
    return a.where("v <> 0")


def transpose(a: DataFrame) -> DataFrame:
    return a.select(F.col("j").alias("i"), F.col("i").alias("j"), *_also(a, "i", "j"))


def lower_triangle(a: DataFrame) -> DataFrame:
    return a.where("i >= j")


def upper_triangle(a: DataFrame) -> DataFrame:
    return a.where("i <= j")


def rebase(a: DataFrame, old: int, new: int) -> DataFrame:
    return a.select((F.col("i") + (new - old)).alias("i"), (F.col("j") + (new - old)).alias("j"), *_also(a, "i", "j"))


def found_base(a: DataFrame) -> DataFrame:
    """One row: the least index, over rows and columns."""
    return a.agg(F.least(F.min("i"), F.min("j")).alias("base"))


def expand_symmetric(a: DataFrame, conjugate: bool = False) -> DataFrame:
    """Both triangles of a matrix that stores one; conjugate mirrored values for Hermitian storage.

    One scan: every off-diagonal entry becomes two rows.
    """
    value = F.col("v")
    mirrored = F.struct(value["re"].alias("re"), (-value["im"]).alias("im")) if conjugate else value
    own = F.struct(F.col("i"), F.col("j"), value.alias("v"))
    other = F.struct(F.col("j").alias("i"), F.col("i").alias("j"), mirrored.alias("v"))
    return a.select(F.explode(F.when(F.col("i") == F.col("j"), F.array(own)).otherwise(F.array(own, other))).alias("e")).select("e.*")


def invert_permutation(p: DataFrame) -> DataFrame:
    return p.select(F.col("new").alias("old"), F.col("old").alias("new"))


def random_permutation(spark, n: int, seed: int) -> DataFrame:
    """(old, new) over 1..n in random order, that of a hash of seed and index; the hash's range is cut as indices would be."""
    chance = F.xxhash64(F.lit(seed), "id")
    place = F.floor((chance / 2.0**63 + 1) / 2 * n)
    return row_numbers(spark.range(1, n + 1).select(F.col("id").alias("old"), chance.alias("_chance"), place.alias("_place")), "new", "_place", then=("_chance", "old")).select("old", "new")


def _permuted(a: DataFrame, p: DataFrame, side: str) -> DataFrame:
    q = p.select(F.col("old").alias("_old"), F.col("new").alias("_new"))
    return a.join(q, a[side] == q["_old"]).select(*[F.col("_new").alias(side) if c == side else F.col(c) for c in a.columns])


def permute_columns(a: DataFrame, p: DataFrame) -> DataFrame:
    return _permuted(a, p, "j")


def permute_rows(a: DataFrame, p: DataFrame) -> DataFrame:
    return _permuted(a, p, "i")


def permute(a: DataFrame, p: DataFrame, q: DataFrame | None = None) -> DataFrame:
    """Rows by p and columns by q (by p too if q is not given)."""
    return _permuted(_permuted(a, p, "i"), q if q is not None else p, "j")


def permute_vector(x: DataFrame, p: DataFrame) -> DataFrame:
    return _permuted(x, p, "i")


def _scaled(a: DataFrame, d: DataFrame, side: str, divide: bool, missing: float | None) -> DataFrame:
    s = d.select(F.col("i").alias("_at"), F.col("x").alias("_s"))
    factor = F.col("_s") if missing is None else F.coalesce("_s", F.lit(missing))
    joined = a.join(s, a[side] == s["_at"], "inner" if missing is None else "left")
    return joined.select("i", "j", (F.col("v") / factor if divide else F.col("v") * factor).alias("v"))


def scale_rows(a: DataFrame, d: DataFrame, missing: float | None = None) -> DataFrame:
    """v * d[i]; rows that d lacks are dropped, or scaled by ``missing``."""
    return _scaled(a, d, "i", False, missing)


def scale_columns(a: DataFrame, d: DataFrame, missing: float | None = None) -> DataFrame:
    return _scaled(a, d, "j", False, missing)


def unscale_rows(a: DataFrame, d: DataFrame, missing: float | None = 1.0) -> DataFrame:
    """v / d[i]; rows that d lacks stay."""
    return _scaled(a, d, "i", True, missing)


def unscale_columns(a: DataFrame, d: DataFrame, missing: float | None = 1.0) -> DataFrame:
    return _scaled(a, d, "j", True, missing)


def unscale(a: DataFrame, rows: DataFrame, cols: DataFrame | None = None) -> DataFrame:
    """Undo a row and column scaling (the same on both sides if only one is given)."""
    return unscale_columns(unscale_rows(a, rows), cols if cols is not None else rows)


def scale_diagonal(a: DataFrame, d: DataFrame) -> DataFrame:
    s = d.select(F.col("i").alias("_at"), F.col("x").alias("_s"))
    value = F.when(F.col("i") == F.col("j"), F.col("v") * F.col("_s")).otherwise(F.col("v"))
    return a.join(s, a["i"] == s["_at"]).select("i", "j", value.alias("v"))


def dominant_diagonal(a: DataFrame) -> DataFrame:
    """The matrix with each stored diagonal entry set to the column's sum of off-diagonal magnitudes plus 1."""
    off = F.sum(F.when(F.col("i") != F.col("j"), F.abs("v")).otherwise(0.0)).over(Window.partitionBy("j"))
    return a.select("i", "j", F.when(F.col("i") == F.col("j"), off + 1.0).otherwise(F.col("v")).alias("v"))


def model_dominance(a: DataFrame) -> DataFrame:
    """Values for tests: diagonal 2 * (entries of the column) - 1, all others -0.8."""
    count = F.count("*").over(Window.partitionBy("j"))
    return a.select("i", "j", F.when(F.col("i") == F.col("j"), 2.0 * count - 1.0).otherwise(F.lit(-0.8)).alias("v"))


def unit_diagonal(a: DataFrame) -> DataFrame:
    """The identity on the same pattern."""
    return a.select("i", "j", F.when(F.col("i") == F.col("j"), F.lit(1.0)).otherwise(F.lit(0.0)).alias("v"))


def add_zero_diagonal(a: DataFrame, n: int) -> DataFrame:
    """A zero diagonal entry appended for every index, also where one exists."""
    ids = a.sparkSession.range(1, n + 1)
    return a.unionByName(ids.select(F.col("id").alias("i"), F.col("id").alias("j"), F.lit(0.0).alias("v")))


def add_entries(a: DataFrame, more: DataFrame) -> DataFrame:
    return a.unionByName(more.select("i", "j", "v"))


def add_edges(a: DataFrame, edges: DataFrame) -> DataFrame:
    """Zero-valued entries at (i, j)."""
    return a.unionByName(edges.select("i", "j", F.lit(0.0).alias("v")))


def without_columns(a: DataFrame, gone: DataFrame) -> DataFrame:
    return a.join(gone.select("j").distinct(), "j", "left_anti").select(*a.columns)


def only_columns(a: DataFrame, owned: DataFrame) -> DataFrame:
    return a.join(owned.select("j").distinct(), "j", "left_semi").select(*a.columns)


def missing_mirrors(a: DataFrame) -> DataFrame:
    """Positions (i, j), i <> j, that a symmetric pattern would need and the matrix lacks.

    One aggregation by unordered pair instead of a self-join.
    """
    pair = a.where("i <> j").select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b"), (F.col("i") > F.col("j")).alias("low"))
    sides = pair.groupBy("a", "b").agg(F.max("low").alias("has_low"), F.min("low").alias("all_low"))
    one = sides.where("has_low = all_low")
    return one.select(F.when(F.col("has_low"), F.col("a")).otherwise(F.col("b")).alias("i"), F.when(F.col("has_low"), F.col("b")).otherwise(F.col("a")).alias("j"))


def symmetrize_pattern(a: DataFrame) -> DataFrame:
    """The matrix with an entry of value 0 at every missing mirror position."""
    return a.unionByName(missing_mirrors(a).withColumn("v", F.lit(0.0)))


def check_symmetry(a: DataFrame, correct: bool = False) -> DataFrame:
    """The symmetrised matrix if ``correct``, else the matrix itself or an error. Runs a job if not ``correct``."""
    if correct:
        return symmetrize_pattern(a)
    if missing_mirrors(a).limit(1).count():
        raise ValueError("the pattern is not symmetric")
    return a


def pairs_of(a: DataFrame) -> DataFrame:
    """Unordered pairs i < j of the pattern without diagonal, once each."""
    return a.where("i <> j").select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j")).distinct()


#: Partitions in which pairs become distinct: the most that a shuffle deals without sorting in memory.
SPREAD = 200


def graph_of(a: DataFrame) -> DataFrame:
    """Edges (i, j) of the symmetric pattern without diagonal, once each: pairs are made distinct, then mirrored.

    Most pairs are there once, so they are dealt before any are gathered: a task that reads holds none of them, one that
    makes them distinct its share. A number of partitions that is given is not lowered.
    """
    parts = max(SPREAD, int(a.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    pairs = a.where("i <> j").select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j")).repartition(parts, "i", "j").distinct()
    mirrored = F.explode(F.array(F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j"))))
    return pairs.select(mirrored.alias("e")).select("e.*")


def pattern(a: DataFrame) -> DataFrame:
    return a.select("i", "j").distinct()


def weak_columns(a: DataFrame, n: int, epsilon: float) -> DataFrame:
    """(j, weak) for all columns: no entries, no diagonal entry, or one below epsilon."""
    ids = a.sparkSession.range(1, n + 1).select(F.col("id").alias("j"))
    best = a.where("i = j").groupBy("j").agg(F.max(F.abs("v")).alias("d"))
    return ids.join(best, "j", "left").select("j", F.coalesce(F.col("d") < epsilon, F.lit(True)).alias("weak"))


def split_weak_diagonal(a: DataFrame, n: int, epsilon: float) -> DataFrame:
    """(old, new, weak): a permutation that moves weak columns to the end, order kept in both classes."""
    flagged = weak_columns(a, n, epsilon)
    return row_numbers(flagged, "new", "j", first=("weak",)).select(F.col("j").alias("old"), "new", "weak")


def isolate(n: int, chosen: DataFrame) -> DataFrame:
    """(old, new, chosen): a permutation of 1..n that moves the chosen unknowns (column i) to the end."""
    ids = chosen.sparkSession.range(1, n + 1).select(F.col("id").alias("i"))
    flagged = ids.join(chosen.select("i", F.lit(True).alias("c")).distinct(), "i", "left").select("i", F.coalesce("c", F.lit(False)).alias("chosen"))
    return row_numbers(flagged, "new", "i", first=("chosen",)).select(F.col("i").alias("old"), "new", "chosen")


def induced(a: DataFrame, split: DataFrame, flag: str, value: bool) -> DataFrame:
    """The submatrix among the unknowns whose ``flag`` in (old, new, flag) is ``value``, renumbered from 1."""
    own = split.where(F.col(flag) == F.lit(value)).select("old", F.col("new").alias("_at"))
    return permute(a, row_numbers(own, "new", "_at").select("old", "new"))


def drop_nodes(a: DataFrame, masked: DataFrame) -> DataFrame:
    """Without entries off the diagonal whose both ends are masked (column i)."""
    m = masked.select("i").distinct()
    rows, cols = m.select(F.col("i").alias("_r")), m.select(F.col("i").alias("_c"))
    joined = a.join(rows, a["i"] == F.col("_r"), "left").join(cols, a["j"] == F.col("_c"), "left")
    return joined.where((F.col("i") == F.col("j")) | F.col("_r").isNull() | F.col("_c").isNull()).select(*a.columns)


def drop_rows(a: DataFrame, masked: DataFrame) -> DataFrame:
    """Without entries of masked rows (column i), the diagonal kept."""
    m = masked.select(F.col("i").alias("_r")).distinct()
    return a.join(m, a["i"] == F.col("_r"), "left").where((F.col("i") == F.col("j")) | F.col("_r").isNull()).select(*a.columns)


def drop_columns(a: DataFrame, masked: DataFrame) -> DataFrame:
    return transpose(drop_rows(transpose(a), masked.select(F.col("j").alias("i")))).select(*a.columns)


def column_count(a: DataFrame, j: int) -> DataFrame:
    return a.where(F.col("j") == j).agg(F.count("*").alias("entries"))


def column_rows(a: DataFrame, j: int) -> DataFrame:
    return a.where(F.col("j") == j).select("i")


def local_numbers(owned: DataFrame) -> DataFrame:
    """(j, local): numbers from 1 of the owned columns in order, within each owner where there is one."""
    owner = tuple(c for c in owned.columns if c == "owner")
    return row_numbers(owned.select("j", *owner), "local", "j", within=owner)


def expand_pointers(pointers: DataFrame, indices: DataFrame, values: DataFrame | None = None) -> DataFrame:
    """Compressed columns to entries.

    pointers (j, start, stop) with positions start <= pos < stop; indices (pos, i); values (pos, v).
    """
    placed = pointers.where("stop > start").select("j", F.explode(F.sequence("start", F.col("stop") - 1)).alias("pos"))
    out = placed.join(indices, "pos")
    return out.join(values, "pos").select("i", "j", "v") if values is not None else out.select("i", "j")


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
