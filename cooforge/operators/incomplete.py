"""Incomplete factorisation by level of fill, ILU(k), as a preconditioner for systems of any size.

The factor's values are the fixed point of

    l(i, j) = (a(i, j) - sum over m < j of l(i, m) u(m, j)) / u(j, j)     below the diagonal
    u(i, j) =  a(i, j) - sum over m < i of l(i, m) u(m, j)                elsewhere

over the pattern of ``graph.fill_levels``. Each sweep takes all values from the
sweep before (two joins on positions, a partial sum before the shuffle),
so a sweep is parallel over all entries and needs no order of elimination; the
products that meet in the pattern are found once. A
value is final once all that it depends on are: the sweeps end at the exact
incomplete factor, after as many as the longest chain of dependences at most,
and far earlier to a tolerance where the diagonal dominates.

The triangular solves are sweeps too. A fixed number of them is a fixed linear
map, symmetric for a symmetric matrix, so every Krylov method may use it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import checkpoint
from .graph import fill_levels
from .krylov import Precondition
from .products import residual


def incomplete_factor(a: DataFrame, level: int = 0, sweeps: int = 40, epsilon: float = 1e-12) -> DataFrame:
    """(i, j, v): L strictly below the diagonal (its own diagonal is one), U on and above it.

    ``a`` holds both triangles, each position once; positions that it lacks are 0.
    Sweeps end when no value moves by more than ``epsilon`` times the largest, or
    after ``sweeps``: the last values are then an approximation of ILU(level).
    A pivot that stays zero, or values beyond doubles, raise ArithmeticError.
    """
    diagonal = a.select(F.col("i").alias("k")).union(a.select("j")).distinct().select(F.col("k").alias("i"), F.col("k").alias("j"))
    pattern = fill_levels(a, level).select("i", "j").union(diagonal).distinct()
    start = F.coalesce("v", F.lit(0.0))
    state = checkpoint(pattern.join(a.select("i", "j", "v"), ["i", "j"], "left").select("i", "j", start.alias("a"), start.alias("v")))
    terms = _terms(state)
    for _ in range(sweeps):
        state = checkpoint(_sweep(state, terms))
        moved, most = state.agg(F.max(F.abs(F.col("v") - F.col("before"))), F.max(F.abs("v"))).first()
        if moved is None or not most < float("inf") or moved <= epsilon * most:
            break
        state = state.drop("before")
    broken = state.where("isnan(v) OR abs(v) = double('infinity') OR (i = j AND v = 0)")
    if broken.limit(1).count():
        raise ArithmeticError("the incomplete factor has a zero pivot or values beyond doubles")
    return state.select("i", "j", "v")


def _terms(state: DataFrame) -> DataFrame:
    """(i, j, m): for each position the m < min(i, j) where (i, m) and (m, j) are positions too.

    A position looks through the shorter of its row and its column, so a hub meets no pair of its neighbours that the
    pattern lacks. Those lists go by position to the values' keys; sweeps use the same terms again.
    """
    at = state.select("i", "j")
    low = at.where("i > j").select("i", F.col("j").alias("m"))
    up = at.where("i < j").select(F.col("i").alias("m"), "j")
    rows, cols = low.groupBy("i").agg(F.count("*").alias("_row")), up.groupBy("j").agg(F.count("*").alias("_col"))
    sized = checkpoint(at.join(rows, "i").join(cols, "j"))  # a position without either has no terms
    by_row = sized.where("_row <= _col").select("i", "j").join(low, "i").where("m < j").join(up, ["m", "j"], "left_semi")
    by_col = sized.where("_row > _col").select("i", "j").join(up, "j").where("m < i").join(low, ["i", "m"], "left_semi")
    return checkpoint(by_row.select("i", "j", "m").unionByName(by_col.select("i", "j", "m")))


def _sweep(state: DataFrame, terms: DataFrame) -> DataFrame:
    low = state.where("i > j").select("i", F.col("j").alias("m"), F.col("v").alias("_l"))
    up = state.where("i < j").select(F.col("i").alias("m"), "j", F.col("v").alias("_u"))
    done = terms.join(low, ["i", "m"]).join(up, ["m", "j"]).groupBy("i", "j").agg(F.sum(F.col("_l") * F.col("_u")).alias("_s"))
    pivots = state.where("i = j").select("j", F.col("v").alias("_d"))
    rest = F.col("a") - F.coalesce("_s", F.lit(0.0))
    below = F.when(F.col("_d") != 0, rest / F.col("_d")).otherwise(0.0)
    found = state.withColumnRenamed("v", "before").join(done, ["i", "j"], "left").join(pivots, "j")
    return found.select("i", "j", "a", "before", F.when(F.col("i") > F.col("j"), below).otherwise(rest).alias("v"))


def _longest(triangle: DataFrame, most: int) -> int:
    """The length of the longest chain i, j = i', j' ... in a strict triangle, at most ``most``: sweeps beyond it move nothing."""
    edges = triangle.select("i", "j")
    for length in range(most):
        if not edges.limit(1).count():
            return length
        edges = checkpoint(edges.join(edges.select(F.col("i").alias("j")).distinct(), "j", "left_semi").select("i", "j"))
    return most


def incomplete(factor: DataFrame, steps: int = 6) -> Precondition:
    """The map (i, x) to U^-1 L^-1 x, each triangle in ``steps`` sweeps; exact once steps reach the length of its chains.

    Indices that the factor lacks stay as they are.
    """
    factor = checkpoint(factor)
    low, up = factor.where("i > j"), factor.where("i < j")
    down_steps, up_steps = _longest(low, steps), _longest(up, steps)
    pivots = factor.where("i = j").select("i", F.col("v").alias("_d"))

    def divided(x: DataFrame) -> DataFrame:
        return x.join(pivots, "i", "left").select("i", (F.col("x") / F.coalesce("_d", F.lit(1.0))).alias("x"))

    def solve(x: DataFrame) -> DataFrame:
        right = found = checkpoint(x.select("i", "x"))
        for _ in range(down_steps):
            found = residual(low, found, right)
        right = checkpoint(found)
        found = divided(right)
        for _ in range(up_steps):
            found = divided(residual(up, found, right))
        return found

    return solve
