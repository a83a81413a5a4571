"""Krylov methods and refinement. Each vector of a method is a column of one state table.

A step is one product (join and sum) and one aggregate that returns all its dot
products at once; the state is checkpointed so that the plan does not grow.
Start is x = 0 unless given. ``precondition`` maps a vector (i, x) to M^-1 x;
``jacobi`` and a factorisation's solve are such maps. Stops are relative:
|b - A x| / |b| <= epsilon.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.config import SolveStats
from ..plans.lineage import checkpoint
from .norms import backward_error
from .products import magnitude_bound, multiply_vector, residual

Precondition = Callable[[DataFrame], DataFrame]


def _by_key(df: DataFrame) -> DataFrame:
    """A vector as one side of a join on its index. It is as long as the system, and Parquet keeps constant columns so
    small that Spark would take it for a table to broadcast, so it is shuffled: the driver gets no vector."""
    return df.hint("shuffle_merge")


def identity(x: DataFrame) -> DataFrame:
    return x


def jacobi(a: DataFrame) -> Precondition:
    """Division by the diagonal; indices without one stay as they are."""
    d = checkpoint(a.where("i = j AND v <> 0").select("i", F.col("v").alias("_d")))
    return lambda x: x.join(_by_key(d), "i", "left").select("i", (F.col("x") / F.coalesce("_d", F.lit(1.0))).alias("x"))


def _column(state: DataFrame, vector: DataFrame, name: str) -> DataFrame:
    """The state with a vector as one more column; missing indices have 0."""
    return state.join(_by_key(vector.select("i", F.col("x").alias(name))), "i", "left").withColumn(name, F.coalesce(name, F.lit(0.0)))


def _as_vector(state: DataFrame, name: str) -> DataFrame:
    return state.select("i", F.col(name).alias("x"))


def _dots(state: DataFrame, *pairs: tuple[str, str]) -> list[float]:
    row = state.agg(*[F.sum(F.col(a) * F.col(b)).alias(f"d{k}") for k, (a, b) in enumerate(pairs)]).first()
    return [0.0 if x is None else x for x in row]


def _started(a: DataFrame, b: DataFrame, x0: DataFrame | None) -> DataFrame:
    if x0 is None:
        return b.select("i", F.col("x").alias("b"), F.lit(0.0).alias("x"), F.col("x").alias("r"))
    state = _column(b.select("i", F.col("x").alias("b")), x0, "x")
    return _column(state, residual(a, x0, b), "r")


def conjugate_gradient(a: DataFrame, b: DataFrame, precondition: Precondition = identity, x0: DataFrame | None = None, max_iterations: int = 250, epsilon: float = 1e-12) -> tuple[DataFrame, SolveStats]:
    """For symmetric positive definite A (stored in full)."""
    stats = SolveStats()
    state = _started(a, b, x0)
    state = _column(state, precondition(_as_vector(state, "r")), "z").withColumn("p", F.col("z"))
    state = checkpoint(state)
    bb, rz, rr = _dots(state, ("b", "b"), ("r", "z"), ("r", "r"))
    while bb and rr and stats.iterations < max_iterations and (rr / bb) ** 0.5 > epsilon:
        state = checkpoint(_column(state, multiply_vector(a, _as_vector(state, "p")), "q"))
        (pq,) = _dots(state, ("p", "q"))
        if pq == 0:
            break
        alpha = rz / pq
        state = state.select("i", "b", (F.col("x") + alpha * F.col("p")).alias("x"), (F.col("r") - alpha * F.col("q")).alias("r"), "p")
        state = _column(state, precondition(_as_vector(state, "r")), "z")
        if precondition is not identity:
            state = checkpoint(state)
        new, rr = _dots(state, ("r", "z"), ("r", "r"))
        state = state.withColumn("p", F.col("z") + (new / rz) * F.col("p"))
        rz = new
        stats.iterations += 1
        stats.history.append((stats.iterations, (rr / bb) ** 0.5))
    return _finished(a, b, state, bb, stats)


def _finished(a, b, state, bb, stats):
    x = checkpoint(_as_vector(state, "x"))
    (rr,) = residual(a, x, b).agg(F.sum(F.col("x") * F.col("x"))).first()
    stats.relative_error = ((rr or 0.0) / bb) ** 0.5 if bb else 0.0
    return x, stats


def bicgstab(a: DataFrame, b: DataFrame, precondition: Precondition = identity, x0: DataFrame | None = None, max_iterations: int = 250, epsilon: float = 1e-12) -> tuple[DataFrame, SolveStats]:
    """For general A, with the preconditioner also in the choice of omega."""
    stats = SolveStats()
    state = checkpoint(_started(a, b, x0).withColumn("h", F.col("r")).withColumn("p", F.col("r")))
    bb, rho = _dots(state, ("b", "b"), ("r", "h"))
    rr = rho
    while bb and rr and stats.iterations < max_iterations and (rr / bb) ** 0.5 > epsilon:
        state = checkpoint(_column(state, precondition(_as_vector(state, "p")), "y"))
        state = checkpoint(_column(state, multiply_vector(a, _as_vector(state, "y")), "v"))
        (hv,) = _dots(state, ("h", "v"))
        if hv == 0 or rho == 0:
            break
        alpha = rho / hv
        state = state.withColumn("s", F.col("r") - alpha * F.col("v"))
        state = checkpoint(_column(state, precondition(_as_vector(state, "s")), "z"))
        state = checkpoint(_column(state, multiply_vector(a, _as_vector(state, "z")), "t"))
        state = checkpoint(_column(state, precondition(_as_vector(state, "t")), "w"))
        wz, ww = _dots(state, ("w", "z"), ("w", "w"))
        omega = wz / ww if ww else 0.0
        state = state.select(
            "i", "b", "h", "p", "v", (F.col("x") + alpha * F.col("y") + omega * F.col("z")).alias("x"), (F.col("s") - omega * F.col("t")).alias("r")
        )
        new, rr = _dots(state, ("r", "h"), ("r", "r"))
        stats.iterations += 1
        stats.history.append((stats.iterations, (rr / bb) ** 0.5))
        if omega == 0:
            break
        beta = (new / rho) * (alpha / omega)
        state = state.withColumn("p", F.col("r") + beta * (F.col("p") - omega * F.col("v"))).drop("v")
        rho = new
    return _finished(a, b, state, bb, stats)


def gmres(a: DataFrame, b: DataFrame, precondition: Precondition = identity, x0: DataFrame | None = None, max_iterations: int = 250, epsilon: float = 1e-12, space: int = 25) -> tuple[DataFrame, SolveStats]:
    """Restarted, preconditioned from the right; Gram-Schmidt in one aggregate, rotations on the driver."""
    stats = SolveStats()
    state = checkpoint(_started(a, b, x0))
    bb, rr = _dots(state, ("b", "b"), ("r", "r"))
    while bb and rr and stats.iterations < max_iterations and (rr / bb) ** 0.5 > epsilon:
        beta = rr**0.5
        basis = state.select("i", "b", "x", (F.col("r") / beta).alias("v0"))
        h = np.zeros((space + 1, space))
        g, turns, used = np.zeros(space + 1), [], 0
        g[0] = beta
        for k in range(space):
            basis = checkpoint(_column(basis, precondition(_as_vector(basis, f"v{k}")), f"z{k}"))
            basis = checkpoint(_column(basis, multiply_vector(a, _as_vector(basis, f"z{k}")), "w"))
            *along, ww = _dots(basis, *[("w", f"v{m}") for m in range(k + 1)], ("w", "w"))
            rest = F.col("w") - sum((F.col(f"v{m}") * c for m, c in enumerate(along)), F.lit(0.0))
            basis = basis.withColumn("w", rest)
            (left,) = _dots(basis, ("w", "w"))
            h[: k + 1, k], h[k + 1, k] = along, max(left, 0.0) ** 0.5
            for m, (c, s) in enumerate(turns):
                h[m, k], h[m + 1, k] = c * h[m, k] + s * h[m + 1, k], c * h[m + 1, k] - s * h[m, k]
            size = np.hypot(h[k, k], h[k + 1, k]) or 1.0
            c, s = h[k, k] / size, h[k + 1, k] / size
            turns.append((c, s))
            stuck = h[k + 1, k] <= 1e-14 * max(ww, 0.0) ** 0.5
            h[k, k], below = size, h[k + 1, k]
            h[k + 1, k] = 0.0
            g[k], g[k + 1] = c * g[k], -s * g[k]
            used = k + 1
            stats.iterations += 1
            error = abs(g[k + 1]) / bb**0.5
            stats.history.append((stats.iterations, error))
            if error <= epsilon or stuck or stats.iterations >= max_iterations:
                break
            basis = basis.withColumn(f"v{k + 1}", F.col("w") / float(below)).drop("w")
        y = np.linalg.lstsq(np.triu(h[:used, :used]), g[:used], rcond=None)[0]
        step = sum((F.col(f"z{m}") * float(c) for m, c in enumerate(y)), F.col("x"))
        state = basis.select("i", "b", step.alias("x"))
        state = checkpoint(_column(state, residual(a, _as_vector(state, "x"), state.select("i", F.col("b").alias("x"))), "r"))
        before = rr
        (rr,) = _dots(state, ("r", "r"))
        if rr >= before:
            break
    return _finished(a, b, state, bb, stats)


def refine(a: DataFrame, b: DataFrame, solve: Precondition, x0: DataFrame | None = None, max_iterations: int = 250, epsilon: float = 1e-12) -> tuple[DataFrame, SolveStats]:
    """x += M^-1 (b - A x), from M^-1 b; stops when the backward error is small or no longer halves."""
    stats = SolveStats()
    x = checkpoint(x0 if x0 is not None else solve(b))
    last = None
    while stats.iterations < max_iterations:
        r = checkpoint(residual(a, x, b))
        berr = backward_error(r, magnitude_bound(a, x, b)).first()["berr"] or 0.0
        stats.history.append((stats.iterations, berr))
        last = 3 * berr if last is None else last
        if berr <= epsilon or berr > last / 2:
            break
        last = berr
        x = checkpoint(x.unionByName(solve(r)).groupBy("i").agg(F.sum("x").alias("x")))
        stats.iterations += 1
    (rr, bb) = residual(a, x, b).withColumnRenamed("x", "_r").join(b, "i").agg(F.sum(F.col("_r") * F.col("_r")), F.sum(F.col("x") * F.col("x"))).first()
    stats.relative_error = ((rr or 0.0) / bb) ** 0.5 if bb else 0.0
    return x, stats


METHODS = {"cg": conjugate_gradient, "bicgstab": bicgstab, "gmres": gmres, "pivot": refine}
