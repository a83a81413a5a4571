"""The stages of a solve, from entries to a refined solution."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame

from ..functions import complexes
from ..operators.factor import factorise, schur_complement, solve_factored
from ..operators.graph import analyse
from ..operators.incomplete import incomplete, incomplete_factor
from ..operators.krylov import METHODS, jacobi, refine
from ..operators.partition import check_matrix
from ..operators.structure import lower_triangle
from .config import SolverConfig, SolveStats
from .lineage import checkpoint
from .matrix import SparseMatrix


@dataclass
class SparseSolver:
    """check -> analyse -> factorise -> solve -> refine; later stages run earlier ones if they have to.

    A factor is kept for further right-hand sides until ``update`` brings new
    values; new values on the same pattern keep the analysis.
    """

    matrix: SparseMatrix
    config: SolverConfig = field(default_factory=SolverConfig)
    stats: SolveStats = field(default_factory=SolveStats)
    ordering: DataFrame | None = None
    _entries: DataFrame | None = None
    _analysis: DataFrame | None = None
    _fronts: DataFrame | None = None

    def __post_init__(self):
        self.config.checked(self.matrix.symmetry)

    def check(self) -> DataFrame:
        """The full matrix, checked and repaired."""
        if self._entries is None:
            checked = check_matrix(self.matrix.entries, self.matrix.symmetry != "general", self.config.repair)
            self._entries = checkpoint(self.matrix.with_entries(checked.entries).full().entries)
        return self._entries

    def analyse(self) -> DataFrame:
        if self._analysis is None:
            dof = self.matrix.dof if self.ordering is None else 1
            self._analysis = checkpoint(analyse(self.check(), self.matrix.rows, self.config.ordering, self.ordering, small=self.config.block, dof=dof))
        return self._analysis

    def factorise(self) -> DataFrame:
        if self._fronts is None:
            self._fronts = factorise(self.check(), self.analyse(), self.config.factor, self.config.pivot_epsilon)
            self.stats.replaced_pivots = self._fronts.agg({"replaced": "sum"}).first()[0] or 0
        return self._fronts

    def update(self, entries: DataFrame) -> SparseSolver:
        """New values on the same pattern."""
        self.matrix, self._entries, self._fronts = self.matrix.with_entries(entries), None, None
        return self

    def solve(self, b: DataFrame, transposed: bool = False) -> DataFrame:
        """Forward and backward sweeps, no refinement. One right-hand side, or several, in a column rhs, in one sweep."""
        return solve_factored(self.factorise(), self.analyse(), b, self.config.factor, transposed)

    def refine(self, b: DataFrame) -> DataFrame:
        """The configured method with the factor as preconditioner; with ``refine_only``, ILU(``fill_level``) or, without a level, Jacobi's."""
        if "rhs" in b.columns:
            return self._each(b, self.refine)
        a, c = self.check(), self.config
        if not c.refine_only:
            inverse = lambda v: checkpoint(self.solve(v))
        else:
            inverse = jacobi(a) if c.fill_level is None else incomplete(incomplete_factor(a, c.fill_level))
        more = {"space": c.krylov_space} if c.refinement == "gmres" else {}
        method = METHODS[c.refinement]
        if method is refine:
            x, stats = refine(a, b, inverse, max_iterations=c.max_iterations, epsilon=c.epsilon)
        else:
            x, stats = method(a, b, inverse, max_iterations=c.max_iterations, epsilon=c.epsilon, **more)
        stats.replaced_pivots = self.stats.replaced_pivots
        self.stats = stats
        return x

    def schur(self, chosen: DataFrame) -> DataFrame:
        return schur_complement(self.check(), self.matrix.rows, chosen, self.config.pivot_epsilon)

    def _each(self, b: DataFrame, solve) -> DataFrame:
        from pyspark.sql import functions as F

        out = None
        for (k,) in b.select("rhs").distinct().orderBy("rhs").collect():  # each has iterations of its own
            x = solve(b.where(F.col("rhs") == k).select("i", "x")).select("i", F.lit(k).alias("rhs"), "x")
            out = x if out is None else out.unionByName(x)
        return out


class ComplexSolver:
    """Complex systems through the real form of twice the order: v and x are (re, im) structs.

    The order is one of the complex unknowns: both parts of each stay together, and leaves stay leaves.

    Hermitian matrices (one triangle stored) take llt, or ldlh as the ldlt of
    their real form; general and symmetric ones take lu.
    """

    def __init__(self, matrix: SparseMatrix, config: SolverConfig | None = None):
        config, hermitian = (config or SolverConfig()).checked(matrix.symmetry, True), matrix.symmetry == "hermitian"
        if not hermitian and config.factor != "lu":
            raise ValueError("complex matrices that are not Hermitian need lu")
        real = complexes.real_form(matrix.full().entries)
        real = lower_triangle(real) if hermitian and config.factor != "lu" else real
        kind = "symmetric" if hermitian and config.factor != "lu" else "general"
        self.inner = SparseSolver(SparseMatrix(real, 2 * matrix.rows, 2 * matrix.cols, kind, dof=2), replace(config, factor="ldlt" if config.factor == "ldlh" else config.factor))

    def solve(self, b: DataFrame) -> DataFrame:
        return complexes.complex_vector(self.inner.solve(complexes.real_vector(b)))

    def refine(self, b: DataFrame) -> DataFrame:
        return complexes.complex_vector(self.inner.refine(complexes.real_vector(b)))
